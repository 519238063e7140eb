"""Replay of the last payload to a view that says that it is ready, as a stream with state.

A panel's state is its last `symbols` message. `ready` sends it again, `closed` clears it, and a panel that nothing is heard of
for `forget` milliseconds is forgotten. Messages of a panel are taken in the order of seq within a micro-batch, and
micro-batches as they come; a micro-batch's messages of one panel are held at once, so a source that limits its
micro-batches bounds what a task holds. With `forget` the query looks for silent panels as long as it runs, so a trigger that
takes what is available and ends needs a stream without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REPLAYED = "panel string, seq long, payload_seq long, payload string"
STATE = "payload_seq long, payload string"


def _replay(forget: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get if state.exists else None, []
        for message in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            if message.type == "symbols":
                last = (int(message.seq), message.payload)
            elif message.type == "closed":
                last = None
            elif message.type == "ready" and last is not None:
                out.append((key[0], int(message.seq), *last))
        if last is not None:
            state.update(tuple(last))
            if forget is not None:
                state.setTimeoutDuration(forget)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLAYED.split(", ")])

    return run


def replays(messages: DataFrame, forget: int | None = None) -> DataFrame:
    """REPLAYED: what each `ready` of a stream of messages (seq, panel, type, payload) is answered with; a panel without a payload is not answered.

    Messages without panel or seq are nobody's.
    """
    known = messages.where("panel is not null and seq is not null").selectExpr("cast(panel as string) as panel", "cast(seq as long) as seq", "type", "cast(payload as string) as payload")
    timeout = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout
    return known.groupBy("panel").applyInPandasWithState(_replay(forget), REPLAYED, STATE, "append", timeout)
