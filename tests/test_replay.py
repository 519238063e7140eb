"""Replay of payloads as a stream: against the batch form, and over a restart."""

from pyspark.sql import functions as F

from loomgraph.operators import readmodel as R
from loomgraph.plans import registry
from loomgraph.streaming.replay import replays

MESSAGES = "seq long, panel string, type string, payload string"


def run(spark, tmp_path):
    query = replays(spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_events_end_in_the_batch_form_and_survive_a_restart(spark, small, tmp_path):
    kind = F.when(F.col("event_type") == "view", "symbols").when(F.col("event_type") == "error", "closed").otherwise(F.col("event_type"))
    messages = spark.read.parquet(f"{small}/events.parquet").select((2 * F.col("event_id")).alias("seq"), F.col("user_id").cast("string").alias("panel"), kind.alias("type"), F.col("props").alias("payload"))
    middle, last = messages.agg(F.expr("percentile_approx(seq, 0.5)"), F.max("seq")).first()
    ready = lambda seq: messages.select("panel").distinct().select(F.lit(seq).cast("long").alias("seq"), "panel", F.lit("ready").alias("type"), F.lit(None).cast("string").alias("payload"))
    first = messages.where(F.col("seq") <= middle).unionByName(ready(middle + 1))
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = lambda rows: sorted((r["panel"], r["seq"], r["payload"]) for r in R.last_payloads(rows, "panel").collect())
    got = lambda df, seq: sorted((r["panel"], r["payload_seq"], r["payload"]) for r in df.where(F.col("seq") == seq).collect())
    assert got(run(spark, tmp_path), middle + 1) == want(messages.where(F.col("seq") <= middle))
    # a new query goes on from the checkpoint: the state of panels that the second part doesn't name is there
    messages.where(F.col("seq") > middle).unionByName(ready(last + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    after = got(run(spark, tmp_path), last + 1)
    assert after == want(messages)
    assert after == sorted((str(r["panel"]), 2 * r["seq"], r["payload"]) for r in registry.queries()["replay_cache"](spark, small).collect())


def test_order_and_nulls(spark, tmp_path):
    rows = [(3, "a", "ready", None), (1, "a", "symbols", "one"), (2, "a", "symbols", None), (5, "a", "closed", None), (6, "a", "ready", None), (1, "b", "ready", None), (None, "a", "ready", None), (1, None, "symbols", "x")]
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in run(spark, tmp_path).collect()] == [("a", 3, 2, None)]


def test_a_silent_panel_is_forgotten():
    """The function of one group, with a state that only notes what is asked of it."""
    import pandas as pd

    from loomgraph.streaming.replay import _replay

    class State:
        hasTimedOut, exists, get, wait = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutDuration(self, wait):
            self.wait = wait

    state, run_group = State(), _replay(5000)
    message = lambda *rows: iter([pd.DataFrame(rows, columns=["panel", "seq", "type", "payload"])])
    assert [len(x) for x in run_group(("a",), message(("a", 1, "symbols", "p")), state)] == [0]
    assert (state.get, state.wait) == ((1, "p"), 5000)
    state.hasTimedOut = True
    assert list(run_group(("a",), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    assert [len(x) for x in run_group(("a",), message(("a", 2, "ready", None)), state)] == [0]
