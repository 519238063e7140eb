"""Operator 7: secret scans through a trigram inverted index.

Each rule's regular expression is read as a syntax tree, from which a Boolean query over trigrams
follows: every text that the rule matches holds the trigrams of that query. A step of texts is
indexed (trigram -> texts that hold it, for the trigrams that rules mention), postings are
intersected and united as the query says, and only the candidates are verified with the regular
expression. A rule without mandatory trigrams scans all texts.

Defined results: null and empty texts hold no secret; repeated rows are scanned each by themselves;
texts are scanned whole, whatever their length; spans of two kinds at one place are both kept, in the kinds'
order; an empty table gives no row; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import re._parser as regex_tree
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, flat_bytes, steps, texts_of
from loomgraph.session import ship

#: Most strings that one exact part of a query may list before it is closed.
MOST_STRINGS = 256


def either_case(word: str) -> str:
    """A pattern for ASCII letters in either case; re.IGNORECASE would also take other letters."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and the least length of one group of a match (group 0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


KEYWORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
BASE_RULES = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of 24 and more are just the matches of [0-9a-f]+ that are kept
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

#: A query in conjunctive form: each part is a choice of trigram sets, one of which a match holds whole.
Query = tuple[frozenset[frozenset[str]], ...]


def _fold(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


class _Derived:
    """Collects the parts of a query while a concatenation is read from left to right."""

    def __init__(self) -> None:
        self.parts: list[frozenset[frozenset[str]]] = []
        self.run: set[str] = {""}

    def close(self) -> None:
        run, self.run = self.run, {""}
        shortest = sorted(run, key=len)
        kept = [s for i, s in enumerate(shortest) if not any(t in s for t in shortest[:i])]
        grams = [frozenset(s.encode()[i : i + 3] for i in range(len(s.encode()) - 2)) for s in kept]
        if all(grams):
            self.parts.append(frozenset(grams))

    def extend(self, strings: set[str]) -> None:
        if len(self.run) * len(strings) > MOST_STRINGS:
            self.close()
        if len(strings) > MOST_STRINGS:
            return
        self.run = {a + b for a, b in itertools.product(self.run, strings)}

    def all_of(self, parts: list[frozenset[frozenset[str]]]) -> None:
        self.close()
        self.parts += parts


def _strings(items) -> set[str] | None:
    """All (case-folded) strings of a subtree, if they are few."""
    found = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            step = {_fold(chr(arg))}
        elif name == "IN":
            step = _members(arg)
        elif name == "SUBPATTERN":
            step = _strings(arg[3])
        elif name == "BRANCH":
            each = [_strings(x) for x in arg[1]]
            step = None if None in each else set().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] is not regex_tree.MAXREPEAT and arg[1] <= 4:
            once = _strings(arg[2])
            step = None if once is None or len(once) ** arg[1] > MOST_STRINGS else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(once, repeat=n)}
        elif name == "AT":
            step = {""}
        else:
            step = None
        if step is None or len(found) * len(step) > MOST_STRINGS:
            return None
        found = {a + b for a, b in itertools.product(found, step)}
    return found


def _members(arg) -> set[str] | None:
    out: set[str] = set()
    for op, value in arg:
        if str(op) == "LITERAL":
            out.add(_fold(chr(value)))
        elif str(op) == "RANGE" and value[1] - value[0] < 8:
            out |= {_fold(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def _derive(items) -> list[frozenset[frozenset[str]]]:
    got = _Derived()
    for item in items:
        op, arg = item
        name = str(op)
        exact = _strings([item])
        if exact is not None:
            got.extend(exact)
        elif name == "SUBPATTERN":
            got.all_of(_derive(arg[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least = _strings(list(arg[2]) * min(arg[0], 4)) if arg[0] else None
            if least is None:
                got.all_of(_derive(arg[2]) if arg[0] else [])
            else:  # what comes before meets the first repeats, what follows meets the last ones
                got.extend(least)
                got.close()
                got.extend(least)
        elif name == "BRANCH":
            each = [_derive(x) for x in arg[1]]
            # each branch gives its first part: one of them holds in every match
            got.all_of([frozenset().union(*(parts[0] for parts in each))] if all(each) else [])
        else:
            got.close()
    got.close()
    return got.parts


def trigram_query(pattern: str) -> Query:
    """The trigrams (of UTF-8 bytes, ASCII letters in lower case) that any match of the pattern holds; empty: none is mandatory."""
    return tuple(_derive(list(regex_tree.parse(pattern))))


class Scanner:
    """Rules with their queries, and the index of one step of texts after another."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.compiled = [re.compile(r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        grams = sorted({g for q in self.queries for part in q for choice in part for g in choice})
        self.codes = np.array([int.from_bytes(g, "big") for g in grams], dtype=np.uint32)
        self.number = {g: i for i, g in enumerate(grams)}
        self.wanted = np.zeros(1 << 24, dtype=bool)
        self.wanted[self.codes] = True
        self.folded = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

    def postings(self, texts: list[str]) -> list[np.ndarray]:
        """For each trigram of the rules, the ascending numbers of the texts that hold it."""
        data, offsets = flat_bytes([t.encode("utf-8", "surrogatepass") for t in texts])
        if len(data) < 3 or not len(self.codes):
            return [np.zeros(0, dtype=np.int64)] * len(self.codes)
        low = self.folded[data].astype(np.uint32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(self.wanted[code])
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[text + 1]
        pairs = np.unique(np.searchsorted(self.codes, code[at[inside]]).astype(np.int64) * len(texts) + text[inside])
        gram, text = np.divmod(pairs, max(1, len(texts)))
        edges = np.searchsorted(gram, np.arange(len(self.codes) + 1))
        return [text[a:b] for a, b in itertools.pairwise(edges)]

    def candidates(self, query: Query, postings: list[np.ndarray], n: int) -> np.ndarray:
        """Texts for which the Boolean query holds."""
        found = np.arange(n)
        for part in query:
            one_of = np.zeros(0, dtype=np.int64)
            for choice in part:
                lists = sorted((postings[self.number[g]] for g in choice), key=len)
                held = lists[0]
                for more in lists[1:]:
                    held = np.intersect1d(held, more, assume_unique=True)
                one_of = np.union1d(one_of, held)
            found = np.intersect1d(found, one_of, assume_unique=True)
        return found

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) of each text's secrets in order, in code points."""
        postings = self.postings(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            find = self.compiled[k].finditer
            for i in self.candidates(query, postings, len(texts)).tolist():
                for m in find(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the array of spans (kind, start, end in code points) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(rules)
        for batch in steps(batches):
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in scanner.scan(texts_of(batch))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[{}]") -> DataFrame:
    """The documents, in their own columns, with every secret replaced by its masked kind and n_chars counted anew."""
    ship(docs.sparkSession)
    columns = docs.columns

    def clean(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for a, k, b in spans:
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], mask.format(rules[k].kind)]
            at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(rules)
        for batch in steps(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            new = pa.array([clean(t, s) for t, s in zip(texts, scanner.scan([t or "" for t in texts]))], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, of every document."""
    docs, rules = documents(spark, sf_dir), RULES
    ship(spark)
    base = len(BASE_RULES)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(rules)
        write = lambda spans: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)
        for batch in steps(batches):
            found = scanner.scan(texts_of(batch))
            counts = [pa.array([sum(k == n for _, k, _ in s) for s in found], pa.int64()) for n in range(base)]
            digests = pa.array([hashlib.sha256(write([x for x in s if x[1] < base]).encode()).hexdigest() for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts, digests, pa.array(list(map(write, found)))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
