"""Matching many terms in many texts, and mapping matches to words.

Terms become an Aho-Corasick automaton, so a text is read once whatever the
number of terms, where it lies and without a shuffle. Ranges of characters meet
through cells of CELL characters, so a long text never pairs all its tokens with
all its matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.storage import bound_batches

MOST_TERMS = 100_000
MOST_BYTES = 16 << 20
MOST_ROWS = 1 << 15  # rows to gather before a batch is handed on
CELL_BITS = 5


def cells(start: Column, end: Column) -> Column:
    """Numbers of the cells that ``[start, end)`` touches."""
    return F.sequence(F.shiftright(start, CELL_BITS), F.shiftright(end - 1, CELL_BITS))


def automaton(terms: Iterable[str | None]) -> ahocorasick.Automaton | None:
    """Finds ``terms``; a match's value is ``(length, numbers of the equal terms)``. Null and empty terms match nothing; without any other there is none."""
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        if t:
            length, same = found.get(t, (len(t), ()))
            found.add_word(t, (length, (*same, i)))
    if not len(found):
        return None
    found.make_automaton()
    return found


def _scan(docs: DataFrame, key: str, text: str, schema, search: Callable, finish: Callable) -> DataFrame:
    """``search(state, text)`` lists matches as tuples of numbers; ``finish`` makes the columns after the key from their array."""

    def run(batches):
        state = None
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                if not t:
                    continue
                state = state or search()
                found = state(t)
                at.extend([i] * len(found))
                rows.extend(found)
                if len(rows) >= MOST_ROWS:
                    yield out(b, at, rows)
                    at, rows = [], []
            if rows:
                yield out(b, at, rows)

    def out(b, at, rows):
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *finish(np.array(rows, np.int64))], names=schema.names)

    bound_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def overlapping(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "norm") -> DataFrame:
    """``key, term, priority, s, e``: all occurrences, also those that overlap each other or themselves.

    The terms' size is counted first; a lexicon above MOST_TERMS or MOST_BYTES
    is dealt by hash over parts of about that size, each with an automaton and
    a pass over the texts of its own. Repeated terms each give their matches.
    """
    terms = terms.select("term", "priority")
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // MOST_TERMS), -(-(size["bytes"] or 0) // MOST_BYTES))
    found = [_overlapping(docs, terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i) if parts > 1 else terms, key, text) for i in range(parts)]
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def _overlapping(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    table = terms.toArrow()
    held = docs.sparkSession.sparkContext.broadcast(pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], names=table.column_names))
    schema = docs.select(key).schema.add(terms.schema["term"]).add(terms.schema["priority"]).add("s", "long").add("e", "long")

    def search():
        find = automaton(held.value.column("term").to_pylist())
        return lambda t: [(i, end + 1 - length, end + 1) for end, (length, same) in find.iter(t) for i in same] if find else []

    def finish(rows):
        of = pa.array(np.ascontiguousarray(rows[:, 0]))
        return [*(c.take(of) for c in held.value.columns), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in (1, 2))]

    return _scan(docs, key, text, schema, search, finish)


def alternation(terms: list[str]) -> str:
    """Longest first, so that the first alternative that fits is the longest."""
    return "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def greedy(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "norm") -> DataFrame:
    """``key, s, e``: leftmost-longest matches that do not overlap."""
    held = docs.sparkSession.sparkContext.broadcast(sorted(set(terms)))
    schema = docs.select(key).schema.add("s", "long").add("e", "long")

    def search():
        find = automaton(held.value)

        def spans(t):
            longest = {end + 1 - length: end + 1 for end, (length, _) in find.iter(t)} if find else {}  # ends only grow
            out, free = [], 0
            for s in sorted(longest):
                if s >= free:
                    free = longest[s]
                    out.append((s, free))
            return out

        return spans

    return _scan(docs, key, text, schema, search, lambda rows: [pa.array(np.ascontiguousarray(rows[:, i])) for i in (0, 1)])


def tokens_in_spans(tokens: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens with whether their midpoint lies in a span."""
    lists = spans.where("s < e").select(key, "s", "e", F.explode(cells(F.col("s"), F.col("e"))).alias("cell"))
    lists = lists.groupBy(key, "cell").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    mid = (F.col("start_at") + F.col("end_at")) / 2
    inside = F.exists("spans", lambda x: (x["s"] <= mid) & (mid < x["e"]))
    rows = tokens.withColumn("cell", F.shiftright(F.col("start_at") + F.col("end_at"), CELL_BITS + 1))
    return rows.join(lists, [key, "cell"], "left").select(*tokens.columns, F.coalesce(inside, F.lit(False)).alias("legal"))
