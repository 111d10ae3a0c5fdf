"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree: counts of the byte that
follows every context of 0 to ``order`` bytes. A byte's probability comes from
the longest context that was seen; a byte new to it pays that context's escape
probability (method C, without exclusions: distinct followers over total plus
distinct followers) and falls back to the next shorter one, from the empty
context to 1 in 256. Contexts that were never seen cost nothing to leave.

The statistics are frozen after the fit. Every byte is its own symbol, and only
contexts that were seen are stored, so the order is the same for any number of
languages. For each depth a hash table maps the byte strings that any language
has seen to their costs in every language; a byte is looked up at the full
depth first, and the few that no language has seen there go on to the next.
Costs are integers of 1/FRACTION bit, so a text's code length is the same sum
whatever order or partitioning the texts come in.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import batch, byte_view

BASE = 257  # a byte is its value plus one, 0 stands before a text's start
FRACTION = 1 << 24
SEGMENT = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_EMPTY = np.uint64(2**64 - 1)
_ASCII_LETTER = np.zeros(256, np.uint8)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = 1


def grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """For every symbol from the ``order``-th on the number that it, as the lowest digit, forms with the ``order`` before it."""
    out = symbols[order:].astype(np.uint64)
    for k in range(1, order + 1):
        out += symbols[order - k : len(symbols) - k].astype(np.uint64) * np.uint64(BASE**k)
    return out


def padded(data: np.ndarray, order: int) -> np.ndarray:
    symbols = np.zeros(len(data) + order, np.uint16)
    symbols[order:] = data
    symbols[order:] += 1
    return symbols


class Slots:
    """Open addressing over distinct keys: a key's number, or -1."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.size = 1 << int(np.uint64(64) - self.shift)
        self.keys = np.full(self.size, _EMPTY)
        self.number = np.full(self.size, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == _EMPTY
            self.keys[at[free]] = keys[left[free]]
            here = self.keys[at] == keys[left]
            self.number[at[here]] = left[here]
            left, at = left[~here], (at[~here] + 1) & (self.size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out, held = self.number[at], self.keys[at]
        left = np.flatnonzero((held != keys) & (held != _EMPTY))
        out[held != keys] = -1
        at = at[left]
        while len(left):
            at = (at + 1) & (self.size - 1)
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.number[at[hit]]
            more = ~hit & (held != _EMPTY)
            left, at = left[more], at[more]
        return out


@dataclass
class Depth:
    """What contexts of one length say: costs of the byte strings seen there and of leaving a context, a row per language."""

    seen: Slots
    costs: np.ndarray
    contexts: Slots
    escapes: np.ndarray


@dataclass(frozen=True)
class Model:
    """Frozen statistics: per language the counts of every string of ``order + 1`` symbols."""

    langs: tuple[str, ...]
    order: int
    grams: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]
    key: str

    def depths(self) -> list[Depth]:
        if self.key not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[self.key] = self._compile()
        return _COMPILED[self.key]

    def _compile(self) -> list[Depth]:
        out: list[Depth] = []
        shorter, lower = np.zeros(1, np.uint64), np.full((len(self.langs), 1), 8 * FRACTION, np.int64)
        for k in range(self.order + 1):
            parts = [np.unique(g % np.uint64(BASE ** (k + 1)), return_inverse=True) for g in self.grams]
            keys = np.unique(np.concatenate([p for p, _ in parts]))
            contexts, of = np.unique(keys // np.uint64(BASE), return_inverse=True)
            down = np.searchsorted(shorter, keys % np.uint64(BASE**k)) if k else np.zeros(len(keys), np.int64)
            costs, escapes = np.empty((len(self.langs), len(keys)), np.int64), np.empty((len(self.langs), len(contexts)), np.int64)
            for j, (own, inverse) in enumerate(parts):
                n = np.zeros(len(keys))
                n[np.searchsorted(keys, own)] = np.bincount(inverse, weights=self.counts[j], minlength=len(own))
                total, kinds = np.bincount(of, weights=n, minlength=len(contexts)), np.bincount(of, weights=n > 0, minlength=len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escapes[j] = np.where(total > 0, np.rint(-np.log2(kinds / (total + kinds)) * FRACTION), 0)
                    costs[j] = np.where(n > 0, np.rint(-np.log2(n / (total + kinds)[of]) * FRACTION), (escapes[j][of] + lower[j][down]))
            out.append(Depth(Slots(keys), costs, Slots(contexts), escapes))
            shorter, lower = keys, costs
        return out


_COMPILED: dict[str, list[Depth]] = {}


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 256, order: int = 4, languages: int = 1000) -> Model:
    """Learn from a bounded sample: about ``per_language`` rows of each of the ``languages`` commonest languages, chosen by a hash of ``key``.

    Rows with a null text, language or key are not used. Whole texts are
    counted. Without rows the model knows no language.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where("lang is not null and text is not null and key is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    sizes = {r["lang"]: r["n"] for r in sizes.collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), order, (), (), "none")
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * F.lit(float(1 << 30)))

    def count(batches):
        for b in batches:
            data, offsets, _ = byte_view(b.column(1))
            names = b.column(0).to_pylist()
            for name in sorted(set(names)):
                got = [grams(padded(data[offsets[i] : offsets[i + 1]], order), order) for i, x in enumerate(names) if x == name]
                found, n = np.unique(np.concatenate(got), return_counts=True)
                yield batch(GRAMS, [name] * len(found), found.view(np.int64), n)

    found = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    strings, n = found.column("gram").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy()
    at = [np.flatnonzero(names == k) for k in langs]
    at = [i[np.argsort(strings[i])] for i in at]
    parts = tuple(strings[i] for i in at), tuple(n[i].astype(np.float64) for i in at)
    return Model(langs, order, *parts, hashlib.md5(pickle.dumps((langs, order, parts))).hexdigest())


GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
SCORED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])


def _costs(model: Model, strings: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Summed costs of the strings from each start to the next, a column per language."""
    put, left = [], np.arange(len(strings))
    for k in range(model.order, -1, -1):
        depth, keys = model.depths()[k], strings[left] % np.uint64(BASE ** (k + 1))
        number = depth.seen.find(keys)
        hit = number >= 0
        put.append((left[hit], depth.costs, number[hit]))
        left, keys = left[~hit], keys[~hit]
        if not len(left):
            break
        number = depth.contexts.find(keys // np.uint64(BASE))
        put.append((left[number >= 0], depth.escapes, number[number >= 0]))
    out = np.empty((len(starts), len(model.langs)), np.int64)
    for j in range(len(model.langs)):
        cost = np.zeros(len(strings), np.int64)
        cost[left] = 8 * FRACTION  # bytes that no language has seen
        for at, costs, number in put:
            cost[at] += costs[j][number]
        out[:, j] = np.add.reduceat(cost, starts)
    return out


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cost of every text under every language, in 1/FRACTION bits; a text's bytes are taken a segment at a time."""
    out = np.zeros((len(offsets) - 1, len(model.langs)), np.int64)
    order, i = model.order, 0
    while i < len(out):
        j = i + 1
        while j < len(out) and offsets[j + 1] - offsets[i] <= SEGMENT:
            j += 1
        if j - i == 1:  # perhaps longer than a segment
            start, end = offsets[i], offsets[i + 1]
            for s in range(start, end, SEGMENT):
                e = min(end, s + SEGMENT)
                symbols = padded(data[s:e], order)
                back = min(order, s - start)
                if back:
                    symbols[order - back : order] = data[s - back : s].astype(np.uint16) + 1
                out[i] += _costs(model, grams(symbols, order), np.zeros(1, np.int64))[0]
        else:
            full = [k for k in range(i, j) if offsets[k + 1] > offsets[k]]
            if full:
                parts = [grams(padded(data[offsets[k] : offsets[k + 1]], order), order) for k in full]
                sizes = np.array([len(p) for p in parts])
                out[full] = _costs(model, np.concatenate(parts), np.cumsum(sizes) - sizes)
        i = j
    return out


def _has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> np.ndarray:
    out = np.zeros(len(valid), bool)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        flags = _ASCII_LETTER[data[offsets[0] : offsets[-1]]]
        out[full] = np.bitwise_or.reduceat(flags, offsets[full] - offsets[0]) > 0
    for i in full[valid[full] & ~out[full]].tolist():  # the few texts without an ASCII letter
        out[i] = _LETTER.search(column[i].as_py()) is not None
    return out & valid


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits`` instead of the text column.

    ``lang_pred`` is the language with the smallest code length (ties: the
    first name), ``und`` where the text is null or has no letter or nothing was
    learned. ``score`` is the posterior of that language under equal priors (0
    for ``und``), ``bits`` its code length. Repeated rows and null keys pass
    through; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != text]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = held.value
        names = [*m.langs, "und"]
        for b in batches:
            column = b.column(len(kept))
            data, offsets, valid = byte_view(column)
            known = _has_letter(column, data, offsets, valid) if m.langs else np.zeros(len(valid), bool)
            best, p, bits = np.full(len(known), len(m.langs)), np.zeros(len(known)), np.zeros(len(known))
            if known.any():
                cost = code_lengths(m, data, offsets) / FRACTION
                least = cost.min(1)
                best = np.where(known, cost.argmin(1), len(m.langs))
                p = np.where(known, 1 / np.exp2(-np.minimum(cost - least[:, None], 1000)).sum(1), 0.0)
                bits = np.where(known, least, 0.0)
            tail = batch(SCORED, [names[i] for i in best], p, bits)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *tail.columns], names=[*kept, *SCORED.names])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("bits", "double")
    return docs.select(*kept, text).mapInArrow(score, schema)
