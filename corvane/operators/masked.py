"""Masked samples in one pass over the texts.

Tokens, lexicon matches, windows, budgets, selected words and replacements of a
document depend on that document alone, so they are made where its text is
read, without a shuffle: a row per window goes out. Every random choice is a
keyed hash of the document, window and word or token (four of them share an
MD5), so results do not depend on partitions. All steps run over arrays of many
texts and windows: a text, word or token costs no call of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField

from corvane.operators.digests import numbered_md5
from corvane.operators.masking import BIAS, DENSITY_TIERS, FLOORS, LEGAL_OUTCOME, ONLINE_RATE, OUTCOME, PHRASE_PRIORITY, PROTECTED
from corvane.operators.matching import MOST_BYTES, automaton
from corvane.operators.tokens import RegexTokenizer, Tokens, bunches, together
from corvane.storage import bound_batches

MOST_TERMS = 1_000_000
IGNORED = -100
FRACTIONS = ("density", "rate", "share")
SAMPLES = ("words", "kinds", "places", "outcomes", "input_ids", "labels")
MOST_WINDOWS = 256  # windows to make at once
RANGE = 4294967296.0  # random numbers are 32 bits over this


def turkish_fold(text: str) -> str:
    """Lower case as in Turkish, circumflexes dropped; keeps every character's place."""
    text = text.replace("İ", "i").replace("I", "ı").lower()
    return text.replace("â", "a").replace("î", "i").replace("û", "u")


def uniforms(salt: str, key, chunk: int, first: int, last: int) -> np.ndarray:
    """Numbers in [0, 1) for ``first`` to ``last`` inclusive: the four words of an MD5 of salt, key, chunk and number // 4."""
    return drawn(salt, [(key, chunk)], np.zeros(last - first + 1, np.int64), np.arange(first, last + 1)) / RANGE


def drawn(salt: str, windows: list[tuple], of: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The 32 random bits of ``numbers[i]`` in ``windows[of[i]]``, each a key and chunk; numbers that share an MD5 stand side by side."""
    group = numbers // 4
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (group[1:] != group[:-1])
    bits = numbered_md5([f"{salt}|{k}|{c}|".encode() for k, c in windows], of[fresh], group[fresh])
    return bits[np.cumsum(fresh) - 1, numbers % 4]


def ranges(firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from every first on, ``sizes`` of them each, and whose they are."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + (firsts - np.cumsum(sizes) + sizes)[of], of


def places_within(of: np.ndarray, n: int) -> np.ndarray:
    """For sorted owners, the place of each row among its owner's."""
    counts = np.bincount(of, minlength=n)
    return np.arange(len(of)) - (np.cumsum(counts) - counts)[of]


def totals(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums over stretches that begin at ``firsts``, none of them empty."""
    return np.add.reduceat(values, firsts, dtype=np.int64)


@dataclass(frozen=True)
class Windows:
    """Windows over tokens: first token and end, the window's key and number, and its words by their number and within the text."""

    starts: np.ndarray
    ends: np.ndarray
    names: list[tuple]
    low: np.ndarray  # first word, counted over all texts
    before: np.ndarray  # words of the texts before
    slots: np.ndarray  # where the window's words begin among those of all windows
    word: np.ndarray  # of every slot
    of: np.ndarray  # the window of every slot
    first: np.ndarray  # first token of the slot in the window, and its end
    last: np.ndarray

    @classmethod
    def over(cls, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: list[tuple], before: np.ndarray, bounds: np.ndarray) -> Windows:
        low = words[starts]
        sizes = words[ends - 1] - low + 1
        word, of = ranges(low, sizes)
        return cls(starts, ends, names, low, before, np.cumsum(sizes) - sizes, word, of, np.maximum(bounds[word], starts[of]), np.minimum(bounds[word + 1], ends[of]))

    def draw(self, slots: np.ndarray | slice) -> np.ndarray:
        """The random bits of slots for the choice of words."""
        of = self.of[slots]
        return drawn("select", self.names, of, self.word[slots] - self.before[of])


class Lexicon:
    """Terms and priorities as an automaton over folded text."""

    def __init__(self, terms: Iterable[tuple[str | None, float]], fold: Callable[[str], str] = turkish_fold):
        self.terms, self.fold = list(terms), fold
        self.find = automaton(t for t, _ in self.terms)
        self.best = np.full(len(self.terms), np.nan)  # by the first of equal terms
        self.several = np.array([" " in (t or "") for t, _ in self.terms], bool)
        for _, same in self.find.values() if self.find else ():
            self.best[same[0]] = max(self.terms[i][1] for i in same)

    def matches(self, texts: list[str], longer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and terms of all matches, by places in the joined texts; without ``longer`` no text has any whose folding changes its length."""
        found, at = [], 0
        for t in texts if self.find else ():
            folded = self.fold(t)
            if longer or len(folded) == len(t):
                found.extend((min(at + end + 1 - length, at + len(t)), min(at + end + 1, at + len(t)), same[0]) for end, (length, same) in self.find.iter(folded))
            at += len(t) + 1
        rows = np.array(found, np.int64).reshape(-1, 3)
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def words(self, text: str | list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Priority of every word (nan: none) and whether it is part of a phrase; of one text, or of several and their tokens together.

        A match gives its priority to the word at its middle character; one of
        several words that covers at least two makes all from its first to its
        last a phrase. Where folding changes the text's length nothing matches,
        since places would shift.
        """
        n = int(tokens.words[-1]) + 1
        priority = np.full(n, np.nan)
        s, e, term = self.matches([text] if isinstance(text, str) else text, False)
        if not len(s):
            return priority, np.zeros(n, bool)
        mid = (s + e) // 2
        at = np.searchsorted(tokens.starts, mid, side="right") - 1
        inside = (at >= 0) & (mid < tokens.ends[at])
        np.fmax.at(priority, tokens.words[at[inside]], self.best[term[inside]])
        some = self.several[term]
        a, b = np.searchsorted(tokens.ends, s[some], side="right"), np.searchsorted(tokens.starts, e[some]) - 1
        a, b = a[a <= b], b[a <= b]
        lo, hi = tokens.words[a], tokens.words[b]
        lo, hi = lo[lo < hi], hi[lo < hi]
        phrase = np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi + 1, minlength=n + 1))[:n] > 0
        priority[phrase] = PHRASE_PRIORITY
        return priority, phrase

    def legal(self, text: str | list[str], tokens: Tokens) -> np.ndarray:
        """Which tokens have their middle in a leftmost-longest match, of one text or of several together."""
        s, e, _ = self.matches([text] if isinstance(text, str) else text, True)
        longest = dict(zip(s.tolist(), e.tolist(), strict=True))  # ends only grow
        starts, ends, free = [], [], 0
        for x in sorted(longest):
            if x >= free:
                free = longest[x]
                starts.append(x)
                ends.append(free)
        if not starts:
            return np.zeros(len(tokens.starts), bool)
        middle = tokens.starts + tokens.ends  # twice the middle
        at = np.searchsorted(2 * np.array(starts), middle, side="right") - 1
        return (at >= 0) & (middle < 2 * np.array(ends)[at])


def by_draw(w: Windows, slots: np.ndarray, bits: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Slots by window, those in ``last`` after the others, then by their bits, then by place: sorted as one number each."""
    width = int(np.diff(w.slots, append=len(w.word)).max()).bit_length()
    above = w.of[slots] if last is None else 2 * w.of[slots] + last
    key = np.sort(above.astype(np.uint64) << np.uint64(32 + width) | bits.astype(np.uint64) << np.uint64(width) | (slots - w.slots[w.of[slots]]).astype(np.uint64))
    return w.slots[(key >> np.uint64(32 + width + (last is not None))).astype(np.int64)] + (key & np.uint64((1 << width) - 1)).astype(np.int64)


class Offline:
    """Rates by the density of lexicon words; phrases first, then by priority, then at random."""

    width, stride, least, reads_tokens = 510, 256, 10, True
    numbers = ("density", "rate", "share", "maskable", "budget", "legal_budget")

    def __init__(self, lexicon: Lexicon, tokenizer):
        self.lexicon, self.protected = lexicon, tokenizer.protected(PROTECTED)

    def windows(self, n: np.ndarray) -> np.ndarray:
        """How many windows texts of ``n`` tokens have."""
        return np.maximum(n - self.least, -1) // self.stride + 1

    def documents(self, texts: list[str], tokens: Tokens):
        priority, phrase = self.lexicon.words(texts, tokens)
        return priority, phrase, np.concatenate([[0], np.cumsum(self.protected(tokens))])

    def select(self, state, w: Windows):
        """Slots of selected words by window, their kinds (0 phrase, 1 lexicon, 2 other) and the windows' numbers."""
        priority, phrase, safe = state
        n = len(w.starts)
        free = safe[w.last] == safe[w.first]
        priority = priority[w.word]
        legal = ~np.isnan(priority)
        kind = np.where(legal, np.where(phrase[w.word], 0, 1), 2)
        density = totals(legal, w.slots) / np.diff(w.slots, append=len(w.word))
        rate, share = (np.select([density > t[0] for t in DENSITY_TIERS], [t[i] for t in DENSITY_TIERS], FLOORS[i - 1]) for i in (1, 2))
        maskable = totals(free, w.slots)
        budget = np.maximum(1, np.floor(maskable * rate)).astype(np.int64)
        legal_budget = np.floor(budget * share).astype(np.int64)
        phrases, others, rest = (np.flatnonzero(free & (kind == k)) for k in range(3))
        counts = [np.bincount(w.of[x], minlength=n) for x in (phrases, others)]
        taken = np.minimum(np.maximum(legal_budget - counts[0], 0), counts[1])
        others = others[np.lexsort((-priority[others], w.of[others]))]
        others = others[places_within(w.of[others], n) < taken[w.of[others]]]
        left = budget - counts[0] - taken
        rest = rest[left[w.of[rest]] > 0]
        rest = by_draw(w, rest, w.draw(rest))
        rest = rest[places_within(w.of[rest], n) < left[w.of[rest]]]
        chosen = np.concatenate([phrases, others, rest])
        chosen = chosen[np.argsort(w.of[chosen], kind="stable")]
        return chosen, kind[chosen], (density, rate, share, maskable, budget, legal_budget)

    def outcome(self, u: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """0 mask, 1 random id, 2 keep."""
        mask = np.where(kinds < 2, LEGAL_OUTCOME[0], OUTCOME[0])
        return np.where(u < mask, 0, np.where(u < mask + np.where(kinds < 2, LEGAL_OUTCOME[1], OUTCOME[1]), 1, 2))


class Online:
    """A fixed rate of words, or of tokens without ``whole_words``, with a bias to those of the lexicon."""

    width, stride, least, reads_tokens = 510, 128, 50, False
    numbers = ("maskable", "budget", "legal_budget")

    def __init__(self, lexicon: Lexicon, tokenizer, whole_words: bool = True, rate: float = ONLINE_RATE, bias: float = BIAS):
        self.lexicon, self.whole_words, self.rate, self.bias = lexicon, whole_words, rate, bias

    def windows(self, n: np.ndarray) -> np.ndarray:
        """How many windows texts of ``n`` tokens have."""
        return np.where(n >= self.least, -(-np.maximum(n - self.width, 0) // self.stride) + 1, 0)

    def documents(self, texts: list[str], tokens: Tokens):
        return np.concatenate([[0], np.cumsum(self.lexicon.legal(texts, tokens))])

    def select(self, state, w: Windows):
        """Slots of selected words (or tokens) by window, their kinds (1 lexicon, 2 other) and the windows' numbers."""
        n = len(w.starts)
        legal = state[w.last] > state[w.first]
        sizes, most = np.diff(w.slots, append=len(w.word)), totals(legal, w.slots)
        total = np.maximum(1, np.floor(sizes * self.rate)).astype(np.int64)
        took = np.minimum(np.floor(total * self.bias).astype(np.int64), most)
        slots = np.arange(len(w.word))
        slots = by_draw(w, slots, w.draw(slots), ~legal)
        of, place, legal = w.of[slots], places_within(w.of[slots], n), legal[slots]
        keep = np.where(legal, place < took[of], place - most[of] < (total - took)[of])
        return slots[keep], np.where(legal[keep], 1, 2), (sizes, total, took)

    def outcome(self, u: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.where(u < OUTCOME[0], 0, np.where(u < OUTCOME[0] + OUTCOME[1], 1, 2))


def replaced(policy, tokenizer, w: Windows, chosen: np.ndarray, kinds: np.ndarray, ids: np.ndarray):
    """Tokens of chosen slots, their windows, outcomes and what stands there then; special tokens are never chosen."""
    order = np.argsort(chosen)
    slots, kinds = chosen[order], kinds[order]
    at, which = ranges(w.first[slots], w.last[slots] - w.first[slots])
    if tokenizer.special_ids:
        usual = ~np.isin(ids[at], list(tokenizer.special_ids))
        at, which = at[usual], which[usual]
    of = w.of[slots[which]]
    places = at - w.starts[of]
    out = policy.outcome(drawn("replace", w.names, of, places) / RANGE, kinds[which])
    put = ids[at]
    put[out == 0] = tokenizer.mask_id
    other = np.flatnonzero(out == 1)
    put[other] = (drawn("random", w.names, of[other], places[other]) / RANGE * tokenizer.vocabulary).astype(np.int64)
    return at, of, out, put


def broadcast_terms(terms: DataFrame) -> list[tuple]:
    """The terms and priorities of a lexicon of at most MOST_TERMS terms and 64 MB."""
    found = terms.select("term", "priority").limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS or sum(len(r["term"] or "") for r in found) > 4 * MOST_BYTES:
        raise ValueError("the lexicon is too large to broadcast")
    return [tuple(r) for r in found]


def lexicon_words(docs: DataFrame, terms: DataFrame, tokenizer=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, word_id, priority, is_phrase`` of words that the lexicon touches, as :func:`corvane.operators.masking.word_map` has them, where the texts are read.

    Tokens never meet matches in a join: only a text's lexicon words leave
    Python. Rows with the same key have one entry a word; those without a key
    have none.
    """
    held = docs.sparkSession.sparkContext.broadcast((broadcast_terms(terms), tokenizer or RegexTokenizer()))
    schema = docs.select(key).schema.add("word_id", "long").add("priority", "double").add("is_phrase", "boolean")
    bound_batches(docs.sparkSession)

    def run(batches):
        terms, tokens_of = held.value
        lexicon = Lexicon(terms)
        for b in batches:
            texts = b.column(1).to_pylist()
            for rows in bunches(texts):
                found, n = together(tokens_of, [texts[i] for i in rows], ids=False)
                if not n.any():
                    continue
                priority, phrase = lexicon.words([texts[i] for i in rows], found)
                some = np.flatnonzero(n)
                first = found.words[(np.cumsum(n) - n)[some]]
                words = np.flatnonzero(~np.isnan(priority))
                of = np.searchsorted(first, words, side="right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(rows)[some][of])), pa.array(words - first[of]), pa.array(priority[words]), pa.array(phrase[words])], names=schema.names)

    found = docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, schema)
    return found.groupBy(key, "word_id").agg(F.max("priority").alias("priority"), F.bool_or("is_phrase").alias("is_phrase"))


def masked_windows(docs: DataFrame, terms: DataFrame, policy=Offline, tokenizer=None, samples: bool | tuple[str, ...] = True, key: str = "doc_id", text: str = "text", each: tuple[str, ...] = (), **options) -> DataFrame:
    """A row per window of every text: ``key, chunk, start, size``, the policy's numbers, ``words, kinds`` and with ``samples`` ``places, outcomes, input_ids, labels``.

    ``terms(term, priority)`` is a folded lexicon of at most MOST_TERMS terms and
    64 MB, which is broadcast; ``tokenizer`` gives ids, offsets and word numbers
    (:class:`RegexTokenizer` where it is left out). ``input_ids`` and ``labels``
    have the special tokens around the window; the label of a chosen token is
    the id it had, also where it is kept, that of any other -100. ``samples``
    may also name the lists that are wanted, so that only these leave Python.
    Null and blank texts, and those too short for a window, have no rows;
    repeated rows have theirs each; rows with a null key take part. ``each``
    names arrays of ``docs`` with an entry for every window of their text; a
    window's row ends with its own.
    """
    tokenizer = tokenizer or RegexTokenizer()
    held = docs.sparkSession.sparkContext.broadcast((broadcast_terms(terms), tokenizer))
    lists = samples if isinstance(samples, tuple) else SAMPLES if samples else ("words", "kinds")
    types = {**dict.fromkeys(("chunk", "start", "size"), "int"), **{c: "double" if c in FRACTIONS else "int" for c in policy.numbers}, **{c: "array<long>" if c == "words" else "array<int>" for c in lists}}
    schema = docs.select(key).schema
    for name, kind in types.items():
        schema = schema.add(StructField(name, DataType.fromDDL(kind)))
    for name in each:
        schema = schema.add(name, docs.schema[name].dataType.elementType)
    read = bool({"input_ids", "labels"}.intersection(lists)) or policy.reads_tokens or bool(tokenizer.special_ids)
    bound_batches(docs.sparkSession)

    def run(batches):
        terms, tokens_of = held.value
        rules = policy(Lexicon(terms), tokens_of, **options)
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for rows in bunches(texts):
                found, n = together(tokens_of, [texts[i] for i in rows], read)
                counts = rules.windows(n)
                if not counts.any():
                    continue
                state = rules.documents([texts[i] for i in rows], found)
                first = np.cumsum(n) - n
                whole = getattr(rules, "whole_words", True)
                words = found.words if whole else np.arange(len(found.words))
                bounds = np.searchsorted(words, np.arange(int(words[-1]) + 2)) if whole else np.arange(len(words) + 1)
                chunk, doc = ranges(np.zeros(len(n), np.int64), counts)
                for at in range(0, len(doc), MOST_WINDOWS):
                    d, c = doc[at : at + MOST_WINDOWS], chunk[at : at + MOST_WINDOWS]
                    starts = first[d] + c * rules.stride
                    ends = np.minimum(starts + rules.width, first[d] + n[d])
                    w = Windows.over(words, starts, ends, [(names[rows[i]], j) for i, j in zip(d.tolist(), c.tolist(), strict=True)], words[first[d]] if whole else starts, bounds)
                    chosen, kind, numbers = rules.select(state, w)
                    row = np.array(rows)[d]
                    own = [x.values.take(pa.array(x.offsets.to_numpy()[row] + c)) for x in b.columns[2:]]
                    fixed = [b.column(0).take(pa.array(row)), c, starts - first[d], ends - starts, *numbers]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.astype(np.float64 if name in FRACTIONS else np.int32)) for name, x in zip(schema.names, fixed, strict=False)] + columns(rules, tokens_of, w, found.ids, chosen, kind) + own, names=schema.names)

    def columns(rules, tokens_of, w, ids, chosen, kind):
        made = {}
        counts = np.bincount(w.of[chosen], minlength=len(w.starts))
        made["words"] = counts, (w.word[chosen] - w.before[w.of[chosen]]), pa.int64()
        made["kinds"] = counts, kind, pa.int32()
        if not {"words", "kinds"}.issuperset(lists):
            at, of, out, put = replaced(rules, tokens_of, w, chosen, kind, ids)
            counts = np.bincount(of, minlength=len(w.starts))
            made["places"] = counts, at - w.starts[of], pa.int32()
            made["outcomes"] = counts, out, pa.int32()
            if {"input_ids", "labels"}.intersection(lists):
                sizes = w.ends - w.starts
                token, window = ranges(w.starts, sizes)
                to = np.arange(len(token)) + 2 * window + 1
                given, labels = np.empty(len(token) + 2 * len(sizes), np.int64), np.full(len(token) + 2 * len(sizes), IGNORED)
                given[to] = ids[token]
                past = np.cumsum(sizes + 2)
                given[past - sizes - 2], given[past - 1] = tokens_of.around
                there = at - w.starts[of] + (past - sizes - 1)[of]
                labels[there], given[there] = ids[at], put
                made["input_ids"], made["labels"] = (sizes + 2, given, pa.int32()), (sizes + 2, labels, pa.int32())
        return [pa.ListArray.from_arrays(np.cumsum([0, *made[c][0]]).astype(np.int32), pa.array(made[c][1], made[c][2])) for c in lists]

    return docs.select(key, text, *each).mapInArrow(run, schema)
