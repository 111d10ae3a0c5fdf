"""Tokeniser: words are runs of non-space, tokens letters, digits or single marks within them.

Offsets are running sums within a text, for which Spark has no expression that
is linear in the text; a window would shuffle and sort every token of the
corpus. So texts are cut in Arrow batches where they are read, without a shuffle,
many texts at a time: a token is a run of characters of one class.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.digests import text_md5
from corvane.storage import bound_batches

TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"
_WHITE = " \t\n\v\f\r"  # the JVM's \s is ASCII white space only
MOST_CHARS = 1 << 18  # characters to cut at once, unless one text has more


@functools.cache
def _classes() -> np.ndarray:
    """The class of every character: 0 white, 1 letters and marks, 2 numbers, 3 any other."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), 3, np.uint8)
    for kind, pattern in ((1, r"[\p{L}\p{M}]+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    kinds[[ord(c) for c in _WHITE]] = 0
    return kinds


def bunches(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of the texts that are not empty, in lists of about MOST_CHARS characters."""
    some, n = [], 0
    for i, t in enumerate(texts):
        if t:
            some.append(i)
            n += len(t)
            if n >= MOST_CHARS:
                yield some
                some, n = [], 0
    if some:
        yield some


@dataclass(frozen=True)
class Cut:
    """The tokens of texts joined by line breaks: offsets and word numbers in the joined text, and where each text starts in it."""

    text: str
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Cut:
        text = "\n".join(texts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _classes()[codes]
        edge = np.ones(len(kinds) + 1, bool)
        np.not_equal(kinds[1:], kinds[:-1], out=edge[1:-1])
        single = kinds == 3
        edge[:-1] |= single
        edge[1:] |= single
        token = kinds != 0
        starts, ends = np.flatnonzero(edge[:-1] & token), np.flatnonzero(edge[1:] & token) + 1
        fresh = np.ones(len(starts), bool)
        np.not_equal(starts[1:], ends[:-1], out=fresh[1:])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return cls(text, np.cumsum(sizes + 1) - sizes - 1, starts, ends, np.cumsum(fresh) - 1, codes)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The first token of every text, and how many it has."""
        first = np.searchsorted(self.starts, self.at)
        return first, np.diff(first, append=len(self.starts))

    def strings(self) -> pa.Array:
        """The tokens themselves: what is left of the text without white space, cut anew."""
        width = 1 + (self.codes > 0x7F) + (self.codes > 0x7FF).astype(np.int64) + (self.codes > 0xFFFF)
        past = np.concatenate([[0], np.cumsum(np.where(_classes()[self.codes] == 0, 0, width))])
        offsets = np.concatenate([past[:1], past[self.ends]])
        data = self.text.encode("utf-8", "surrogatepass").translate(None, _WHITE.encode())
        kind, size = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
        return pa.Array.from_buffers(kind, len(self.ends), [None, pa.py_buffer(offsets.astype(size)), pa.py_buffer(data)])


@dataclass(frozen=True)
class Tokens:
    """A text's tokens: ids, character offsets (ends exclusive) and word numbers, which count up from 0."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    strings: list[str] | pa.DictionaryArray | None = None


class RegexTokenizer:
    """The tokens of :data:`TOKEN` with ids of their own.

    There is no vocabulary: an id is a keyed hash of the token, above the
    special ids 0 to 4, so different tokens can share one.
    """

    around, mask_id, special_ids = (0, 2), 4, frozenset()

    def __init__(self, vocabulary: int = 32_000):
        self.vocabulary = vocabulary

    def __call__(self, text: str) -> Tokens:
        found = self.together([text])
        return Tokens(found.ids, found.starts, found.ends, found.words, found.strings.to_pylist())

    def together(self, texts: list[str], ids: bool = True) -> Tokens:
        """The tokens of texts joined by line breaks, by places in the joined text; each distinct token is hashed once, none without ``ids``."""
        cut = Cut.of(texts)
        if not ids:
            return Tokens(np.zeros(len(cut.starts), np.int64), cut.starts, cut.ends, cut.words)
        strings = cut.strings().dictionary_encode()
        _, offsets, data = strings.dictionary.cast(pa.large_string()).buffers()
        data, offsets = np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets or bytes(8), np.int64)[: len(strings.dictionary) + 1]
        ids = 5 + (text_md5(b"id|", data, offsets)[:, 0] / 4294967296.0 * (self.vocabulary - 5)).astype(np.int64)
        return Tokens(ids[strings.indices.to_numpy()], cut.starts, cut.ends, cut.words, strings)

    def protected(self, tokens: Iterable[str]):
        """A test that tells which of a text's tokens are among ``tokens``."""
        known = pa.array(sorted(set(tokens)), pa.string())

        def test(found: Tokens) -> np.ndarray:
            strings = found.strings if isinstance(found.strings, pa.DictionaryArray) else pa.array(found.strings, pa.string()).dictionary_encode()
            return np.asarray(pc.is_in(strings.dictionary.cast(pa.string()), known))[strings.indices.to_numpy()]

        return test


def together(tokenizer, texts: list[str], ids: bool = True) -> tuple[Tokens, np.ndarray]:
    """The tokens of all ``texts``, with places and words counted on from text to text, and how many each has; ids and strings may be left out without ``ids``."""
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if hasattr(tokenizer, "together"):
        found = tokenizer.together(texts, ids)
        return found, np.diff(np.searchsorted(found.starts, at))
    each = [tokenizer(t) for t in texts]
    words = np.cumsum([0, *(int(x.words[-1]) + 1 if len(x.words) else 0 for x in each)])
    ids, starts, ends, numbers = (np.concatenate(c) for c in zip(*((x.ids, x.starts + a, x.ends + a, x.words + w) for x, a, w in zip(each, at, words)), strict=True))
    strings = [s for x in each for s in x.strings] if all(x.strings is not None for x in each) else None
    return Tokens(ids, starts, ends, numbers, strings), np.array([len(x.ids) for x in each])


class LibraryTokenizer:
    """A tokenizers file: its ids, offsets and words. Tokens without a word continue the one before."""

    def __init__(self, path: str, first: str, last: str, mask: str):
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        inner = self._load()
        self.around = inner.token_to_id(first), inner.token_to_id(last)
        self.mask_id, self.vocabulary = inner.token_to_id(mask), inner.get_vocab_size()
        if None in (*self.around, self.mask_id):
            raise ValueError("the vocabulary lacks one of the special tokens")
        self.special_ids = frozenset({*self.around, self.mask_id})

    def _load(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.text)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_inner"}

    def __call__(self, text: str) -> Tokens:
        if not hasattr(self, "_inner"):
            self._inner = self._load()
        found = self._inner.encode(text, add_special_tokens=False)
        offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        words = np.maximum.accumulate(np.maximum(words, 0)) if len(words) else words
        if len(words):  # numbered without gaps
            words = np.cumsum(np.concatenate([[0], words[1:] != words[:-1]]))
        return Tokens(np.array(found.ids, np.int64), offsets[:, 0], offsets[:, 1], words)

    def protected(self, tokens: Iterable[str]):
        """A test that tells which tokens have the id of one of ``tokens`` that is a single token."""
        single = [x.ids[0] for x in (self._load().encode(t, add_special_tokens=False) for t in tokens) if len(x.ids) == 1]
        return lambda found: np.isin(found.ids, single)


def with_count(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` of every text and its number of tokens ``n``, without the text."""
    schema = docs.select(*keys).schema.add("n", "integer")

    def run(batches):
        for b in batches:
            texts, n = b.column(len(keys)).to_pylist(), np.zeros(b.num_rows, np.int32)
            for rows in bunches(texts):
                n[rows] = Cut.of([texts[i] for i in rows]).counts()[1]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(n)], names=schema.names)

    bound_batches(docs.sparkSession)
    return docs.select(*keys, text).mapInArrow(run, schema)


def token_count(c):
    return F.size(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)))


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, start_at, end_at, word_id, token`` with end-exclusive character offsets; null and blank texts have no rows."""
    schema = docs.select(key).schema
    for name in ("pos", "start_at", "end_at", "word_id"):
        schema = schema.add(name, "long")
    schema = schema.add("token", "string")

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for rows in bunches(texts):
                cut = Cut.of([texts[i] for i in rows])
                first, n = cut.counts()
                if not n.any():
                    continue
                began = np.repeat(first, n)
                at = np.repeat(cut.at, n)
                columns = [np.arange(len(began)) - began, cut.starts - at, cut.ends - at, cut.words - cut.words[began]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(rows, n))), *(pa.array(c, pa.int64()) for c in columns), cut.strings().cast(pa.string())], names=schema.names)

    bound_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
