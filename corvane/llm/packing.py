"""Best-fit-decreasing packing with certified bounds and exchange between partitions.

Documents become pieces of at most ``capacity`` tokens. Pieces that fill a
sequence stand alone; the others are dealt over groups by hash, and each group
is packed by best-fit decreasing. Dual feasible functions give lower bounds on
the sequences of a group and of all groups together; once the groups' total
meets the latter, all is final. Until then groups exchange: one that misses its
own bound gives the pieces of every sequence with a gap to a pool, and one that
meets it, which cannot pack its own pieces better, only those of sequences with
room for pieces of others. The pool is dealt anew over groups twice as large
and packed again; the exchange stands where it saves sequences, and goes on
until nothing is left to certify or to save.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import batch, take
from corvane.llm.bpe_automaton import Tokenizer, byte_letters
from corvane.storage import drop, materialize

GROUP = 40_000  # pieces a group, so that one packs in a few seconds and some megabytes


LONG_RUN = regex.compile(r"\p{White_Space}{4096,}")


class Encoder:
    """The byte-level BPE of a tokenizers file, by tiktoken. Ranks are ids, which holds where ids follow merge order.

    The split's look-ahead runs out of stack on very long white space, so such
    a run is a part of its own: all of it but the last character, which begins
    what follows, or the whole run where the text ends with it.
    """

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level BPE files are supported")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        vocab = model["vocab"]
        made = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("ids must follow merge order")
        ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items() if k not in self.added}
        self.ranks = ranks
        self.words = tiktoken.Encoding("words", pat_str=Tokenizer.BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def whole(self) -> tiktoken.Encoding:
        """For long runs only, which few workers meet: it holds the vocabulary once more."""
        return tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})

    def _plain(self, text: str) -> list[int]:
        if len(text) < 4096:
            return self.words.encode_ordinary(text)
        out, at = [], 0
        for m in LONG_RUN.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.words.encode_ordinary(text[at : m.start()])
            out += self.whole.encode_ordinary(text[m.start() : end])
            at = end
        return out + self.words.encode_ordinary(text[at:])

    def encode(self, text: str) -> list[int]:
        if self.added_split is None or not any(a in text for a in self.added):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.added_split.split(text)):
            out += [self.added[part]] if i % 2 else self._plain(part)
        return out


PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("uid", pa.int64())])
_ENCODINGS: dict[str, Encoder] = {}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole ones of ``capacity``, the first perhaps shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every whole text: ``key, piece, start, length, ids_crc32, uid``; null counts as empty, so that each row has a piece. ``uid`` tells pieces apart even where keys repeat."""
    with open(path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # of the vocabulary's size
    schema = docs.select(key).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("uid", "long")

    def run(batches):
        import hashlib
        import json

        text_of = held.value
        k = hashlib.md5(text_of.encode(), usedforsecurity=False).hexdigest()
        if k not in _ENCODINGS:
            _ENCODINGS[k] = Encoder(json.loads(text_of))
        encoder = _ENCODINGS[k]
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            row, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                t = (t or "").encode("utf-8", "replace").decode()
                ids = encoder.encode(t)
                ids.append(end_id)
                data = memoryview(np.array(ids, "<u4")).cast("B")
                for p, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    out.append((p, s, n, zlib.crc32(data[4 * s : 4 * (s + n)]), uid))
                    uid += 1
            tail = batch(PIECES, *(zip(*out, strict=True) if out else [[]] * 5))
            yield pa.RecordBatch.from_arrays([take(b.column(0), row), *tail.columns], names=schema.names)

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of every size: largest first, each into the fullest bin that still takes it."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    mask, made = 0, 0  # bit r is set where a bin has room r
    for i in order.tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, at, made = capacity, made, made + 1
        bins[i], offsets[i] = at, capacity - room
        if room > size:
            open_bins[room - size].append(at)
            mask |= 1 << (room - size)
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences that ``counts[s]`` pieces of each size s can need, by three families of dual feasible functions."""
    sizes = np.flatnonzero(counts)
    n = counts[sizes].astype(np.int64)
    if not len(sizes):
        return 0
    best = -(-int((sizes * n).sum()) // capacity)
    for k in range(1, 21):  # rounding down to parts of 1/(k+1), whole parts kept as they are
        x = sizes * (k + 1)
        exact = x % capacity == 0
        # in units of 1/(k * capacity): sizes on a part keep their value, others get floor(x/capacity)/k
        value = np.where(exact, sizes * k, (x // capacity) * capacity)
        best = max(best, -(-int((value * n).sum()) // (capacity * k)))
    for e in np.unique(np.minimum(sizes, capacity - sizes)):  # thresholds: above capacity-e counts whole, below e nothing
        if 0 < e <= capacity // 2:
            value = np.where(sizes > capacity - e, capacity, np.where(sizes >= e, sizes, 0))
            best = max(best, -(-int((value * n).sum()) // capacity))
    small = [e for e in np.unique(sizes) if 0 < e <= capacity // 3]
    for e in small[:: max(1, len(small) // 64)]:  # pieces of at least e share a bin with at most capacity // e of their kind
        most = capacity // e
        value = np.where(2 * sizes > capacity, most - (capacity - sizes) // e, np.where(2 * sizes == capacity, most / 2, np.where(sizes >= e, np.minimum(sizes // e, most // 2), 0)))
        best = max(best, int(np.ceil((value * n).sum() / most - 1e-9)))
    return best


PACKED = "uid long, length long, grp long, bin long, offset long, fill long, bins long, bound long"


def pack_groups(items: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """Pack ``items(uid, length)`` within ``groups`` groups by hash; each row tells its group's number of bins and lower bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        sizes = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return pdf.assign(bin=bins, offset=offsets, fill=fill[bins], bins=len(fill), bound=bound)[["uid", "length", "grp", "bin", "offset", "fill", "bins", "bound"]]

    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInPandas(run, PACKED)


def pack(pieces: DataFrame, capacity: int = 1024, group: int = GROUP, rounds: int = 8, patience: int = 2) -> DataFrame:
    """``uid, sequence_id, offset, group_gap`` of every piece in ``pieces(uid, length)``; lengths from 1 to ``capacity``.

    Every piece gets a place; an empty table gives an empty one. Sequence ids
    are unique and have no other meaning. ``group_gap`` says by how many
    sequences the piece's group exceeds its lower bound; 0 is a certificate.
    An exchange that saves nothing is taken back and tried with another deal;
    packing ends when all groups together meet the bound of their pool, after
    ``patience`` deals in a row that saved nothing, or after ``rounds``.
    """
    whole = pieces.where(F.col("length") == capacity).select("uid", (2 * F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("group_gap"))
    items = pieces.where(F.col("length") < capacity).select("uid", "length")
    n = items.count()
    done: list[DataFrame] = []
    kept, kept_made, failed = None, 0, 0
    for salt in range(rounds if n else 0):
        groups = max(1, -(-n // (group << min(salt, 4))))
        packed = materialize(pack_groups(items, groups, salt, capacity), "packed")
        made = packed.where("offset = 0").count()
        if kept is not None and made >= kept_made:
            drop(packed)
            failed += 1
            if failed == patience or groups == 1:  # a single group is packed alike by every deal
                break
            continue
        failed, gap = 0, F.when(F.col("bins") > F.col("bound"), capacity // 128).otherwise(capacity // 16)
        poor = F.col("fill") < capacity - gap
        if made <= bound(packed, capacity) or not (left := packed.where(poor).count()):
            kept = _ids(packed, salt)
            break
        done.append(_ids(packed.where(~poor), salt))
        kept = _ids(packed.where(poor), salt)
        kept_made = kept.where("offset = 0").count()
        items, n = packed.where(poor).select("uid", "length"), left
    out = whole
    for part in done + ([kept] if kept is not None else []):
        out = out.unionByName(part.select("uid", "sequence_id", "offset", (F.col("bins") - F.col("bound")).alias("group_gap")))
    return out


def _ids(packed: DataFrame, salt: int) -> DataFrame:
    """Odd ids, which those of whole pieces are not: round, group and bin in fields of their own."""
    return packed.withColumn("sequence_id", ((F.lit(salt).cast("long") * (1 << 24) + F.col("grp")) * (1 << 32) + F.col("bin")) * 2 + 1)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset, group_gap``.

    A null text counts as empty and gives a piece of the end id alone; repeated
    rows and null keys have pieces of their own; other columns are not read;
    an empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, path, capacity, end_id, key, text), "pieces")
    places = pack(pieces, capacity, group)
    return pieces.join(places, "uid").select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "group_gap")


def bound(pieces: DataFrame, capacity: int = 1024) -> int:
    """The lower bound for a whole table of ``length``, from its histogram of at most ``capacity`` rows."""
    rows: Iterable = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows:
        counts[r["length"]] = r["n"]
    return lower_bound(counts, capacity)
