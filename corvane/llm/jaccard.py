"""Exact Jaccard self-join on word shingles, size-aware and heavy-light.

Equal sets collapse into one class. Small sets enumerate the fixed-size subsets
that a partner must share; larger sets scan inverted lists of their prefixes.
The boundary between the two is where enumerating costs as much as scanning.

A set of n shingles has a prefix of n - ceil(t n) + 1; two sets that reach the
threshold t share a shingle of their prefixes under any common order. The order
puts shingles that head many lists (heavy ones) last, so a passage that many
documents share stays out of the lists of documents that are otherwise their
own; a document keeps heavy shingles in its prefix only where it has nothing
else, that is within a group of near copies. Heavy lists are split by salt.
Which shingles are heavy is counted on prefixes with a margin, since light
shingles move up where heavy ones leave; so no light list grows long by chance,
which would make one cluster of documents that have little in common.

Only lists of bounded length are expanded into pairs, at first common shingles
and where sketches leave a link possible. Members of a longer list are first
compared with one member, its hub. What those links connect needs no further
comparison; the lists that still hold several components form clusters, which
are cut by set size and compared in blocks that return spanning forests of
their links. Links are counted on whole sets, so the result is exact up to
64-bit hash collisions of shingles. Sets go by 64 bits of a 128-bit id; where
two sets share these, both go by the other half.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import batch, byte_view, take
from corvane.llm.shingles import mix, shingle_set, words_of
from corvane.operators.components import Forest, connected_components
from corvane.operators.skew import join_hot
from corvane.storage import drop, materialize

MOST_ENUMERATED = 13  # sets up to this size have one shingle to spare, so n + 1 subsets
MOST_HEAVY = 2_000_000  # heavy shingles are broadcast, 8 bytes each
MOST_PAIRED = 64  # longest list whose pairs are all formed: at most half as many pairs as this for each entry
BLOCK = 512
SALTS = 32
FILTER_BITS = 26, 29  # smallest and largest size of the filter on candidate sets, as powers of two; a full one lets more through
_SUBSET = np.uint64(0x2545F4914F6CDD1D)


def needed(n: int, percent: int) -> int:
    """Fewest shingles that a set of n shares with a partner."""
    return -(-percent * n // 100)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def counted(n: int, percent: int) -> int:
    """Length of a prefix by hash with a margin for the shingles that move up where heavy ones leave."""
    size = n - needed(n, percent) + 1
    return min(n, size + max(2, size // 4))


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return _signed(h & (1 << 64) - 1), _signed(h >> 64)


def name_of(shingles: np.ndarray, clash: frozenset[int]) -> int:
    """What a set goes by: the first half of its id, or the second where another set shares the first."""
    a, b = set_id(shingles)
    return b if a in clash else a


def subsets(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the subsets of a small set that a partner may share: itself, and with one to spare those without one member."""
    n, parts = len(shingles), mix(shingles + _SUBSET)
    total = parts.sum(dtype=np.uint64, keepdims=True)
    out = [mix(total + _SUBSET * np.uint64(n))]
    if needed(n, percent) < n:
        out.append(mix(total - parts + _SUBSET * np.uint64(n - 1)))
    return np.concatenate(out)


def prefix(shingles: np.ndarray, percent: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(shingles, whether heavy)`` of the prefix, in order: light ones by hash, then heavy ones by hash."""
    n = len(shingles)
    size = n - needed(n, percent) + 1
    if not len(heavy):
        return shingles[:size], np.zeros(size, bool)
    at = np.searchsorted(heavy, shingles)
    at[at == len(heavy)] = 0
    is_heavy = heavy[at] == shingles
    light = shingles[~is_heavy][:size]
    rest = shingles[is_heavy][: size - len(light)]
    return np.concatenate([light, rest]), np.concatenate([np.zeros(len(light), bool), np.ones(len(rest), bool)])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Members by the hash's leading bits, in a power of two of buckets with about 8 each; counts that 16 bits cannot hold stand as their largest value."""
    bits = min(max(len(shingles) // 8, 16).bit_length() - 1, 10)
    return np.minimum(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 65535).astype(np.uint16)


def most_common(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the common members of two sets, from their sketches."""
    a, b = (np.where(x == 65535, 1 << 40, x.astype(np.int64)) for x in (a, b))
    size = min(len(a), len(b))
    return int(np.minimum(a.reshape(size, -1).sum(1), b.reshape(size, -1).sum(1)).sum())


def boundary(percent: int, small_rows: int, small_lists: int) -> int:
    """Largest size at which sets are enumerated: the largest n, up to MOST_ENUMERATED, whose n + 1 subsets cost less than scanning its prefix's lists.

    Writing a row costs 1 and comparing with a list's member 4; lists of small
    sets have ``small_rows / small_lists`` members.
    """
    members = small_rows / max(1, small_lists)
    fit = [n for n in range(1, MOST_ENUMERATED + 1) if n - needed(n, percent) <= 1 and (n + 1 if needed(n, percent) < n else 1) <= (n - needed(n, percent) + 1) * (1 + 4 * (members - 1))]
    return max(fit, default=0)


SETS = pa.schema([("n_shingles", pa.int64()), ("sid", pa.int64()), ("sid2", pa.int64()), ("sketch", pa.binary()), ("tokens", pa.list_(pa.int64()))])
ENTRIES = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("sid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema)


def _sets(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """A row per document: key, set size, 128-bit set id, and the counted prefix by hash alone."""

    def run(batches):
        for b in batches:
            data, offsets, _ = byte_view(b.column(1))
            n, a, c, sketches, tokens = [], [], [], [], []
            for words in words_of(data, offsets):
                s = shingle_set(words, k)
                x, y = set_id(s)
                n.append(len(s))
                a.append(x)
                c.append(y)
                sketches.append(sketch(s).tobytes())
                tokens.append(s[: counted(len(s), percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), *batch(SETS, n, a, c, sketches, tokens).columns], names=[key, *SETS.names])

    ids = docs.select(key).schema.fields[0]
    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"`{key}` {ids.dataType.simpleString()}, n_shingles long, sid long, sid2 long, sketch binary, tokens array<long>")


def _entries(docs: DataFrame, text: str, k: int, percent: int, heavy: np.ndarray, small: int, clash: frozenset[int]) -> DataFrame:
    """Entries of inverted lists: each task lists a set once, whatever its copies."""
    held = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        heavy, seen = held.value, set()
        for b in batches:
            data, offsets, _ = byte_view(b.column(0))
            tokens, salts, sids, sizes, places = [], [], [], [], []
            for words in words_of(data, offsets):
                s = shingle_set(words, k)
                n = len(s)
                if not n or (sid := name_of(s, clash)) in seen:
                    continue
                seen.add(sid)
                if n <= small:
                    t = subsets(s, percent)
                    tokens.append(t)
                    salts.append(np.zeros(len(t), np.int32))
                    places.append(np.zeros(len(t), np.int32))
                if n > small or n >= needed(small + 1, percent):
                    t, h = prefix(s, percent, heavy)
                    tokens.append(t)
                    salts.append(np.where(h, 1 + sid % SALTS, 0).astype(np.int32))
                    places.append(np.arange(len(t), dtype=np.int32))
                while len(sids) < len(tokens):
                    sids.append(np.full(len(tokens[len(sids)]), sid, np.int64))
                    sizes.append(np.full(len(tokens[len(sizes)]), n, np.int32))
            if tokens:
                yield batch(ENTRIES, np.concatenate(tokens).view(np.int64), *map(np.concatenate, (salts, sids, sizes, places)))

    return docs.select(F.col(text).alias("text")).mapInArrow(run, _ddl(ENTRIES))


def _members(entries: DataFrame) -> DataFrame:
    """Entries of lists with at least two sets, each set once. Salted lists are kept whole. Lists pass as sorted streams, in constant memory."""

    def run(batches):
        row = np.dtype([("token", np.int64), ("salt", np.int32), ("sid", np.int64), ("n", np.int32), ("pos", np.int32)])
        waiting = np.zeros(0, row)  # the first row of the list that the last batch ended in, while no other set has followed
        last = None  # list and set of the row before
        for b in batches:
            rows = np.empty(b.num_rows, row)
            for name, column in zip(row.names, b.columns, strict=True):
                rows[name] = column.to_numpy()
            if not len(rows):
                continue
            same_list = np.zeros(len(rows), bool)
            same_list[1:] = (rows["token"][1:] == rows["token"][:-1]) & (rows["salt"][1:] == rows["salt"][:-1])
            same_set = np.zeros(len(rows), bool)
            same_set[1:] = same_list[1:] & (rows["sid"][1:] == rows["sid"][:-1])
            if last is not None:
                same_list[0] = (rows["token"][0], rows["salt"][0]) == (last["token"], last["salt"])
                same_set[0] = same_list[0] and rows["sid"][0] == last["sid"]
            last = rows[-1].copy()
            rows, same_list = rows[~same_set], same_list[~same_set]
            if not len(rows):
                continue
            # a first row is written when its list goes on, or is salted; one that a batch ends in waits
            goes_on = np.append(same_list[1:], False)
            keep = same_list | goes_on | (rows["salt"] > 0)
            out = [rows[keep]]
            if len(waiting) and same_list[0]:
                out.insert(0, waiting)
            waiting = rows[-1:][~keep[-1:]]
            out = np.concatenate(out)
            if len(out):
                yield batch(ENTRIES, *(np.ascontiguousarray(out[c]) for c in row.names))

    dealt = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "sid")
    return dealt.mapInArrow(run, _ddl(ENTRIES))


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Sizes and places of a first common shingle allow the threshold: what is left from there on is enough."""
    need = F.ceil((F.lit(percent) * (n1 + n2)) / F.lit(100 + percent))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= need)


def _candidate_sets(docs: DataFrame, text: str, k: int, wanted: DataFrame, clash: frozenset[int]) -> DataFrame:
    """``sid, shingles`` of every set whose id is in ``wanted``, and some others: a filter of bounded size goes to the scan."""
    least, most = FILTER_BITS
    power = min(most, max(least, (16 * wanted.count()).bit_length()))
    bit = F.pmod("sid", F.lit(1 << power))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    rows = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(1 << power - 6, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def run(batches):
        bits, seen = held.value, set()
        for b in batches:
            data, offsets, _ = byte_view(b.column(0))
            sids, sets = [], []
            for words in words_of(data, offsets):
                s = shingle_set(words, k)
                if not len(s):
                    continue
                sid = name_of(s, clash)
                at = sid % (1 << power)
                if int(bits[at >> 6]) >> (at & 63) & 1 and sid not in seen:
                    seen.add(sid)
                    sids.append(sid)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "shingles"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "sid long, shingles binary")
    return found.groupBy("sid").agg(F.first("shingles").alias("shingles"))


def _pairs_with(pairs: DataFrame, bodies: DataFrame, column: str, test) -> DataFrame:
    """The pairs whose two bodies, as numpy arrays, pass ``test``."""
    a = bodies.select(F.col("sid").alias("a"), F.col(column).alias("xa"))
    b = bodies.select(F.col("sid").alias("b"), F.col(column).alias("xb"))

    def run(batches):
        for t in batches:
            keep = [i for i, (x, y) in enumerate(zip(t.column(2), t.column(3), strict=True)) if test(x.as_buffer(), y.as_buffer())]
            yield pa.RecordBatch.from_arrays([take(t.column(i), keep) for i in (0, 1)], names=["a", "b"])

    return pairs.join(b, "b").join(a, "a").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b, n)``, n the sum of both sizes, that sketches do not rule out."""

    def test(x, y):
        x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
        n = int(x.sum(dtype=np.int64) + y.sum(dtype=np.int64))  # too small only where a count is cut off, which asks for less
        return most_common(x, y) * (100 + percent) >= percent * n

    return _pairs_with(pairs, sketches, "sketch", test)


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the threshold."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold, counted in full."""
    return _pairs_with(pairs, sets, "shingles", lambda x, y: reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))


def block_forest(sids: np.ndarray, sets: list[np.ndarray], own: np.ndarray, known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of two blocks, or within one; what is connected, or of the same ``known`` component, is not compared."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sids, sets, own, known = sids[order], [sets[i] for i in order], own[order], known[order]
    n = np.array([len(x) for x in sets])
    bits = 7
    sketches = np.stack([np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) for x in sets]).astype(np.int32)
    forest, edges, first = Forest(len(sets)), [], {}
    for i, c in enumerate(known.tolist()):
        forest.join(first.setdefault(c, i), i)
    same_block = len(np.unique(own)) == 1
    for i in range(len(sets)):
        end = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
        j = np.arange(i + 1, end)
        j = j[(known[j] != known[i]) & (same_block | (own[j] != own[i]))]
        if len(j):
            common = np.minimum(sketches[j], sketches[i]).sum(1)
            for k in j[common * (100 + percent) >= percent * (n[j] + n[i])].tolist():
                if forest.root(i) != forest.root(k) and reaches(sets[i], sets[k], percent):
                    forest.join(i, k)
                    edges.append((int(sids[i]), int(sids[k])))
    return edges


def _within_clusters(clusters: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Links enough to connect what is linked within ``clusters(id, component, n, known)``, by pairs of blocks.

    Members are cut into classes of size, the width of which is the ratio that
    two linked sets may have: blocks meet those of their own class and of the
    next ones only.
    """
    width = max(math.log(100 / percent), 0.01) * 1.000001
    dealt = clusters.withColumn("size", F.floor(F.log(F.col("n")) / width))
    blocks = dealt.groupBy("component", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    dealt = dealt.join(blocks, ["component", "size"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # a member of class c meets the classes c - 1, c and c + 1, where they are
    others = blocks.select("component", F.col("blocks").alias("theirs"), F.explode(F.array(*[F.struct((F.col("size") + d).alias("size"), F.lit(-d).alias("step")) for d in (-1, 0, 1)])).alias("at"))
    others = others.select("component", "theirs", "at.*")
    dealt = dealt.join(others, ["component", "size"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("theirs") - 1)))
    mine, yours = F.struct("size", F.col("own").alias("block")), F.struct((F.col("size") + F.col("step")).alias("size"), F.col("other").alias("block"))
    dealt = dealt.select("component", "id", "known", (F.col("size") * (1 << 40) + F.col("own")).alias("own"), F.least(mine, yours).alias("lo"), F.greatest(mine, yours).alias("hi"))
    rows = dealt.join(bodies, dealt.id == bodies.sid).select("component", "lo", "hi", "sid", "known", "own", "shingles")

    def run(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        edges = block_forest(t.column("sid").to_numpy(), sets, t.column("own").to_numpy(), t.column("known").to_numpy(), percent)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return rows.groupBy("component", "lo", "hi").applyInArrow(run, "a long, b long")


def _heavy(found: DataFrame, heavy_from: int) -> tuple[np.ndarray, int]:
    """Shingles that head at least ``heavy_from`` lists, sorted, and that number; it is raised where they would be more than MOST_HEAVY."""
    lists = found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    lists = materialize(lists.where(F.col("df") >= heavy_from), "heavy")
    left = 0
    for r in lists.groupBy("df").agg(F.count(F.lit(1)).alias("lists")).orderBy(F.desc("df")).collect():
        left += r["lists"]
        if left > MOST_HEAVY:
            heavy_from = r["df"] + 1
            break
    heavy = lists.where(F.col("df") >= heavy_from).select("token").toArrow()
    drop(lists)
    return np.sort(heavy.column("token").to_numpy().astype(np.int64).view(np.uint64)), heavy_from


def _classes(found: DataFrame, key: str) -> DataFrame:
    """A row per distinct set: its id, rows, smallest key and sketch, and the ends of the other halves of the ids that share ``sid``."""
    rows = found.where("n_shingles > 0").groupBy("sid")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.min("sid2").alias("lo"), F.max("sid2").alias("hi"), F.first("sketch").alias("sketch"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, heavy_from: int = 64) -> DataFrame:
    """``key, n_shingles, component_id`` of every row of ``docs``.

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of
    distinct ``words``-word shingles; ``component_id`` is the smallest key
    reachable by links. Texts of fewer words have their whole sequence as one
    shingle; null and wordless texts have empty sets and link with nothing.
    Rows with a null key take part but do not name components. Repeated rows
    are copies of each other; other columns are not read; an empty table gives
    an empty one.
    """
    found = written = materialize(_sets(docs, key, text, words, percent), "sets")
    classes = materialize(_classes(found, key), "classes")
    # about 3 at 10 ** 10 distinct sets, since chance alone makes ids agree
    clash = frozenset(r["sid"] for r in classes.where("lo != hi").select("sid").collect())
    if clash:
        found = found.withColumn("sid", F.when(F.col("sid").isin(*clash), F.col("sid2")).otherwise(F.col("sid")))
        drop(classes)
        classes = materialize(_classes(found, key), "classes")
        if classes.where("lo != hi").limit(1).count():
            raise ValueError("two sets share both halves of their ids with others")
    sets = materialize(found.select(key, "n_shingles", "sid"), "sizes")
    sketches = classes.select("sid", "sketch")
    full = sets.where("n_shingles > 0").count()
    heavy, bound = _heavy(found, heavy_from)
    paired = bound if bound > heavy_from else MOST_PAIRED  # light lists are paired in full, so they never form clusters
    first = F.slice("tokens", 1, (F.col("n_shingles") - F.ceil(F.lit(percent) * F.col("n_shingles") / 100) + 1).cast("int"))
    cost = found.where(F.col("n_shingles").between(1, MOST_ENUMERATED)).select(F.explode(first).alias("token"))
    cost = cost.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("token").alias("lists")).first()
    small = boundary(percent, cost["rows"], cost["lists"])
    drop(written)

    members = materialize(_members(_entries(docs, text, words, percent, heavy, small, clash)), "members")
    length = members.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("sid", "n", "pos")).alias("hub"))
    length = materialize(length.where("df > 1"), "lengths")
    lists = materialize(join_hot(members, length, ["token"], "df", length.agg(F.sum("df").alias("n")).first()["n"] or 0), "lists")
    drop(members, length)
    # short lists: every pair that may link at its first common shingle
    x, y = (lists.where(F.col("df") <= paired).select("token", *[F.col(c).alias(f"{c}{i}") for c in ("sid", "n", "pos")]) for i in (1, 2))
    pairs = x.join(y, "token").where((F.col("sid1") < F.col("sid2")) & _may_link(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"), percent))
    # long lists: every member with the hub
    long = lists.where(F.col("df") > paired)
    star = long.where((F.col("sid") != F.col("hub.sid")) & _may_link(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent))
    pairs = pairs.select(F.col("sid1").alias("a"), F.col("sid2").alias("b")).union(star.select(F.col("hub.sid").alias("a"), F.col("sid").alias("b"))).distinct()
    maybe = materialize(_possible(pairs, sketches, percent), "pairs")
    wanted = materialize(maybe.select(F.explode(F.array("a", "b")).alias("sid")).union(long.select("sid")).distinct(), "wanted")
    bodies = materialize(_candidate_sets(docs, text, words, wanted, clash), "bodies")
    linked = materialize(_linked(maybe, bodies, percent), "links")
    groups = connected_components(linked)
    drop(maybe, wanted)
    # long lists that still hold several components form clusters
    placed = long.select("token", "sid", "n", F.col("hub.sid").alias("hub")).join(groups.select(F.col("id").alias("sid"), "component"), "sid", "left").withColumn("known", F.coalesce("component", "sid"))
    all_placed = materialize(placed, "placed")
    tokens = materialize(all_placed.groupBy("token").agg(F.min("known").alias("lo"), F.max("known").alias("hi"), F.count(F.lit(1)).alias("df")), "tokens")
    mixed = join_hot(all_placed, tokens.where("lo != hi"), ["token"], "df", tokens.agg(F.sum("df").alias("n")).first()["n"] or 0)
    placed = materialize(mixed.select("sid", "n", "known", "hub"), "mixed")
    drop(all_placed, tokens)
    clusters = connected_components(placed.where("sid != hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")))
    clusters = clusters.join(placed.select(F.col("sid").alias("id"), "n", "known").distinct(), "id")
    links = materialize(_within_clusters(clusters, bodies, percent), "links")
    if links.limit(1).count():
        drop(groups)
        groups = connected_components(linked.union(links))
    drop(lists, placed, bodies, linked, links)

    # classes of equal sets, then groups of classes, carry the smallest key
    grouped = classes.join(groups, classes.sid == groups.id, "left").select("sid", "rows", "first", F.coalesce("component", "sid").alias("grp"))
    grouped = materialize(grouped, "grouped")
    names = materialize(grouped.groupBy("grp").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("sets")), "names")
    named = materialize(join_hot(grouped, names, ["grp"], "sets", classes.count()).select("sid", "rows", "component_id"), "named")
    drop(classes, grouped, names, groups)
    full = join_hot(sets.where("n_shingles > 0"), named, ["sid"], "rows", full)
    full = full.select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))
    return full.unionByName(sets.where("n_shingles = 0").select(key, "n_shingles", F.col(key).alias("component_id")))
