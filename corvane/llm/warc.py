"""WARC archives with an external, globally ordered capture index.

Writing: each task writes archives of gzip-compressed records and, next to each
archive, an index run sorted by URL key and time. Merging: a loser tree merges
up to ``FAN_IN`` runs as streams, in as many passes as that takes, so memory
holds one line per run. The first pass merges whole runs; every later one also
cuts the key range of its inputs into up to ``FAN_IN`` parts, at keys drawn
from all runs, so that tasks and files stay as many as after the first pass and
of like size. Reading: the merged index tells where each record lies; archives
are read front to back, a few to a task, and digests are checked.

Files are written through ``pyarrow.fs`` to the shared folder under names that
no other attempt uses; only what a finished task reports is read again.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.skew import checked_broadcast
from corvane.storage import materialize, new_path

FAN_IN = 64
MOST_RANGES = 50_000  # beyond it ranges grow; about 16 keys a range are drawn to the driver
MOST_TASKS = 20_000
SPARSE = 256  # lines between entries of a run's own index
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort key of a URL: the host's labels from last to first, then the rest, lower-cased; empty for null."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    key = ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:].partition("#")[0]
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in key.lower())


def _header(url: str | None) -> str:
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")


def record(page_id: int | None, url: str | None, date: str, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """``(record, payload digest)``: a response, or a revisit of the page ``refers_to`` without its payload."""
    digest = payload_digest(payload)
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + payload if refers_to is None else HTTP
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Target-URI: {_header(url)}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """A record's fields; raises where lengths or digest do not fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and payload_digest(payload) != digest:
        raise ValueError("a payload differs from its digest")
    number = lambda k: int(fields[k].removeprefix("<urn:page:").rstrip(">")) if k in fields else None
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload}


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so a step replays one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = len(runs)
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i, fill=True)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or (a is not None and (a, i) < (b, j))

    def _play(self, winner: int, fill: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.tree[node]
            if fill and other < 0:
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[winner := self.tree[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _line(key: tuple[str, str, int], rest: tuple) -> bytes:
    return "\t".join(map(str, (*key, *rest))).encode() + b"\n"


def _key(line: bytes) -> tuple[str, str, int]:
    a, b, c, _ = line.decode().split("\t", 3)
    return a, b, int(c)


def _write_run(uri: str, lines: Iterator[tuple[tuple, bytes]]) -> tuple[int, list[str]]:
    """Write sorted index lines and, beside them, where every ``SPARSE``-th starts; returns the count and some keys, evenly spread."""
    fs, path = _fs(uri)
    sparse, at, n = [], 0, 0
    with fs.open_output_stream(path) as out:
        for key, line in lines:
            if n % SPARSE == 0:
                sparse.append((key, at))
            out.write(line)
            at += len(line)
            n += 1
    with fs.open_output_stream(path + ".at") as out:
        for key, where in sparse:
            out.write(_line(key, (where,)))
    return n, ["\t".join(map(str, k)) for k, _ in sparse[:: max(1, len(sparse) // 16)]]


def _read_run(uri: str, low: tuple | None, high: tuple | None) -> Iterator[tuple[tuple, bytes]]:
    """Lines of a run with low <= key < high, read as a stream."""
    fs, path = _fs(uri)
    with fs.open_input_stream(path + ".at") as f:
        marks = [(_key(x), int(x.rsplit(b"\t", 1)[1])) for x in f.readall().splitlines()]
    if not marks:
        return
    at = max(0, bisect.bisect_left(marks, low, key=lambda m: m[0]) - 1) if low else 0
    with fs.open_input_file(path) as f:
        f.seek(marks[at][1])
        rest = b""
        while True:
            block = f.read(1 << 16)
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                key = _key(line)
                if high and key >= high:
                    return
                if not low or key >= low:
                    yield key, line + b"\n"
            if not block:
                return


MANIFEST = "archive string, run string, records long, bytes long, keys array<string>"


def write_archives(pages: DataFrame, archive_bytes: int = 64 << 20, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives; returns their manifest, a row per archive and index run.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the smallest
    page_id is the response and the others revisit it. A null html is an empty
    payload. Rows with a null page_id are always responses; rows that repeat
    both page_id and payload are so alike that all of them are the response.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("size"))
    ids = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= min_revisit_bytes)).select("page_id", "sha1", "size")
    first = ids.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # written first: where it is too large to broadcast, a hot payload's pages can then be split over tasks
    first = checked_broadcast(materialize(first, "payloads"), 500_000)
    refers_to = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    dealt = rows.join(first, ["sha1", "size"], "left").select("page_id", "url", "html", refers_to.alias("refers_to"))
    base = new_path(spark, "archives")
    fs_base = base

    def write(batches):
        # 2020-01-01 and a microsecond for each page number: the table has no capture time of its own
        import datetime

        start = datetime.datetime(2020, 1, 1)
        state: dict = {"out": None}

        def close():
            if state["out"] is None:
                return
            state["out"].close()
            state["entries"].sort()
            n, keys = _write_run(state["run"], iter(state["entries"]))
            state["out"] = None
            yield pa.RecordBatch.from_pydict({"archive": [state["uri"]], "run": [state["run"]], "records": [n], "bytes": [state["at"]], "keys": [keys]}, schema=pa.schema([("archive", pa.string()), ("run", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("keys", pa.list_(pa.string()))]))

        for b in batches:
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state["out"] is None:
                    name = f"{fs_base}/{uuid.uuid4().hex}"
                    fs, path = _fs(name + ".warc.gz")
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    state.update(out=fs.open_output_stream(path, compression=None, buffer_size=1 << 20), uri=name + ".warc.gz", run=name + ".run", at=0, entries=[])
                date = (start + datetime.timedelta(microseconds=(page_id or 0) % (1 << 57))).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
                data, _ = record(page_id, url, date, text.encode(), refers_to)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                state["out"].write(member)
                key = url_key(url), date, -1 if page_id is None else page_id
                state["entries"].append((key, _line(key, (state["uri"], state["at"], len(member)))))
                state["at"] += len(member)
                if state["at"] >= archive_bytes:
                    yield from close()
        yield from close()

    return materialize(dealt.mapInArrow(write, MANIFEST), "manifest")


INDEX = "url_key string, captured string, page_id long, archive string, offset long, length long, key_range int, position long"


def _splits(manifest: DataFrame, ranges: int, runs: int) -> list[tuple]:
    """Keys that cut the captures into about ``ranges`` ranges of like size."""
    if ranges < 2:
        return []
    keys = manifest.select(F.explode("keys").alias("key"))
    share = min(1.0, 16 * ranges / max(1, 17 * runs))
    drawn = sorted(_key(r["key"].encode() + b"\t") for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(share * (1 << 30))).collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def merge_index(manifest: DataFrame, range_records: int = 100_000, fan_in: int = FAN_IN) -> DataFrame:
    """The global index: every capture with its place in order, ``(key_range, position)``; runs are merged by loser trees.

    Ranges hold about ``range_records`` captures, or more where that would make
    over MOST_RANGES of them. An empty manifest gives an empty index.
    """
    spark = manifest.sparkSession
    total = manifest.agg(F.sum("records").alias("n"), F.count(F.lit(1)).alias("runs")).first()
    n, runs = total["n"] or 0, total["runs"]
    splits = _splits(manifest, min(MOST_RANGES, max(1, -(-n // range_records))), runs)
    edges = spark.sparkContext.broadcast([None, *splits, None])  # at most MOST_RANGES keys
    ranges, base = len(splits) + 1, new_path(spark, "runs")
    width, first = ranges, True  # every run covers ``width`` ranges from ``low`` on
    pieces = manifest.select("run", F.lit(0).alias("low"))

    def bounds(low: int, width: int) -> tuple[tuple | None, tuple | None]:
        return edges.value[low], edges.value[min(low + width, ranges)]

    def cut(rows: DataFrame, width: int, narrow: int) -> DataFrame:
        """A row for each part of ``narrow`` ranges that a run has."""
        if narrow == width:
            return rows
        low = F.explode(F.sequence(F.col("low"), F.least(F.col("low") + (width - 1), F.lit(ranges - 1)), F.lit(narrow)))
        return rows.select("run", low.alias("low"))

    while runs > fan_in:
        groups, narrow = -(-runs // fan_in), width if first else -(-width // fan_in)
        dealt = cut(pieces, width, narrow).withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(groups)))
        tasks = min(MOST_TASKS, groups * -(-ranges // narrow))  # counted, since the rows do not show how much they stand for
        dealt = dealt.repartition(tasks, "low", "grp").groupBy("low", "grp").agg(F.sort_array(F.collect_list("run")).alias("runs"))  # of about fan_in runs each

        def combine(batches, narrow=narrow):
            for b in batches:
                for low, paths in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    name = f"{base}/{uuid.uuid4().hex}.run"
                    fs, path = _fs(name)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    _write_run(name, iter(LoserTree([_read_run(p, *bounds(low, narrow)) for p in paths])))
                    yield pa.RecordBatch.from_pydict({"run": [name], "low": [low]}, schema=pa.schema([("run", pa.string()), ("low", pa.int32())]))

        pieces = materialize(dealt.mapInArrow(combine, "run string, low int"), "runs")
        runs, width, first = groups, narrow, False
    last = cut(pieces, width, 1).repartition(min(MOST_TASKS, ranges), "low").groupBy("low").agg(F.sort_array(F.collect_list("run")).alias("runs"))

    def final(batches):
        names = [x.split()[0] for x in INDEX.split(", ")]
        for b in batches:
            for r, paths in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []

                def out(rows=rows):
                    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=names)

                for position, (key, line) in enumerate(LoserTree([_read_run(p, *bounds(r, 1)) for p in paths])):
                    archive, at, size = line.decode().rstrip("\n").split("\t")[3:]
                    rows.append((*key[:2], None if key[2] < 0 else key[2], archive, int(at), int(size), r, position))
                    if len(rows) == 8192:
                        yield out()
                        rows.clear()
                if rows:
                    yield out()

    return last.mapInArrow(final, INDEX)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, key_range int, position long"


def read_archives(index: DataFrame, with_payload: bool = False, archives: int | None = None) -> DataFrame:
    """The record at every place of ``index``, digests checked; with ``with_payload`` its bytes too (null for revisits).

    ``archives`` says how many there are, which sets the number of tasks; an
    empty index gives no records.
    """
    tasks = [min(MOST_TASKS, max(1, archives))] if archives is not None else []
    near = index.repartition(*tasks, "archive").sortWithinPartitions("archive", "offset")
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def read(batches):
        opened, f = None, None
        for b in batches:
            rows, size = [], 0
            for row in b.to_pylist():
                if row["archive"] != opened:
                    if f:
                        f.close()
                    fs, path = _fs(row["archive"])
                    opened, f = row["archive"], fs.open_input_file(path)
                f.seek(row["offset"])
                got = parse(zlib.decompress(f.read(row["length"]), 31))
                if got["record_type"] == "revisit":
                    got["payload"] = None
                rows.append({**{k: row[k] for k in ("url_key", "captured", "key_range", "position")}, **got})
                size += got["payload_bytes"] * with_payload
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=False)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=False)], names=names)
        if f:
            f.close()

    return near.mapInArrow(read, READ + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write, merge the index and read back: one row per row of ``pages``; other columns are not read, an empty table gives an empty one."""
    manifest = write_archives(pages, min_revisit_bytes=min_revisit_bytes)
    return read_archives(merge_index(manifest), archives=manifest.count())
