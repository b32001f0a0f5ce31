"""WARC archives with payload deduplication, and a capture index by external merge of sorted runs.

Archives are kept as rows of a table in the shared folder: (archive, chunk, data), where data is a run of whole gzip members.
The chunks of an archive, in order, are a .warc.gz file; export() writes them out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

CHUNK_BYTES = 4 << 20
#: Index entries that a range aims at, and compressed bytes that are given to a record's decompressor at a time.
RANGE_ROWS, STEP_BYTES = 100_000, 1 << 16
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
ROWS = "kind int, archive string, chunk int, data binary, url_key string, ts timestamp, page_id {id}, offset long, length long"


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, then ) and the rest without its fragment; all in lower case."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^.*@|:[0-9]*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?]*", ""))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, when: datetime, payload: bytes, refers_to, is_response: bool) -> bytes:
    """One record as a gzip member. A revisit has an empty block and the full payload's digest and size in its header."""
    date = when.strftime("%Y-%m-%dT%H:%M:%SZ")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload if is_response else b""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{date}')}>", f"WARC-Date: {date}", "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    lines += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    if not is_response:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each gzip member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, raw, end = zlib.decompressobj(31), [], at
        while not z.eof:
            if end >= len(data):
                raise ValueError(f"the gzip member at {at} is cut off")
            raw.append(z.decompress(view[end : end + STEP_BYTES]))
            end = min(end + STEP_BYTES, len(data))
        raw = b"".join(raw)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        yield at, headers, rest[: int(headers["Content-Length"])]
        at = end - len(z.unused_data)


class LoserTree:
    """k-way merge of sorted iterators: each step replays the winner's path of losers, log2(k) comparisons."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, n = runs, key, len(runs)
        self.size = n
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * n
        for k in range(n):
            self._replay(k)

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:  # not yet played: wins, so that every run is played in
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        kx, ky = self.key(x), self.key(y)
        return kx < ky or (kx == ky and a < b)

    def _replay(self, run: int) -> None:
        at, winner = (run + self.size) // 2, run
        while at > 0:
            if self._before(self.losers[at], winner):
                self.losers[at], winner = winner, self.losers[at]
            at //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.size and (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts_col: str | None = None, min_bytes: int = 0) -> DataFrame:
    """The written rows: archives' chunks (kind 0) and the entries of each archive's sorted capture run (kind 1).

    Of records with equal payloads of at least min_bytes, those with the smallest page id are responses and the others
    revisit it. Only payloads that occur more than once are joined back. Without ts_col a page's time is EPOCH plus its
    id in seconds.
    """
    payload = F.encode(text_or_empty(html_col), "UTF-8")
    when = F.col(ts_col) if ts_col else F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    x = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), when.alias("ts"), payload.alias("payload"), url_key(F.col(url_col)).alias("url_key"))
    x = x.withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload")})
    many = x.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("sha1", "n", "first")
    x = x.join(materialise(many, "repeated-payloads"), ["sha1", "n"], "left")
    kind = x.schema["page_id"].dataType.simpleString()
    x = x.withColumn("response", F.col("first").isNull() | F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)))
    x = x.select("page_id", "url", "ts", "payload", "url_key", "first", "response").sortWithinPartitions("url_key", "ts", "page_id")

    def run(batches):
        archive = f"run-{TaskContext.get().partitionId():06d}.warc.gz"
        chunk, held, size, entries = 0, [], 0, []
        names = ["kind", "archive", "chunk", "data", "url_key", "ts", "page_id", "offset", "length"]
        id_type, ts_type = pa.int64(), pa.timestamp("us", "UTC")

        def flush():
            n = len(entries)
            data = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([archive]), pa.array([chunk], pa.int32()), pa.array([b"".join(held)], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, ts_type), pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=names)
            cols = list(zip(*entries, strict=True))
            run = pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([archive] * n), pa.array([chunk] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(cols[0], pa.string()), pa.array(cols[1], ts_type), pa.array(cols[2], id_type), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=names)
            return data, run

        for b in batches:
            id_type, ts_type = b.schema.field("page_id").type, b.schema.field("ts").type
            for k in range(b.num_rows):
                page, url, ts, payload, key, first, response = (b.column(c)[k].as_py() for c in range(7))
                raw = record(page, url, ts, payload, first, response)
                entries.append((key, ts, page, size, len(raw)))
                held.append(raw)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield from flush()
                    chunk, held, size, entries = chunk + 1, [], 0, []
        if held:
            yield from flush()

    return materialise(x.mapInArrow(run, ROWS.format(id=kind)), "archives")


def _runs(entries: list[tuple], key) -> list[Iterator[int]]:
    """Row numbers of the sorted stretches in which an archive's entries arrived: one, unless the shuffle delivered its parts in another order."""
    runs: dict[str, list[list[int]]] = {}
    last: dict[str, tuple] = {}
    for k, e in enumerate(entries):
        own = key(e)
        stretches = runs.setdefault(e[3], [[]])
        if e[3] in last and own < last[e[3]]:
            stretches.append([])
        stretches[-1].append(k)
        last[e[3]] = own
    return [iter(r) for _, stretches in sorted(runs.items()) for r in stretches]


def merge(written: DataFrame) -> DataFrame:
    """The capture index (url_key, ts, page_id, archive, chunk, offset, length, position), in the order of position.

    position counts captures from 0 in the global order of URL key, time and page id, null first; readers of the stored
    index, or of what is joined to it, order by it. Ranges of the whole key are dealt out, RANGE_ROWS entries each about,
    so that one busy URL spreads over tasks and a task's memory doesn't grow with the index; each merges the slices of the sorted
    runs that it gets with a loser tree, without sorting them.
    """
    runs = written.where("kind = 1").select("url_key", "ts", "page_id", "archive", "chunk", "offset", "length")
    ordered = [F.col(c).asc_nulls_first() for c in ("url_key", "ts", "page_id", "archive", "chunk", "offset")]
    dealt = runs.repartitionByRange(max(1, -(-runs.count() // RANGE_ROWS)), *ordered)
    none = datetime.min.replace(tzinfo=UTC)

    def key(e):
        return e[0], e[1] is not None, e[1] or none, e[2] is not None, e[2] if e[2] is not None else 0, e[3], e[4], e[5]

    def run(batches):
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        entries = list(zip(*(c.to_pylist() for c in held.columns[:6]), strict=True))
        order = pa.array(LoserTree(_runs(entries, key), lambda k: key(entries[k])), pa.int64())
        merged = held.take(order).append_column("slice", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32())).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from merged.combine_chunks().to_batches(8192)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    index = materialise(dealt.mapInArrow(run, f"{kinds}, slice int, place long"), "capture-index")
    sizes = index.groupBy("slice").agg(F.count("*").alias("n"))  # a row for RANGE_ROWS entries
    before = sizes.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(before, "slice").select(*runs.columns, (F.col("before") + F.col("place")).alias("position")).orderBy("position")


def read(written: DataFrame) -> DataFrame:
    """Every record read back from the archives: archive, chunk, offset, page_id, record_type, payload_bytes, payload_digest,
    refers_to, and payload (null for a revisit). A response's size and digest are of what was read."""
    kind = written.schema["page_id"].dataType.simpleString()
    cast = int if kind in ("bigint", "int", "smallint", "tinyint") else str

    def run(batches):
        for b in batches:
            for archive, chunk, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cols = [[] for _ in range(9)]
                for at, head, block in records(data):
                    response = head["WARC-Type"] == "response"
                    payload = block.partition(b"\r\n\r\n")[2] if response else None
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                    row = (archive, chunk, at, None if page is None else cast(page), head["WARC-Type"], len(payload) if response else int(head["X-Payload-Length"]), digest(payload) if response else head["WARC-Payload-Digest"].removeprefix("sha1:"), None if refers is None else cast(refers), payload)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                id_type = pa.int64() if cast is int else pa.string()
                types = [pa.string(), pa.int32(), pa.int64(), id_type, pa.string(), pa.int64(), pa.string(), id_type, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["archive", "chunk", "offset", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    out = "bigint" if cast is int else "string"
    return written.where("kind = 0").select("archive", "chunk", "data").mapInArrow(run, f"archive string, chunk int, offset long, page_id {out}, record_type string, payload_bytes long, payload_digest string, refers_to {out}, payload binary")


def captures(pages: DataFrame, **how) -> DataFrame:
    """Write the pages' archives, merge their runs into the index, and read each indexed capture back.

    One row per page: url_key, ts, position, page_id, record_type, payload_bytes, payload_digest, refers_to. Ordered by
    position they are the capture histories, URL by URL.

    Nulls: a null page is an empty payload, a null URL an empty one; a page without an id is a revisit if some equal
    payload has one, else a response. Empty table: empty result. Ties: rows that share the smallest id are all responses,
    and equal keys are ordered by archive. Other columns aren't read. An id is a number or a string.
    """
    written = write(pages, **how)
    index = merge(written).drop("page_id")
    return index.join(read(written).drop("payload"), ["archive", "chunk", "offset"]).drop("archive", "chunk", "offset", "length")


def export(written: DataFrame, folder: str) -> list[str]:
    """Write the archives as .warc.gz files into a folder of this machine, a chunk at a time."""
    found = []
    for row in written.where("kind = 0").select("archive", "chunk", "data").orderBy("archive", "chunk").toLocalIterator():
        path = f"{folder}/{row['archive']}"
        with open(path, "ab" if path in found else "wb") as f:
            f.write(row["data"])
        if path not in found:
            found.append(path)
    return found


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: DuckDB: the rows of op10; base32 by groups of five hexadecimal digits.
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id,
  list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS INT), 5) AS INT)) AS v FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x:
  substr('{_BASE32}', x // 32768 + 1, 1) || substr('{_BASE32}', x // 1024 % 32 + 1, 1) || substr('{_BASE32}', x // 32 % 32 + 1, 1) || substr('{_BASE32}', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM f
"""
