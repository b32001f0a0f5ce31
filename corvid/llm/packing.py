"""Sequence packing by length patterns fitted with non-negative least squares.

The driver only sees the histogram of piece lengths (at most max_len numbers), whatever the corpus' size.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenizing
from .common import materialise, text_or_empty

PIECES = "doc_id {id}, piece int, start long, length long, ids binary, shard int, local_rank long"
#: Rows of the rank offsets up to which they are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_OFFSETS = 2_000_000
#: Pieces of one result batch.
BATCH_PIECES = 4096


def patterns(lengths: np.ndarray, max_len: int) -> np.ndarray:
    """All multisets of one to three of the lengths that fill max_len exactly; a row each, padded with 0."""
    have = np.zeros(max_len + 1, bool)
    have[lengths] = True
    out = [np.array([[0, 0, max_len]])] if have[max_len] else []
    small = np.arange(1, max_len // 2 + 1)
    small = small[have[small] & have[max_len - small]]
    out.append(np.stack([np.zeros_like(small), small, max_len - small], 1))
    for first in lengths[lengths <= max_len // 3]:
        second = np.arange(first, (max_len - first) // 2 + 1)
        second = second[have[second] & have[max_len - first - second]]
        out.append(np.stack([np.full_like(second, first), second, max_len - first - second], 1))
    return np.concatenate(out)


def fit_counts(histogram: np.ndarray, rows: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squared residual of the histogram, by accelerated projection.

    Short lengths weigh less, as they fit into gaps later.
    """
    n = len(histogram)
    weight = np.sqrt(np.arange(n) / n + 0.05)
    weight[0] = 0

    def forward(x):
        return sum(np.bincount(rows[:, k], x, n) for k in range(3)) * weight

    def back(r):
        return (r * weight)[rows].sum(1)

    v = np.ones(len(rows))
    for _ in range(20):
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top or 1
    target = histogram * weight
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - target) / (1.02 * top or 1))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): sequences that hold exactly the histogram's pieces; index = length, the last is max_len."""
    max_len = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum() and (rows := patterns(np.flatnonzero(left), max_len)).size:
        x = fit_counts(left.astype(float), rows)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            need = Counter(int(v) for v in rows[k] if v)
            if repeats := min(round(float(x[k])), *(int(left[v]) // m for v, m in need.items()), 2**62):
                out.append((tuple(sorted(need.elements(), reverse=True)), int(repeats)))
                for v, m in need.items():
                    left[v] -= m * repeats
    return out + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts of equal lengths instead of single pieces."""
    max_len = len(left) - 1
    open_: dict[int, Counter] = defaultdict(Counter)  # space left -> lengths held -> sequences
    spaces: list[int] = []
    for length in range(max_len, 0, -1):
        todo = int(left[length])
        while todo:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                each = max_len // length
                held, n = ((), todo // each) if todo >= each else ((), 1)
                fill = min(each, todo)
                space = max_len
            else:
                space = spaces[at]
                held, have = next(iter(open_[space].items()))
                fill = min(space // length, todo)
                n = min(have, todo // fill)
                open_[space][held] -= n
                if not open_[space][held]:
                    del open_[space][held]
                if not open_[space]:
                    del open_[space], spaces[at]
            rest = space - fill * length
            if not open_[rest]:
                bisect.insort(spaces, rest)
            open_[rest][held + (length,) * fill] += n
            todo -= n * fill
    return [(held, n) for held_n in open_.values() for held, n in held_n.items()]


def slots(sequences: list[tuple[tuple[int, ...], int]], max_len: int) -> dict[int, dict[str, np.ndarray]]:
    """For each length, its slots in order of rank: first rank, slots a sequence, first sequence, and their offset there."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    base = 0
    for held, repeats in sequences:
        at = 0
        for length, m in sorted(Counter(held).items(), reverse=True):
            out[length].append((used[length], m, base, at))
            used[length] += m * repeats
            at += m * length
        base += repeats
    return {k: dict(zip(("rank", "each", "sequence", "offset"), np.array(v, np.int64).T, strict=True)) for k, v in out.items()}


def cut(sizes: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of each piece of rows of these sizes (1 at least): max_len, but the first, which may be shorter."""
    pieces = -(-sizes // max_len)
    row = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
    first = (sizes - (pieces - 1) * max_len)[row]
    return row, piece, np.where(piece, first + (piece - 1) * max_len, 0), np.where(piece, max_len, first)


def places_among_equals(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    begins = np.flatnonzero(np.diff(values[order], prepend=-1))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(begins, np.diff(begins, append=len(values)))
    return out


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, max_len: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", room: int = tokenizing.MEMO_BYTES) -> DataFrame:
    """Each document's ids, ended by end_id and cut into pieces of max_len, of which the first may be shorter.

    shard and local_rank number the pieces of each length within the task that wrote them.
    """

    def run(batches):
        encode, shard, ranks = tokenizing.byte_level_batches(tokenizer_path, room), TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64)
        for b in batches:
            at = 0
            for flat, sizes in encode(b.column(1)):
                flat = np.insert(flat, np.cumsum(sizes), end_id)
                row, piece, start, length = cut(sizes + 1, max_len)
                rank = ranks[length] + places_among_equals(length)
                ranks += np.bincount(length, minlength=max_len + 1)
                ends = np.concatenate([[0], np.cumsum(length)])
                for k in range(0, len(row), BATCH_PIECES):
                    some, stop = slice(k, k + BATCH_PIECES), min(k + BATCH_PIECES, len(row))
                    raw = [None, pa.py_buffer((4 * (ends[k : stop + 1] - ends[k])).astype(np.int32)), pa.py_buffer(flat[ends[k] : ends[stop]])]
                    cols = [b.column(0).take(pa.array(at + row[some])), pa.array(piece[some].astype(np.int32)), pa.array(start[some]), pa.array(length[some]), pa.Array.from_buffers(pa.binary(), stop - k, raw)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(stop - k, shard, np.int32)), pa.array(rank[some])], names=["doc_id", "piece", "start", "length", "ids", "shard", "local_rank"])
                at += len(sizes)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES.format(id=rows.schema["doc_id"].dataType.simpleString()))


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", room: int = tokenizing.MEMO_BYTES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    Pieces are tokenised once into the shared folder. Their length histogram is fitted by patterns of one to three
    lengths that fill a sequence, the counts are rounded, and what is left is packed best fit first over the histogram.
    A piece's rank among those of its length is the rank within its task plus the task's offset; the rank alone decides
    its place, so no group is gathered anywhere.

    room: bytes of units that a worker remembers; fewer cost time, never another result.

    Nulls: a null text is empty and gives one piece, the end id; a null id is kept. Empty table: empty result. Repeated
    rows and ids: each row is packed. Ties of length: by task, then order in the task. Other columns aren't read.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenised_pieces(docs, tokenizer_path, max_len, end_id, id_col, text_col, room), "pieces")
    counts = materialise(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(max_len + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most max_len rows
        histogram[length] = n
    places = slots(plan(histogram), max_len)
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(F.broadcast(offsets) if counts.count() <= BROADCAST_OFFSETS else offsets, ["shard", "length"])
    table = spark.sparkContext.broadcast(places)  # a few rows for each length

    def place(batches):
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                at, p = np.flatnonzero(length == v), table.value[int(v)]
                k = np.searchsorted(p["rank"], rank[at], "right") - 1
                turn, slot = np.divmod(rank[at] - p["rank"][k], p["each"][k])
                sequence[at], offset[at] = p["sequence"][k] + turn, p["offset"][k] + slot * v
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "piece", "start", "length", "ids")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("before") + F.col("local_rank")).alias("rank")).mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"
    )
