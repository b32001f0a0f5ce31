"""Runs of periodic words by Lyndon arrays, and texts without their repeats.

Every run has a Lyndon root that is the longest Lyndon word where it begins, in one of the two orders of the alphabet: its period is the
way to the next smaller suffix. One pass from left to right finds all next and previous smaller suffixes, and how far the compared suffixes agree. Where a
stretch is known to equal an earlier one, its comparisons are copied from there, and only words beyond the furthest matched one are read, so a pass
is linear for any ordered alphabet. There are no suffix structures and no hashes of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, row_beside, text_or_empty

#: A run counts if it holds its period four times or more, and six words or more.
TIMES, WORDS = 4, 6
#: Bytes of text that a worker takes at a time; one text at least.
BATCH = 8 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"


def smaller_suffixes(s: Sequence) -> tuple[list[int], list[int]]:
    """For each i the next smaller suffix (len(s) if none; the empty suffix is the smallest), and how far suffix i agrees with it.

    matched is a pair (a, b) of suffixes, a < b, that agree up to end, the furthest known place. For a pair of suffixes in [b, end)
    the pair that lies b - a before it has been compared, as a's word up to b is a Lyndon word.
    """
    n = len(s)
    following, agree = [n] * n, [0] * n  # agree[i]: of i and following[i]
    previous, agreed = [-1] * n, [0] * n  # agreed[i]: of previous[i] and i
    shift = b = end = 0

    for i in range(1, n):
        j, known = i - 1, 0  # suffix i and the one above j in the chain agree for known words; at first nothing is known
        while j >= 0:
            length = known
            if b <= j and i < end:
                x, y = j - shift, i - shift
                copied = agree[x] if following[x] == y else agreed[y] if previous[y] == x else 0
                length = max(length, min(copied, end - i))
            at = i + length
            if at >= end or length == known:
                back = j - i
                while at < n and s[at + back] == s[at]:
                    at += 1
                length = at - i
                if at > end:
                    end, b, shift = at, i, i - j
            if at < n and s[j + length] < s[at]:
                previous[i], agreed[i] = j, length
                break
            following[j], agree[j] = i, length
            # suffix j is larger than suffix i; the next one down the chain is smaller than suffix j and agrees with it for agreed[j] words
            down = agreed[j]
            j = previous[j]
            while j >= 0 and down > length:  # it differs from suffix i where suffix j does
                following[j], agree[j] = i, length
                down, j = agreed[j], previous[j]
            if j >= 0 and down < length:  # it is smaller than suffix j at a place where suffix i is as suffix j
                previous[i], agreed[i] = j, down
                break
            known = length
    return following, agree


def find_runs(s: Sequence, times: int = TIMES, least: int = WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least max(least, times * period) items, by start, then period. times: at least 3.

    The first Lyndon root of a run of three periods is followed by another, so only roots that agree with what follows for a period or more
    are held against the items before them, and only the first of each run: at most a period is read there.
    """
    found = set()
    n = len(s)
    for sign in (1, -1):
        following, agree = smaller_suffixes(s if sign == 1 else [-v for v in s])
        for i, (j, right) in enumerate(zip(following, agree, strict=True)):
            p = j - i
            if right < (times - 2) * p or j == n or (i >= p and following[i - p] == i and agree[i - p] >= p):
                continue
            left = 0
            while left < i and left < p and s[i - 1 - left] == s[j - 1 - left]:
                left += 1
            length = left + p + right
            if left < p and length >= max(least, times * p):
                found.add((i - left, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: list[bytes], times: int = TIMES, least: int = WORDS) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches outside of which no run lies: a run holds each of its words times times at least, so rarer words cut it."""
    todo = [(0, len(words))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        part = words[a:b]
        counts = Counter(part)
        if min(counts.values()) >= times:
            yield a, b
            continue
        start = a
        for at, w in enumerate(part, a):
            if counts[w] < times:
                if at - start >= least:
                    todo.append((start, at))
                start = at + 1
        if b - start >= least:
            todo.append((start, b))


def runs_of(words: list[bytes], times: int = TIMES, least: int = WORDS) -> list[tuple[int, int, int]]:
    """find_runs() of a text's words."""
    found = []
    for a, b in stretches(words, times, least):
        part = words[a:b]
        order = {w: k for k, w in enumerate(sorted(set(part)))}
        found += [(a + start, length, period) for start, length, period in find_runs([order[w] for w in part], times, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if a > at:
            kept += words[at:a]
        at = max(at, b)
    return b" ".join(kept + words[at:])


def with_runs(docs: DataFrame, text_col: str = "text", times: int = TIMES, least: int = WORDS, runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """docs, and runs_col: the runs of the text's words by start, then period; collapsed_col: its words, joined by spaces, each run once.

    Words are what white space (space, U+0009 to U+000D) separates, compared as they are. Runs of at least max(least, times * period) words
    count, of which the period is the smallest and no neighbouring word keeps it.

    Nulls: a null text has no words, no runs and an empty collapsed text; other columns are kept as they are, but for columns called
    runs_col or collapsed_col, which must not be there (ValueError). Empty table: empty result. Repeated rows: each has its own. Ties: runs of
    one start come by period. A text's length has no limit; the longest text is what a worker holds at least.
    """
    if taken := {runs_col, collapsed_col} & {*docs.columns}:
        raise ValueError(f"there is a column {sorted(taken)[0]} already")
    held, schema = row_beside(docs, docs.columns, "text", text_or_empty(f"`{text_col}`").cast("binary"), f"runs {RUNS}, collapsed string")

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            at = 0
            while at < b.num_rows:
                runs, texts, size, first = [], [], 0, at
                while at < b.num_rows and size < BATCH:
                    text = b.column(1)[at].as_py()
                    words = text.split()
                    found = runs_of(words, times, least)
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    texts.append(collapsed(words, found).decode(errors="replace"))
                    size, at = size + len(text), at + 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, at - first), pa.array(runs, kind), pa.array(texts, pa.string())], names=["row", "runs", "collapsed"])

    out = held.mapInArrow(run, schema)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("runs").alias(runs_col), F.col("collapsed").alias(collapsed_col))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text_col; a tenth of the rows, chosen by the id's checksum, repeat a part of their words from a place of the text on.

    With h the CRC-32 of the decimal id and g = h / 10: if h % 10 = 0, each of the n words i >= a becomes word a + (i - a) % p, with a = g % n and
    p = 1 + (n - a) / (3 + g % 8), whole numbers. Null ids and texts without words stay as they are.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    x = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("t"), h.alias("h"))
    x = x.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("t", F.lit(WORD), F.lit(0))))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    x = x.withColumn("n", n).withColumn("a", F.when(n > 0, (g % n).cast("int")))
    x = x.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    period = F.slice("w", F.col("a") + 1, F.least(F.col("p"), F.col("n") - F.col("a")))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("t"))
    return x.select(F.col("id").alias(id_col), text.alias(text_col))
