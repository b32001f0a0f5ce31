"""Exact top-k by inner product with M-trees searched best first.

Vectors are integers (floor(scale * x)). Distances are Euclidean, a metric; with |q|, the distance to a node's centre, its
covering radius and the largest norm below it, 2 q.x = |q|^2 + |x|^2 - d(q, x)^2 bounds every score in a node from above. A stored
distance to the parent's centre gives such a bound by the triangle inequality before any distance is computed.

Rows are dealt to cells round pivots (a bounded sample). A cell of more than CELL_ROWS rows is cut into rings, by the distance to its pivot, and
only rows at one distance (a vector held by a third of all rows) are spread by hash. Every ring is one M-tree, written as a
table of pages. A query first searches the rings of its nearest cell that are about as far from the pivot as it is itself, and then only
rings whose bound, from the cell's radius and the ring's distances to the pivot, reaches the k-th score found there.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows a ring aims at, pivots at most, steps of distance in which a cell is cut, entries of a page, and queries searched together.
CELL_ROWS, PIVOTS, STEPS, PAGE, BLOCK = 1024, 1024, 1024, 64, 2048
#: Sums of products below this are exact in double arithmetic. Beyond it ("wide"), bounds get slack for rounding, and scores are computed as Python's integers.
EXACT = 1 << 53
#: What bounds allow for rounding of distances: always, and in wide arithmetic as a share of the vectors' lengths, for distances taken as such or from products.
_SLACK, _WIDE, _WIDE_PRODUCTS = 1e-6, 1e-9, 1e-6
_ZERO = 10**42
PAGES = "cell int, part long, page int, leaf boolean, ids array<long>, rows array<long>, vectors binary, parent_distances array<double>, radii array<double>, children array<int>, norms array<double>, least array<long>"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with a null id or vector, or a null or non-finite component, go."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((x - centre) ** 2).sum(-1)))


def _key(score: int) -> str:
    """A score of any size as text of one length that sorts the higher one first."""
    return f"{_ZERO - score:043}"


def _score(key: str) -> int:
    return _ZERO - int(key)


def build(ids: np.ndarray, rows_: np.ndarray, x: np.ndarray, exact: np.ndarray | None = None) -> list[dict]:
    """Pages of one M-tree by recursive clustering round sampled centres; page 0 is the root. exact: x as integers, for the leaves of wide arithmetic."""
    pages: list[dict] = []
    norms = (x**2).sum(1)
    rng = np.random.default_rng(3)

    def make(rows: np.ndarray, centre: np.ndarray) -> int:
        me = len(pages)
        pages.append({})
        if len(rows) <= PAGE:
            rows = rows[np.argsort(ids[rows])]
            pages[me] = {"leaf": True, "ids": ids[rows], "rows": rows_[rows], "vectors": x[rows] if exact is None else exact[rows], "pd": _distances(x[rows], centre), "radii": np.zeros(len(rows)), "children": np.zeros(0, int), "norms": norms[rows], "least": ids[rows]}
            return me
        seeds = rng.choice(rows, min(PAGE, -(-len(rows) // PAGE) + 1), replace=False)
        near = np.argmin(norms[rows][:, None] - 2 * x[rows] @ x[seeds].T + norms[seeds], axis=1)
        groups = [g for s in range(len(seeds)) if len(g := rows[near == s])]
        if len(groups) == 1:  # all at one place: cut by id
            order = rows[np.argsort(ids[rows])]
            groups = np.array_split(order, min(PAGE, -(-len(rows) // PAGE)))
        entries = []
        for g in groups:
            own = np.round(x[g].mean(0))
            entries.append((own, _distances(x[g], own).max(), norms[g].max(), ids[g].min(), g))
        children = [make(g, own) for own, *_, g in entries]
        own = np.stack([e[0] for e in entries])
        pages[me] = {"leaf": False, "ids": np.zeros(0, int), "rows": np.zeros(0, int), "vectors": own, "pd": _distances(own, centre), "radii": np.array([e[1] for e in entries]), "children": np.array(children), "norms": np.array([e[2] for e in entries]), "least": np.array([e[3] for e in entries])}
        return me

    if len(ids):
        make(np.arange(len(ids)), np.zeros(x.shape[1]))
    return pages


def search(pages: dict[int, dict], query: np.ndarray, own_id: int, k: int, found: list[tuple[int, int, int]], exact: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """The k best (score, -vec_id, -row) of found and the tree; best first by the upper bound of each page. exact: the query as integers, in wide arithmetic."""
    best = list(found)
    heapq.heapify(best)
    q2 = float(query @ query)
    wide = 0.0 if exact is None else _WIDE
    queue = [(-np.inf, 0, np.sqrt(q2))]  # bound negated, page, distance from the query to the page's centre (the origin for the root)
    while queue:
        bound, number, centre = heapq.heappop(queue)
        floor = float(best[0][0]) if len(best) == k else -np.inf
        if -bound < floor:
            break
        p = pages[number]
        # triangle inequality with the stored parent distances: no distance computed yet
        slack = _SLACK + wide * (np.sqrt(q2) + np.sqrt(p["norms"])) if wide else _SLACK
        nearest = np.maximum(0.0, np.abs(centre - p["pd"]) - p["radii"] - slack)
        upper = np.floor((q2 + p["norms"] - nearest**2) / 2 + _SLACK * (1 + q2 + p["norms"]) * 1e-3)
        keep = upper >= floor
        if len(best) == k:
            keep &= (upper > floor) | (p["least"] < -best[0][1])
        at = np.flatnonzero(keep)
        if not len(at):
            continue
        if p["leaf"]:
            if exact is not None:
                scores = p["exact"][at].astype(object) @ exact.astype(object)
            else:
                scores = p["vectors"][at] @ query
            if len(best) == k:
                fine = np.array([v >= best[0][0] for v in scores], bool) if exact is not None else scores >= floor
                at, scores = at[fine], scores[fine]
            for s, i, row in zip(scores.tolist(), p["ids"][at].tolist(), p["rows"][at].tolist(), strict=True):
                if i != own_id:
                    entry = (int(s), -i, -row)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
        else:
            d = _distances(p["vectors"][at], query)
            nearest = np.maximum(0.0, d - p["radii"][at] - (slack[at] if wide else slack))
            upper = np.floor((q2 + p["norms"][at] - nearest**2) / 2 + _SLACK * (1 + q2 + p["norms"][at]) * 1e-3)
            for n, u, dist in zip(at.tolist(), upper.tolist(), d.tolist(), strict=True):
                if u >= floor:
                    heapq.heappush(queue, (-u, int(p["children"][n]), dist))
    return best


def _pages_of(rows: pa.Table, width: int, wide: bool) -> dict[int, dict]:
    out = {}
    for r in rows.to_pylist():
        exact = np.frombuffer(r["vectors"], np.int64).reshape(-1, width) if wide and r["leaf"] else None
        v = np.frombuffer(r["vectors"], np.float64).reshape(-1, width) if exact is None else exact.astype(np.float64)
        out[r["page"]] = {"leaf": r["leaf"], "ids": np.array(r["ids"], np.int64), "rows": np.array(r["rows"], np.int64), "vectors": v, "pd": np.array(r["parent_distances"]), "radii": np.array(r["radii"]), "children": np.array(r["children"], int), "norms": np.array(r["norms"]), "least": np.array(r["least"], np.int64), "exact": exact}
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """For each query row its k best other rows by inner product: query_id, rank, vec_id, score; ties to the smaller vec_id.

    vectors and queries are tables of quantised(): (vec_id, v); a row doesn't find its own id. The width is that of most
    vectors (of equally many, the larger): vectors and queries of another width, empty ones too, take no part. Components of any
    size are ranked by their exact score; a score that a long can't hold is null.

    An empty table on either side: empty result. Repeated rows: candidates that repeat a vec_id take part each, by a row number
    of their own, and a repeated query has its result as often. Fewer than k others: all of them. Equal vectors are split by id
    into pages, and pages of a tied bound are only opened for a smaller id. Columns other than vec_id and v aren't read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    largest = lambda: F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    vectors = materialise(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "vectors")
    queries = materialise(queries.select("vec_id", "v", F.monotonically_increasing_id().alias("query_row")), "queries")
    common = vectors.where(F.size("v") > 0).groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), largest().alias("top")).orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width, n, top = common
    vectors, queries = vectors.where(F.size("v") == width), queries.where(F.size("v") == width)
    most = max(top, queries.agg(largest()).first()[0] or 0)
    wide = width * most * most >= EXACT / 4  # distances square differences and sums
    number, encode, decode = ("string", _key, _score) if wide else ("long", int, int)
    wanted = int(min(PIVOTS, max(1, n // CELL_ROWS)))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * wanted).select("v").distinct().limit(wanted).collect()  # at most PIVOTS vectors
    pivots = np.array([r[0] for r in sample], float)
    pivot_table = spark.sparkContext.broadcast((pivots, (pivots**2).sum(1)))

    def assign(batches):
        centres, norms = pivot_table.value
        for b in batches:
            x = _matrix(b.column("v"), width)
            cell = np.argmin(norms - 2 * x @ centres.T, axis=1) if len(x) else np.zeros(0, int)
            d, norm = _distances(x, centres[cell]), (x**2).sum(1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "v", "row")), pa.array(cell, pa.int32()), pa.array(d), pa.array(norm)], names=["vec_id", "v", "row", "cell", "d", "norm"])

    dealt = materialise(vectors.select("vec_id", "v", "row").mapInArrow(assign, "vec_id long, v array<long>, row long, cell int, d double, norm double"), "dealt-vectors")
    radii = materialise(dealt.groupBy("cell").agg(F.max("d").alias("radius")), "cells")  # at most PIVOTS rows
    # rings: steps of distance are gathered until CELL_ROWS rows; a step of more rows alone is dealt into parts by hash
    step = F.when(F.col("radius") > 0, F.least(F.floor(F.col("d") / F.col("radius") * STEPS), F.lit(STEPS - 1))).otherwise(0).cast("int")
    stepped = dealt.join(F.broadcast(radii), "cell").withColumn("step", step)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = stepped.groupBy("cell", "step").agg(F.count("*").alias("n")).withColumn("ring", F.floor(before / CELL_ROWS))
    steps = steps.withColumn("parts", F.ceil(F.col("n") / CELL_ROWS).cast("long"))
    steps = materialise(steps, "steps")  # at most PIVOTS * STEPS rows
    part = F.when(F.col("parts") <= 2, F.col("ring") * STEPS).otherwise(F.col("ring") * STEPS + 1 + F.pmod(F.xxhash64("vec_id", "row"), F.col("parts")))
    parted = stepped.join(F.broadcast(steps), ["cell", "step"]).withColumn("part", part)
    rings = parted.groupBy("cell", "part").agg(F.min("d").alias("inner"), F.max("d").alias("outer"), F.max("norm").alias("norm"))
    rings = materialise(rings.join(F.broadcast(radii.withColumnRenamed("radius", "reach")), "cell"), "rings")  # a row for each tree
    cell_reach, cell_norm = np.full(len(pivots), -np.inf), np.zeros(len(pivots))
    for cell, reach, norm in rings.groupBy("cell").agg(F.max("outer"), F.max("norm")).collect():  # at most PIVOTS rows
        cell_reach[cell], cell_norm[cell] = reach, norm
    reaches = spark.sparkContext.broadcast((cell_reach, cell_norm))

    def tree(key, rows):
        v = rows.column("v").combine_chunks()
        exact = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), width) if wide else None
        pages = build(rows.column("vec_id").to_numpy(), rows.column("row").to_numpy(), _matrix(v, width), exact)
        cols = list(zip(*((key[0].as_py(), key[1].as_py(), n, p["leaf"], p["ids"].tolist(), p["rows"].tolist(), p["vectors"].astype(np.int64 if wide and p["leaf"] else np.float64).tobytes(), p["pd"].tolist(), p["radii"].tolist(), p["children"].tolist(), p["norms"].tolist(), p["least"].tolist()) for n, p in enumerate(pages)), strict=True))
        long, double = pa.list_(pa.int64()), pa.list_(pa.float64())
        types = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), long, long, pa.binary(), double, double, pa.list_(pa.int32()), double, long]
        names = ["cell", "part", "page", "leaf", "ids", "rows", "vectors", "parent_distances", "radii", "children", "norms", "least"]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    index = materialise(parted.select("cell", "part", "vec_id", "row", "v").groupBy("cell", "part").applyInArrow(tree, PAGES), "mtree-pages")
    state = f"query_row long, query_id long, query array<long>, scores array<{number}>, found array<long>, rows array<long>"
    carried = ["query_row", "query_id", "query", "scores", "found", "rows"]

    def route(first: bool):
        """Queries with their squared length and k-th score so far, for each cell that may hold a better one (first: for the nearest), and its distance."""

        def run(batches):
            (centres, norms), (reach, top) = pivot_table.value, reaches.value
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    c = b.slice(at, 256)
                    x = _matrix(c.column("query"), width)
                    q2 = (x**2).sum(1)
                    d = np.sqrt(np.maximum(0.0, q2[:, None] - 2 * x @ centres.T + norms))
                    home = np.argmin(np.where(np.isfinite(reach), d, np.inf), axis=1)
                    floor = np.array([float(min(map(decode, s))) if len(s) == k else -np.inf for s in c.column("scores").to_pylist()], float)
                    slack = _SLACK + (_WIDE_PRODUCTS if wide else 0.0) * (np.sqrt(q2)[:, None] + np.sqrt(norms))
                    upper = np.floor((q2[:, None] + top - np.maximum(0.0, d - reach - slack) ** 2) / 2 + _SLACK * (1 + q2[:, None] + top))
                    rows, cells = (np.arange(len(x)), home) if first else np.nonzero((upper >= floor[:, None]) & np.isfinite(reach))
                    yield pa.RecordBatch.from_arrays([*(c.column(n).take(pa.array(rows)) for n in carried), pa.array(cells, pa.int32()), pa.array(q2[rows]), pa.array(floor[rows]), pa.array(d[rows, cells]), pa.array(slack[rows, cells]), pa.array(home[rows] == cells)], names=[*carried, "cell", "q2", "floor", "d", "slack", "home"])

        return run

    def seek(key, left, right):
        cols = [[] for _ in range(6)]
        if left.num_rows and right.num_rows:
            pages = _pages_of(right, width, wide)
            for r in left.to_pylist():
                exact = np.array(r["query"], np.int64) if wide else None
                best = search(pages, np.array(r["query"], float), r["query_id"], k, list(zip(map(decode, r["scores"]), (-i for i in r["found"]), (-i for i in r["rows"]), strict=True)), exact)
                for c, v in zip(cols, (r["query_row"], r["query_id"], r["query"], [encode(b[0]) for b in best], [-b[1] for b in best], [-b[2] for b in best]), strict=True):
                    c.append(v)
        long = pa.list_(pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), long, pa.list_(pa.string()) if wide else long, long, long), strict=True)], names=carried)

    def searched(asked: DataFrame, first: bool, name: str) -> DataFrame:
        """asked against the trees of its rings, a block of queries with a copy of a ring's pages at a time."""
        sent = asked.select(*carried).mapInArrow(route(first), state + ", cell int, q2 double, floor double, d double, slack double, home boolean").join(rings, "cell")
        gap = F.greatest(F.lit(0.0), F.col("inner") - F.col("d"), F.col("d") - F.col("outer"))
        near = F.greatest(F.lit(0.0), gap - F.col("slack"))
        upper = F.floor((F.col("q2") + F.col("norm") - near * near) / 2 + _SLACK * (1 + F.col("q2") + F.col("norm")))
        here = F.col("home") & ((gap <= 0) | ((F.col("d") > F.col("reach")) & (F.col("outer") >= F.col("reach"))))
        # distances that are rounded may fall on either side in the two passes: then a ring is searched in both
        sent = sent.where(here if first else (upper >= F.col("floor")) & (F.lit(True) if wide else ~here))
        sent = materialise(sent.select(*carried, "cell", "part"), name)
        blocks = sent.groupBy("cell", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        sent = sent.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("query_row"), F.col("blocks")).cast("int"))
        pages = index.join(blocks, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        a = sent.select("cell", "part", "block", *carried).groupBy("cell", "part", "block")
        return a.cogroup(pages.drop("blocks").groupBy("cell", "part", "block")).applyInArrow(seek, state)

    none = F.array().cast("array<long>")
    asked = queries.select("query_row", F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.array().cast(f"array<{number}>").alias("scores"), none.alias("found"), none.alias("rows"))
    ordered = (lambda c: c) if wide else (lambda c: -c)

    def best(x: DataFrame) -> DataFrame:
        """The k best of each query's lists: sorted short lists are merged, never more than k of one source each."""
        y = x.select("query_row", "query_id", F.explode(F.arrays_zip("scores", "found", "rows")).alias("p"))
        y = y.select("query_row", "query_id", F.struct(ordered(F.col("p.scores")).alias("s"), F.col("p.found").alias("i"), F.col("p.rows").alias("r")).alias("e")).distinct()
        return y.groupBy("query_row", "query_id").agg(F.slice(F.sort_array(F.collect_list("e")), 1, k).alias("e"))

    home = materialise(searched(asked, True, "home-queries"), "home-answers")
    some = best(home).join(asked.select("query_row", "query"), "query_row")
    some = materialise(some.select("query_row", "query_id", "query", F.transform("e", lambda e: ordered(e["s"])).alias("scores"), F.transform("e", lambda e: e["i"]).alias("found"), F.transform("e", lambda e: e["r"]).alias("rows")), "first-answers")
    rest = asked.join(some.select("query_row"), "query_row", "left_anti")  # whose own rings held nothing but themselves
    known = some.unionByName(rest)
    everywhere = best(known.unionByName(searched(known, False, "other-queries")))
    ranked = everywhere.select("query_id", F.posexplode("e").alias("pos", "e"))
    ranked = ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("e.i").alias("vec_id"), ordered(F.col("e.s")).alias("score"))
    if not wide:
        return ranked

    def numbers(batches):
        for b in batches:
            scores = [v if -(1 << 63) <= (v := _score(key)) < 1 << 63 else None for key in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(scores, pa.int64())], names=["query_id", "rank", "vec_id", "score"])

    return ranked.mapInArrow(numbers, schema)


#: DuckDB: every query row against every row.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
