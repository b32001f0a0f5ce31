"""Exact n-gram Jaccard self-join with skips in index lists and answers derived from similar sets.

1. One pass over the texts gives each set's 128-bit key and the frequent shingles (which only set the order of tokens).
2. A second pass posts each set's prefix: the rarest tokens, of which two similar sets must share one.
3. Short index lists are decided whole, pair by pair. In a long one the first set is the leader, and each member is compared with it.
4. Long lists whose members make one component are skipped as a whole. Members of the others meet a few list neighbours
   each, and their components merge.
5. What is left is compared exactly: members of different components meet only inside blocks of compatible set size, and
   where positions allow enough common tokens. A member's answers are derived from those computed for its leader: the counts
   that both share with it bound their overlap from both sides, which settles pairs without touching the sets.
Sets are never stored for all documents: those that a step compares are made again from the rows that hold them.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, discard, materialise, release, text_or_empty
from .components import connected_components

#: A shingle is reported by a task if it is in so many of the sets it looks at together; the most frequent ones order last.
LOCAL_MIN, FREQUENT = 4, 100_000
#: Lists of at most so many sets are decided whole at once; up to the second bound, whole but for pairs inside a component.
SHORT_LIST, MEDIUM_LIST = 8, 16
#: Sets that a list of a frequent shingle has at most, about; a longer one is dealt into lists with leaders of their own, which form one more list.
HOT_LIST = 50_000
#: Tokens of a prefix that is carried along in an open list; longer ones are looked at pair by pair.
SHORT_PREFIX = 128
#: Bits of a set's parity map.
PARITY = 512
#: Rounds in which members of open lists meet neighbours of a random order and components merge, sets met before one in each, and partners it has of
#: them, before what is left is compared exactly. No more rounds follow one that leaves more than this share of the components in open lists, unless
#: more than that share of the pairs it met are links: then most of what is left would be links that merging saves.
ROUNDS, NEIGHBOURS, PARTNERS, MERGING, LINKING = 3, 2, 4, 0.9, 0.5
#: Shingles that a task looks at together.
SCANNED = 1_000_000
#: Bits a needed row has in the filter that says which rows are read again, and 64-bit words of the filter at most (16 MB).
FILTER_BITS, FILTER_WORDS = 16, 1 << 21
#: Rows of near copies (8 bytes each), and pairs, that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_PAIRS = 2_000_000, 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; with fewer words, of the whole sequence."""
    words = text.encode().lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    z = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        z = (z ^ (z >> np.uint64(29))) * _P + h[k : len(h) - width + 1 + k]
    return np.unique((z ^ (z >> np.uint64(32))).view(np.int64))


def set_key(tokens: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A set's 128-bit key as two numbers; the first has fewer bits in tests of clashes."""
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return tuple(int.from_bytes(d[k : k + 8], "little", signed=True) >> s for k, s in ((0, 64 - bits), (8, 0)))


def _numbering(clashes: frozenset[int], bits: int):
    """tokens -> node: the key's first half, or its second half where the first is that of different sets."""

    def node(tokens: np.ndarray) -> int:
        first, second = set_key(tokens, bits)
        return second if first in clashes else first

    return node


def _sets(batches, width, wanted=None):
    """(columns, sets) of at most 256 rows at a time, the text being the last column; only the rows wanted."""
    claim("jaccard")
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            if wanted is not None:
                part = part.take(pa.array(np.flatnonzero(wanted(part.column(0).to_numpy()))))
            yield part, [shingle_set(t, width) for t in part.column(part.num_columns - 1).to_pylist()]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), pa.int64()))


def _scan(rows: DataFrame, width: int, bits: int) -> DataFrame:
    """doc_id, node, check, n of each document (kind 0), and token, count of locally frequent shingles (kind 1)."""
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        names = ["kind", "doc_id", "node", "check", "n"]
        id_type, held, size = None, [], 0

        def frequent():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts >= LOCAL_MIN], counts[counts >= LOCAL_MIN]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int32)), pa.nulls(len(tokens), id_type), pa.array(tokens), pa.nulls(len(tokens), pa.int64()), pa.array(counts.astype(np.int64))], names=names)

        for part, sets in _sets(batches, width):
            id_type = part.column(0).type
            keys = np.array([set_key(s, bits) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), part.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(s) for s in sets], pa.int64())], names=names)
            held += sets
            size += sum(map(len, sets))
            if size > SCANNED:
                yield frequent()
                held, size = [], 0
        if held:
            yield frequent()

    return rows.mapInArrow(run, f"kind int, doc_id {kind}, node long, check long, n long")


def _postings(rows: DataFrame, width: int, percent: int, frequent, number) -> DataFrame:
    """token, part, node, n, pos for each set's prefix, once per task and set; part is -1 but for lists that are dealt out."""

    def run(batches):
        known, counts = frequent.value
        seen: set[int] = set()
        for _, sets in _sets(batches, width):
            out = [[], [], [], [], []]
            for s in sets:
                n = len(s)
                if not n or (node := number(s)) in seen:
                    continue
                seen.add(node)
                length = n + percent * -n // 100 + 1  # n - ceil(percent n / 100) + 1
                part = np.full(length, -1, np.int32)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    count = np.where(known[at] == s, counts[at], 0)
                    order = np.lexsort((s, count))[:length]
                    s, count = s[order], count[order]
                    if count[-1] > HOT_LIST:
                        part = np.where(count > HOT_LIST, node % (count // HOT_LIST + 1), -1).astype(np.int32)
                for column, v in zip(out, (s[:length], part, np.full(length, node), np.full(length, n, np.int32), np.arange(length, dtype=np.int32)), strict=True):
                    column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["token", "part", "node", "n", "pos"])

    return rows.mapInArrow(run, "token long, part int, node long, n int, pos int")


def parity(tokens: np.ndarray) -> np.ndarray:
    """PARITY bits, each whether an odd number of tokens fall on it: bits in which two sets differ never outnumber tokens that only one has."""
    return np.packbits((np.bincount(tokens & (PARITY - 1), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def _needed_sets(rows: DataFrame, width: int, holders: DataFrame, needed: DataFrame, number, whole: bool = True) -> DataFrame:
    """(node, bits, tokens) of the needed sets, or (node, bits): their parity maps alone, made again from one row of each.

    holders: (node, row), a row's hash for each set. A filter of needed hashes, whose size follows their number up to a
    constant bound, goes to the tasks, which shingle only rows that it lets through.
    """
    needed = materialise(needed.select("node").join(holders, "node"), "needed-rows")
    n = needed.count()
    few, words = n <= BROADCAST_ROWS, 1 << max(6, min(FILTER_WORDS.bit_length() - 1, (n * FILTER_BITS // 64).bit_length()))
    bit = F.pmod(F.col("row"), F.lit(words * 64))
    held = needed.groupBy((bit / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")).toArrow()  # at most FILTER_WORDS rows
    mask = np.zeros(words, np.int64)
    mask[held.column("w").to_numpy()] = held.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(mask.view(np.uint64))
    columns = ["bits", "tokens"] if whole else ["bits"]

    def wanted(row: np.ndarray) -> np.ndarray:
        at = row % np.int64(words * 64)
        return (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def run(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches, width, wanted):
            nodes, kept = [], []
            for s in sets:
                if len(s) and (node := number(s)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    kept.append(s)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists([parity(s) for s in kept]), *([_lists(kept)] if whole else [])], names=["node", *columns])

    keyed = rows.select(F.xxhash64(rows.columns[0]).alias("row"), rows.columns[1])
    wanted_nodes = needed.select("node")
    found = keyed.mapInArrow(run, ", ".join(["node long", *(f"{c} array<long>" for c in columns)])).join(F.broadcast(wanted_nodes) if few else wanted_nodes, "node", "left_semi")
    return found.groupBy("node").agg(*(F.first(c).alias(c) for c in columns))


def _differ(a: str, b: str) -> Column:
    """Bits in which two parity maps differ: a lower bound of the tokens that only one set has."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PARITY // 64)))


def _with_ends(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """pairs (x, y, ...) with the column of both ends as x_ and y_. Few pairs go to the sets, so that only theirs are shuffled."""
    of_y = sets
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
        of_y = sets.join(F.broadcast(pairs.select(F.col("y").alias("node")).distinct()), "node", "left_semi")
    x, y = sets.select(F.col("node").alias("x"), F.col(column).alias("x_")), of_y.select(F.col("node").alias("y"), F.col(column).alias("y_"))
    return pairs.join(x, "x").join(y, "y")


def _overlaps(pairs: DataFrame, sets: DataFrame, apart: Column | None) -> DataFrame:
    """pairs (x, y, ...) with inter, the number of common tokens; without those whose parity maps show that more than apart tokens differ (None: known of all)."""
    near = pairs if apart is None else materialise(_with_ends(pairs, sets, "bits").where(_differ("x_", "y_") <= apart).drop("x_", "y_"), "near-pairs")
    return _with_ends(near, sets, "tokens").withColumn("inter", F.size(F.array_intersect("x_", "y_"))).drop("x_", "y_")


def _relabelled(comp: DataFrame, merged: DataFrame) -> DataFrame:
    """Components after some of them, or single nodes, were merged (node -> component)."""
    of = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    old = comp.join(of, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return old.unionByName(merged.join(comp.select("node"), "node", "left_anti"))


def _beside(members: DataFrame, turn: int, fits) -> DataFrame:
    """(node, n, component, node_b, n_b, component_b): members of a list with those of the NEIGHBOURS before them, in a random order, that fits(neighbour) lets through.

    Only these become rows: what is tested is NEIGHBOURS a posting, whatever a list's length. Each list has an order of its own, so that
    a set that shares many lists with the same others meets more of them than NEIGHBOURS.
    """
    order = Window.partitionBy("token").orderBy("block", F.xxhash64("node", "token", F.lit(turn)))
    before = [f"before_{k}" for k in range(1, NEIGHBOURS + 1)]
    x = members.withColumns({b: F.lag(F.struct("node", "n", "pos", "component", "bits"), k).over(order) for k, b in enumerate(before, 1)})
    fit = F.array_compact(F.array(*(F.when(fits(b), F.struct(*(F.col(f"{b}.{c}").alias(f"{c}_b") for c in ("node", "n", "component")))) for b in before)))
    return x.select("node", "n", "component", F.explode(fit).alias("_b")).select("node", "n", "component", "_b.*")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()


def derived(n: Column, m: Column, leader_n: Column, with_leader: Column, other_with_leader: Column) -> tuple[Column, Column]:
    """Least and most common tokens of sets of n and m tokens, from the tokens that each shares with one leader.

    Of the leader's leader_n tokens both hold at least with_leader + other_with_leader - leader_n; outside it, a set has
    only its size less what it shares.
    """
    most = F.least(other_with_leader + n - with_leader, with_leader + m - other_with_leader)
    return F.coalesce(with_leader + other_with_leader - leader_n, F.lit(-1)), F.least(n, m, F.coalesce(most, n))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", derive: bool = True, node_bits: int = 64) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the smallest id reachable by links, itself included).

    A set: the distinct shingles of width words of the text with A-Z in lower case; with fewer words the whole
    sequence. Two sets link if 100 * intersection >= percent * union. Equal sets are one node throughout. Without derive
    no answer is taken from a leader's; the result is the same.

    Nulls: a null text, like one without words, has an empty set, which links with nothing; its component is its own
    id. A row with a null id takes part and gets its group's smallest id. Empty table: empty result. Repeated rows are
    equal sets. Other columns aren't read. Shingles are 64-bit hashes, sets are told apart by 128 bits: different sets whose
    first halves clash (node_bits, fewer in tests) are numbered by the second half.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    scan = materialise(_scan(rows, width, node_bits), "sets")
    top = scan.where("kind = 1").groupBy("node").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "node").limit(FREQUENT).collect()  # a constant bound
    top = sorted((r[0], r[1]) for r in top)
    frequent = spark.sparkContext.broadcast((np.array([x[0] for x in top], np.int64), np.array([x[1] for x in top], np.int64)))
    documents = scan.where("kind = 0")
    halves = documents.where("n > 0").groupBy("node").agg(F.min("check").alias("c"), F.max("check").alias("d"), F.min(F.xxhash64("doc_id")).alias("row"))
    # about n * n / 2^65 of n sets; each clash is a row on the driver
    clashes = frozenset(r[0] for r in halves.where("c <> d").select("node").collect())
    if clashes:
        second = F.col("node").isin([*clashes])
        documents = documents.withColumn("node", F.when(second, F.col("check")).otherwise(F.col("node")))
    holders = materialise(documents.where("n > 0").groupBy("node").agg(F.min(F.xxhash64("doc_id")).alias("row"), F.min("doc_id").alias("least")), "set-holders")
    number = _numbering(clashes, node_bits)

    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    need = lambda a, b: F.ceil(percent * (a + b) / (100 + percent) - 1e-9)
    ahead = lambda a, at, b, bt: F.least(a - at, b - bt)  # noqa: E731  tokens that may be common from here on, this one included
    share = lambda a: F.ceil(percent * a / 100 - 1e-9)

    def may_link(n, pos, m, at):
        return fits(n, m) & (ahead(n, pos, m, at) >= need(n, m))

    def fetch(needed: DataFrame, name: str, whole: bool = True) -> DataFrame:
        return materialise(_needed_sets(rows, width, holders.select("node", "row"), needed, number, whole), name, "lz4")

    # one shuffle: the postings aren't written; a set that several tasks posted counts once
    whole = Window.partitionBy("token", "part")
    by_node = whole.orderBy("node")
    posted = _postings(rows, width, percent, frequent, number).withColumn("_c", F.count("*").over(whole)).where((F.col("_c") > 1) | (F.col("part") >= 0))
    posted = posted.withColumns({"_l": F.first(F.struct("node", "n", "pos")).over(by_node), "_at": F.dense_rank().over(by_node), "_before": F.lag("node").over(by_node)})
    posted = posted.withColumn("held", F.max("_at").over(whole)).where(((F.col("held") > 1) | (F.col("part") >= 0)) & ~F.coalesce(F.col("_before") == F.col("node"), F.lit(False)))
    shared = materialise(posted.select("token", "part", "node", "n", "pos", F.col("_l.node").alias("leader"), F.col("_l.n").alias("leader_n"), F.col("_l.pos").alias("leader_pos"), "held"), "shared-postings")
    release(spark)

    prefixes = shared.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda v: v["token"]).alias("prefix"))
    prefixes = materialise(prefixes, "prefixes")

    def common(a, b):
        """Tokens that the prefixes of two similar sets share at least: the rest of one of them can't hold more."""
        return need(a, b) - F.greatest(share(a), share(b)) + 1

    def promising(pairs: DataFrame) -> DataFrame:
        p = lambda end, to: prefixes.select(F.col("node").alias(end), F.col("prefix").alias(to))
        x = pairs.join(p("x", "px"), "x").join(p("y", "py"), "y")
        return x.where(F.size(F.array_intersect("px", "py")) >= common(F.col("n"), F.col("m"))).drop("px", "py")

    def links(n, m, inter):
        return (100 + percent) * inter >= percent * (n + m)

    # short lists: every pair; long ones: each member with its leader, and the leaders of a list's parts with the first of them
    short = (F.col("held") <= SHORT_LIST) & (F.col("part") < 0)
    pair = lambda a, b: F.struct(b["node"].alias("x"), a["node"].alias("y"), b["n"].alias("n"), a["n"].alias("m"))
    lists = shared.where(short).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("node", "n", "pos"))).alias("l"))  # SHORT_LIST at most
    pairs = lists.select(F.explode(F.flatten(F.transform("l", lambda a, i: F.transform(F.filter(F.slice("l", i + 2, SHORT_LIST), lambda b: may_link(b["n"], b["pos"], a["n"], a["pos"])), lambda b: pair(a, b))))).alias("p")).select("p.*")
    long_ = shared.where(~short)
    leaders = long_.where("part >= 0").select("token", "leader", "leader_n", "leader_pos").distinct()
    first_of = leaders.groupBy("token").agg(F.min(F.struct("leader", "leader_n", "leader_pos")).alias("f"))
    leaders = leaders.join(first_of, "token").select(F.col("leader").alias("node"), F.col("leader_n").alias("n"), F.col("leader_pos").alias("pos"), F.col("f.leader").alias("leader"), F.col("f.leader_n").alias("leader_n"), F.col("f.leader_pos").alias("leader_pos"))
    stars = long_.select(*leaders.columns).unionByName(leaders).where(F.col("node") != F.col("leader"))
    stars = stars.where(may_link(F.col("n"), F.col("pos"), F.col("leader_n"), F.col("leader_pos"))).select(F.col("node").alias("x"), F.col("leader").alias("y"), "n", F.col("leader_n").alias("m"))
    pairs = materialise(promising(pairs.unionByName(stars).distinct()), "first-pairs")
    sets = fetch(_ends(pairs), "needed-sets")
    release(spark)
    apart = F.col("n") + F.col("m") - 2 * need(F.col("n"), F.col("m"))
    first = materialise(_overlaps(pairs, sets, apart), "first-overlaps")
    discard(pairs)
    release(spark)
    linked = materialise(first.where(links(F.col("n"), F.col("m"), F.col("inter"))).select(F.col("x").alias("a"), F.col("y").alias("b")), "first-links")
    comp = materialise(connected_components(linked), "first-components")
    discard(linked)
    long_ = long_.withColumn("block", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int"))
    # a leader has met all of its list, unless the list is in parts
    rest = long_.where("node <> leader or part >= 0")
    rest = rest.select("token", "part", "node", "n", "pos", "leader", "leader_n", "held", "block")
    members = ("token", "part", "node", "n", "pos", "leader", "leader_n", "held", "block", "kin")
    known = prefixes.select("node", F.size("prefix").alias("kin"))

    def open_lists(x: DataFrame, comp: DataFrame) -> DataFrame:
        """The postings x, with components, of lists and sizes that more than one component shares; others are skipped whole.

        A set links only with sets of its own block of sizes or one next to it, so where these three hold one component there is nothing to find.
        Components only merge, so there never will be, and a block that is skipped has the component of those beside it: later rounds look
        only at what an earlier one left open.
        """
        x = x.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        beside = Window.partitionBy("token").orderBy("block").rangeBetween(-1, 1)
        mixed = x.groupBy("token", "block").agg(F.min("component").alias("c"), F.max("component").alias("d"))
        below = Window.partitionBy("token").orderBy("block").rangeBetween(-1, -1)
        near = {"c_near": F.min("c").over(beside), "d_near": F.max("d").over(beside), "c_below": F.min("c").over(below), "d_below": F.max("d").over(below)}
        mixed = materialise(mixed.withColumns(near).where("c_near <> d_near").select("token", "block", "c", "d", "c_below", "d_below"), "mixed-blocks")
        return x.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_PAIRS else mixed, ["token", "block"])

    def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The sets fetched so far and those that the pairs need besides."""
        more = materialise(_ends(pairs).join(sets.select("node"), "node", "left_anti"), "more-needed")
        return sets if more.isEmpty() else sets.unionByName(fetch(more, "needed-sets"))

    opened = materialise(open_lists(rest.join(known, "node"), comp), "open-lists")
    release(spark)
    medium = (F.col("held") <= MEDIUM_LIST) & (F.col("part") < 0)
    met = first.select(F.col("x").alias("node"), F.col("y").alias("leader"), "inter").distinct()

    def with_inter(x: DataFrame) -> DataFrame:
        """The tokens that a member shares with its list's leader, where that was computed."""
        return x.join(met, ["node", "leader"], "left").withColumn("inter", F.when(F.col("node") == F.col("leader"), F.col("n")).otherwise(F.col("inter")))

    def joined(members: DataFrame, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        """Two sides of a join on token and block, in which sets meet smaller ones of their block and of the one below, where another component is there."""
        a = members.select("token", "leader_n", "block", *(F.col(c).alias(f"{c}_a") for c in carry))
        other = lambda c, d: (F.col(c) != F.col("component")) | (F.col(d) != F.col("component"))
        places = F.array_compact(F.array(F.when(other("c_below", "d_below"), F.col("block") - 1), F.when(other("c", "d"), F.col("block"))))
        return a, members.select("token", F.explode(places).alias("block"), *(F.col(c).alias(f"{c}_b") for c in carry))

    na, nb = F.col("n_a"), F.col("n_b")
    of_leader = (F.col("leader_a") == F.col("leader_b")) & F.lit(derive)
    least, most = derived(na, nb, F.col("leader_n"), F.when(of_leader, F.col("inter_a")), F.when(of_leader, F.col("inter_b")))
    fine = ((na < nb) | ((na == nb) & (F.col("node_a") < F.col("node_b")))) & (F.col("component_a") != F.col("component_b"))
    fine &= may_link(na, F.col("pos_a"), nb, F.col("pos_b")) & (F.least("kin_a", "kin_b") >= common(na, nb)) & (most >= need(na, nb))
    carry = ("node", "n", "pos", "component", "leader", "inter", "kin")

    def paired(a: DataFrame, b: DataFrame, fine: Column) -> DataFrame:
        """x, y, n, m, c, d, and sure: whether the leader's answers make the pair a link."""
        x = a.join(b, (a.token == b.token) & (a.block == b.block) & fine)
        x = x.select(F.col("node_a").alias("x"), F.col("node_b").alias("y"), na.alias("n"), nb.alias("m"), F.col("component_a").alias("c"), F.col("component_b").alias("d"), (least >= need(na, nb)).alias("sure"))
        return promising(x.groupBy("x", "y", "n", "m", "c", "d").agg(F.max("sure").alias("sure")))

    def new_links(pairs: DataFrame, sets: DataFrame, apart: Column | None) -> DataFrame:
        """Components (a, b) that sure pairs, or those whose sets overlap enough, connect."""
        tested = _overlaps(pairs.where("not sure"), sets, apart).where(links(F.col("n"), F.col("m"), F.col("inter")))
        found = tested.select("c", "d").unionByName(pairs.where("sure").select("c", "d"))
        return materialise(found.select(F.col("c").alias("a"), F.col("d").alias("b")).distinct(), "new-links")

    met_in_medium = paired(*joined(with_inter(opened.where(medium)), carry), fine)
    bits = fetch(opened.where(~medium).select("node").distinct(), "parity-maps", whole=False)
    release(spark)

    # neighbours of a list in a random order: a few partners a set, so that large groups of borderline copies grow together; each round has only the
    # lists, and the sizes in them, that still hold several components
    n = F.col("n")

    def fits_beside(b: str) -> Column:
        m = F.col(f"{b}.n")
        return (F.col("component") != F.col(f"{b}.component")) & may_link(n, F.col("pos"), m, F.col(f"{b}.pos")) & (_differ("bits", f"{b}.bits") <= n + m - 2 * need(n, m))

    apart_in = lambda x: x.agg(F.approx_count_distinct("component", 0.02)).first()[0]  # noqa: E731  for the rounds' number only
    several = apart_in(opened)
    for turn in range(ROUNDS):
        x = _beside(opened.where(~medium).select("token", "node", "n", "pos", "component", "block").join(bits, "node"), turn, fits_beside)
        few = F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("node_b", F.lit(turn)).alias("h"), F.col("node_b").alias("y"), F.col("n_b").alias("m"), F.col("component_b").alias("d")))), 1, PARTNERS)
        x = x.groupBy("node", "n", "component").agg(few.alias("p"))
        x = x.select(F.col("node").alias("x"), "n", F.col("component").alias("c"), F.explode("p").alias("p")).select("x", "n", "c", "p.y", "p.m", "p.d")
        partners = promising(x.distinct()).withColumn("sure", F.lit(False))
        pairs = materialise(partners if turn else met_in_medium.unionByName(partners), "next-pairs")
        sets = with_sets(pairs.where("not sure"), sets)
        release(spark)
        found = new_links(pairs, sets, None if turn else apart)
        met_links, none = found.count() > LINKING * pairs.count(), found.isEmpty()
        discard(pairs)
        if not none:
            grown = materialise(_relabelled(comp, connected_components(found)), "merged-components")
            discard(comp)
            comp = grown
            still = materialise(open_lists(opened.select(*members), comp), "open-lists")
            discard(opened)
            opened = still
        discard(found)
        release(spark)
        were, several = several, apart_in(opened)
        if none or (several > MERGING * were and not met_links):
            break

    # what is left: members of different components of long lists, exactly
    carried = F.when(F.size("prefix") <= SHORT_PREFIX, F.col("prefix"))
    left = with_inter(opened.where(~medium)).join(prefixes.select("node", carried.alias("prefix")), "node").join(bits, "node")
    left = materialise(left, "open-members")
    release(spark)
    # short prefixes travel with the postings: a pair is made once, at its first common token, and only if enough tokens follow
    both = F.array_intersect("prefix_a", "prefix_b")
    fine &= (_differ("bits_a", "bits_b") <= na + nb - 2 * need(na, nb)) & F.coalesce((F.size(both) >= common(na, nb)) & (F.get(both, F.lit(0)) == F.col("token_a")), F.lit(True))
    a, b = joined(left, (*carry, "prefix", "bits"))
    pairs = materialise(paired(a.withColumn("token_a", F.col("token")), b, fine), "last-pairs")
    discard(left)
    release(spark)
    sets = with_sets(pairs.where("not sure"), sets)
    found = new_links(pairs, sets, None)
    if not found.isEmpty():
        grown = materialise(_relabelled(comp, connected_components(found)), "components")
        discard(comp)
        comp = grown

    nodes = materialise(holders.join(comp, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "nodes")
    for used in (found, pairs, opened, bits, first, prefixes, shared, sets, comp, holders):
        discard(used)
    release(spark)
    labels = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = nodes.join(labels, "component").select("node", "component_id")
    out = documents.where("n > 0").join(labelled, "node").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(documents.where("n = 0").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of docs: that of the smallest id, null ids last, then of the smallest hash of the text.

    A row without words is a component of its own and stays. Of rows that repeat both the id and the text of the one that
    stays, any one does, whatever their other columns hold. Columns keep their names, whatever these are. Empty table: empty result.
    """
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # no column's name can clash
    columns, ident = docs.schema["row"].dataType.names, F.col("row")[id_col]
    content = F.xxhash64(F.col("row")[text_col])
    key = F.struct(ident.isNull().alias("without"), ident.alias("id"), content.alias("content"))
    found = jaccard_components(docs.select(key.alias("near_key"), F.col("row")[text_col].alias("near_text")), width, percent, "near_key", "near_text")
    per_key = found.where("n_shingles > 0").groupBy("near_key").agg(F.max(F.col("near_key") != F.col("component_id")).alias("copy"), F.count("*").alias("rows"))
    told = materialise(per_key.where("copy or rows > 1").select("near_key.id", "near_key.content", "copy"), "near-copies")
    few = told.count() <= BROADCAST_ROWS

    def matched(x: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        return x.join(F.broadcast(rows) if few else rows, ident.eqNullSafe(rows["id"]) & (content == rows["content"]), how)

    kept, repeated = matched(docs, told.where("copy"), "left_anti"), told.where("not copy")
    if not repeated.isEmpty():
        once = matched(kept, repeated, "left_semi").withColumns({"id": ident, "content": content}).dropDuplicates(["id", "content"])
        kept = matched(kept, repeated, "left_anti").unionByName(once.select("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in columns))


#: DuckDB: the rows of op7, from all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
c AS (SELECT reach.x AS r, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""
