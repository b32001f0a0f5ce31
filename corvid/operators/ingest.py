"""From landed pages to corpus rows: validation reasons, first-wins merge, quality rules and the decision to publish."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import html as H
from corvid.functions.text import ARABIC, CJK, carries_commentary, dedupe_form, grounded, let, match_form

# The smallest matn, and the share of the present corpus that a run must reach.
LEAST_MATN, SHRINK_FLOOR = 60, 0.5
# From so many rows on, the share of rows that must carry a full matn; a routing corpus has as many entries.
LEAST_RUN, FULL_SHARE = 100, 0.9


def has_arabic(c: Column | str) -> Column:
    return F.rlike(c if isinstance(c, Column) else F.col(c), F.lit(ARABIC))


def collapse_repeats(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST_MATN, form=dedupe_form) -> DataFrame:
    """(id, text): lines whose dedupe form is empty go, and later copies of forms of `least` characters or more. Each row stands alone; one without lines goes.

    A row's lines stay in its row: their forms are sorted there, so that copies are neighbours.
    """
    entries = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda v, n: F.struct(form(v).alias("k"), n.alias("pos"), v.alias("line")))
    place = lambda x: F.transform(x, lambda v: F.struct(v["pos"], v["line"]))
    firsts = lambda x: F.filter(x, lambda v, n: (n == 0) | (F.get(x, n - 1)["k"] != v["k"]))

    def kept(x: Column) -> Column:
        long = let(F.sort_array(F.filter(x, lambda v: (v["k"] != "") & (F.length(v["k"]) >= least))), firsts)
        short = F.filter(x, lambda v: (v["k"] != "") & (F.length(v["k"]) < least))
        return F.array_join(F.transform(F.sort_array(F.concat(place(long), place(short))), lambda v: v["line"]), "\n")

    # a filter on what explode gives isn't moved before it, where the text would be made twice
    return docs.select(id_col, F.explode_outer(F.array(let(entries, kept))).alias("text")).where("text <> ''")


def page_reason(page: Column | str, url: Column | str, least: int = 80, references: int = 2, key: str = "mainId", arabic: bool = True, rules: H.Rules = H.GIVEN) -> Column:
    """Why a page isn't usable, in order of the checks; null if it is."""
    p, u = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (page, url))
    text = H.clean(H.main_html(p), rules=rules)
    wanted = H.query_parameter(u, key)
    own = F.size(F.regexp_extract_all(p, F.concat(F.lit(f"(?i){key}="), wanted, F.lit("(?![0-9])")), F.lit(0)))
    out = F.when(F.btrim(p) == "", "empty-response").when(F.rlike(p, F.lit(H.BLOCKED)), "block-page")
    if arabic:
        out = out.when(~has_arabic(text), "no-arabic-content")
    out = out.when(F.rlike(text, F.lit(H.SOFT_ERROR)) & (F.length(text) < 900), "site-error-page")
    out = out.when((wanted != "") & (own < references), "page-does-not-reference-itself")
    return out.when(F.length(text) < least, "too-short")


def links(pages: DataFrame, id_col: str, url_col: str, html_col: str, origins: list[str], route: str | None = None, most: int | None = None) -> DataFrame:
    """(id, pos, url, label): resolved links of allowed origins, first of each, in page order."""
    a = pages.select(id_col, F.col(url_col).alias("_base"), F.posexplode(H.anchors(F.coalesce(F.col(html_col), F.lit("")))).alias("pos", "a"))
    x = a.select(id_col, "pos", H.absolute_url("a.href", "_base").alias("url"), H.clean("a.label").alias("label")).where(F.col("url").isNotNull())
    x = x.where(F.exists(F.array(*map(F.lit, origins)), lambda o: F.startswith(F.col("url"), o))) if origins else x
    x = x.where(F.rlike("url", F.lit(f"(?i){route}"))) if route else x
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(id_col, "url").orderBy("pos"))).where("_n = 1").drop("_n")
    if most is not None:
        x = x.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))).where(F.col("_n") <= most).drop("_n")
    return x


def subject_links(pages: DataFrame, id_col: str, url_col: str, html_col: str, origins: list[str], route: str, most: int = 40, arabic: bool = True) -> DataFrame:
    """(id, pos, url, title): links of a listing page whose label says something, distinct by url and label's form, in page order.

    The first `most` distinct links stay. Nulls: a null page has no links. Repeated pages: each id has its own.
    """
    a = pages.select(id_col, F.col(url_col).alias("_base"), F.posexplode(H.anchors(F.coalesce(F.col(html_col), F.lit("")))).alias("pos", "a"))
    x = a.select(id_col, "pos", H.absolute_url("a.href", "_base").alias("url"), result_title("a.label")["snippet"].alias("title"))
    x = x.where(F.exists(F.array(*map(F.lit, origins)), lambda o: F.startswith(F.col("url"), o)) & F.rlike("url", F.lit(f"(?i){route}")) & (F.col("title") != ""))
    x = (x.where(has_arabic("title")) if arabic else x).withColumn("_k", dedupe_form("title") if arabic else F.lower("title"))
    first = x.groupBy(id_col, "url", "_k").agg(F.min_by(F.struct("pos", "title"), "pos").alias("v")).select(id_col, "v.pos", "url", "v.title")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))).where(F.col("_n") <= most).drop("_n")


def best_links(found: DataFrame, id_col: str, service: str, most: int = 3) -> DataFrame:
    """(id, rank, url): the best `most` links of a page: the wanted service's first, then service pages, then others, each in page order."""
    order = Window.partitionBy(id_col).orderBy(commentary_rank("url", service), "pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(id_col, "rank", "url")


def discover(pages: DataFrame, links_: DataFrame, seeds: DataFrame, most: int = 100_000, depth: int = 10, kept=None) -> DataFrame:
    """(url, depth): landed pages that links reach from the seeds (url), breadth first, each at its least depth.

    links_: (source, url). A level's pages are those that the level before links to and that no level has; each level is written, and the visited ones
    are told apart by an anti join, so cycles end. Levels stop at depth, or where `most` pages have been met: the level that crosses it is cut by url.
    Pages that haven't landed aren't met. Nulls and repeats in any table are ignored.
    """
    from corvid.sources import Kept

    kept = kept or Kept(pages.sparkSession)
    landed = pages.select("url").where("url is not null").distinct()
    level = kept(seeds.select("url").distinct().join(landed, "url", "left_semi").orderBy("url").limit(most).withColumn("depth", F.lit(0)), "frontier")
    met, n = level, level.count()
    for d in range(1, depth + 1):
        new = links_.join(level.select(F.col("url").alias("source")), "source", "left_semi").select("url").distinct()
        new = new.join(landed, "url", "left_semi").join(met, "url", "left_anti")
        if (left := most - n) <= 0:
            break
        new = new if new.limit(left + 1).count() <= left else new.orderBy("url").limit(left)
        level = kept(new.withColumn("depth", F.lit(d)), "frontier")
        if not (grown := level.count()):
            break
        met, n = met.unionByName(level), n + grown
    return met


def duplicate_keys(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, key, n) of values that more than one row has; nulls are no values. columns: name -> expression as text."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("column"), c.cast("string").alias("key")) for n, c in columns.items())))
    return rows.select(each.alias("v")).select("v.*").where("key is not null").groupBy("column", "key").agg(F.count("*").alias("n")).where("n > 1")


def useful_page(page: Column | str, least: int = 80, arabic: bool = True, rules: H.Rules = H.GIVEN) -> Column:
    """The main text is long enough, Arabic, and no block page's."""
    text = H.clean(H.main_html(F.coalesce(F.col(page) if isinstance(page, str) else page, F.lit(""))), rules=rules)
    out = (F.length(text) >= least) & ~F.rlike(text, F.lit(H.BLOCKED))
    return out & has_arabic(text) if arabic else out


def commentary_rank(url: Column | str, service: str) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.when(H.query_parameter(u, "serviceId") == service, 0).when(F.rlike(u, F.lit("(?i)ViewServicePage")), 1).otherwise(2)


def keyword_seeds(title: Column, topics: Column, most: int = 16) -> Column:
    long = F.filter(F.split(H.clean(title), "\\s+"), lambda w: F.length(w) >= 4)
    return F.slice(F.array_distinct(F.concat(F.slice(long, 1, 10), topics)), 1, most)


def merge(records: DataFrame, prefix: str = "chunk-", most: int = 24) -> DataFrame:
    """Corpus rows of records (ord, title, text, hadithFullText, explanationText, topics), by order of arrival.

    The text is matn, explanation and page text, each once; under 35 characters or without Arabic a record is dropped. The
    first of equal keys gives the row; later ones add their topics in turn, and their keywords only if their topics were new.
    Ids count the surviving rows. Keys are spread by hash; a key's records meet only as their short topic lists.
    """
    none = F.array().cast("array<string>")
    x = records.withColumns({c: H.clean(F.coalesce(c, F.lit("")), tags=True) for c in ("text", "hadithFullText", "explanationText")})
    full, extra = dedupe_form("hadithFullText"), dedupe_form("text")
    own = F.when((extra != "") & (extra != full) & ~((full != "") & F.contains(full, extra)), F.col("text"))
    x = x.withColumn("combined", F.array_join(F.filter(F.array("hadithFullText", "explanationText", F.coalesce(own, F.lit(""))), lambda v: v != ""), "\n\n"))
    x = x.where((F.length("combined") >= 35) & has_arabic("combined"))
    x = x.withColumns({"key": F.sha2(dedupe_form(F.coalesce(F.nullif("hadithFullText", F.lit("")), "combined")), 256), "topics": F.array_distinct(F.coalesce("topics", none))})
    x = x.withColumn("seeds", keyword_seeds(F.coalesce("title", F.lit("")), F.col("topics")))
    start = F.struct(none.alias("topics"), none.alias("keywords"))

    def add(a, v):
        grown = F.array_distinct(F.concat(a["topics"], v["topics"]))
        new = F.when(F.size(grown) > F.size(a["topics"]), F.slice(F.array_distinct(F.concat(a["keywords"], v["seeds"])), 1, most)).otherwise(a["keywords"])
        return F.struct(grown.alias("topics"), new.alias("keywords"))

    folded = x.groupBy("key").agg(F.min("ord").alias("ord"), F.count("*").alias("merged"), F.aggregate(F.sort_array(F.collect_list(F.struct("ord", "topics", "seeds"))), start, add).alias("m"))
    kept = x.drop("topics", "seeds", "key").join(folded, "ord")
    # dense numbers without a single sort: ranks within ranges of ord, plus the ranges before
    return _numbered(kept, prefix).select("id", "ord", "title", F.col("combined").alias("text"), "hadithFullText", "explanationText", "m.topics", "m.keywords", (F.col("merged") - 1).alias("duplicates"))


def _numbered(x: DataFrame, prefix: str, span: int = 65536) -> DataFrame:
    """Dense ids by ord, null ords last: ranks within blocks of ord values, plus the counts of the blocks before (a table of blocks). Ids beyond six digits grow."""
    x = x.withColumn("_b", F.floor(F.col("ord") / span))
    last = F.asc_nulls_last("_b")
    before = x.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(last).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_b").alias("_k"), "_before")
    n = F.row_number().over(Window.partitionBy("_b").orderBy("ord"))
    number = (F.col("_before") + F.col("_r")).cast("string")
    joined = x.withColumn("_r", n).join(before, F.col("_b").eqNullSafe(F.col("_k")))
    return joined.withColumn("id", F.concat(F.lit(prefix), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number))).drop("_b", "_k", "_r", "_before")


def violations(chunks: DataFrame, source_id: str, official: str, detail: str, listing: str, key: str = "mainId") -> DataFrame:
    """(ord, id, rule) of every quality rule that a row breaks; official, detail and listing are the site's prefix and routes."""
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    matn, text, url = s("hadithFullText"), s("text"), s("sourceUrl")
    shown = matn != ""
    again = F.row_number().over(Window.partitionBy(F.when(shown, F.sha2(match_form(matn), 256)).otherwise(F.concat(F.lit("#"), F.col("ord").cast("string")))).orderBy("ord")) > 1
    x = chunks.withColumn("_again", again)
    rules = {
        "wrong source": s("sourceId") != source_id,
        "role": s("role") != "evidence",
        "excerpt type": s("excerptType") != "literal",
        "text too short": F.length(text) < 35,
        "text has no Arabic": ~has_arabic(text),
        "CJK": F.rlike(F.concat_ws(" ", text, matn, s("explanationText")), F.lit(CJK)),
        "markup": F.rlike(text, F.lit("(?is)<[a-z].*>")),
        "url in text": F.rlike(text, F.lit("(?i)https?://")),
        "url not official": ~F.startswith(url, F.lit(official)),
        "url not a detail page": ~F.rlike(url, F.lit(f"(?i){detail}")),
        "url is a listing": F.rlike(url, F.lit(f"(?i){listing}")),
        "url without id": ~F.rlike(url, F.lit(f"(?i)[?&]{key}=[0-9]+")),
        "provenance": ~F.col("htmlIngestion.method").eqNullSafe("official-html"),
        "no topics": F.size(F.coalesce("topics", F.array().cast("array<string>"))) == 0,
        "matn has no Arabic": shown & ~has_arabic(matn),
        "matn short": shown & (F.length(matn) < LEAST_MATN),
        "excerpt not grounded": shown & (s("hadithText") != "") & ~grounded("hadithText", "hadithFullText", match_form),
        "matn has commentary": shown & carries_commentary("hadithFullText"),
        "matn repeated": shown & F.col("_again"),
        "explanation without url": (s("explanationText") != "") & (s("explanationSourceUrl") == ""),
        "explanation url not official": (s("explanationText") != "") & (s("explanationSourceUrl") != "") & ~F.startswith(s("explanationSourceUrl"), F.lit(official)),
        "explanation has no Arabic": (s("explanationText") != "") & ~has_arabic("explanationText"),
        "url without explanation": (s("explanationSourceUrl") != "") & (s("explanationText") == ""),
    }
    return x.select("ord", "id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("rule"))


def topic_counts(rows: DataFrame, topics: DataFrame, column: str = "topics") -> DataFrame:
    """Rows of each required topic (topics.id), zero where there are none."""
    n = rows.select(F.explode(column).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return topics.select("id").join(n, "id", "left").fillna(0, ["n"])


def assess(rows: Column, weak: Column, existing: Column, minimum: int, shrink_ok: bool = False, full: Column | None = None) -> Column:
    """Why a run mustn't be published: too few rows, topics that are too thin, too few rows with a full matn (`full` counts them; from
    100 rows on), or a shrink of a corpus that was large enough; null if it may."""
    out = F.when(rows < minimum, "too-few-rows").when(weak > 0, "weak-topics")
    if full is not None:
        out = out.when((rows >= LEAST_RUN) & (F.coalesce(full, F.lit(0)) / F.nullif(rows, F.lit(0)) < FULL_SHARE), "few-full-texts")
    return out if shrink_ok else out.when((existing >= minimum) & (rows < existing * SHRINK_FLOOR), "shrunk")


def full_texts(full: Column | str = "hadithFullText") -> Column:
    """Aggregate: how many rows carry a full matn."""
    c = F.col(full) if isinstance(full, str) else full
    return F.count_if(F.coalesce(c, F.lit("")) != "")


def distinct_texts(rows: DataFrame, order: str, source: str = "sourceId", text: str = "text") -> DataFrame:
    """The first row, by a unique order, of each source and text with white space collapsed; empty texts go."""
    collapsed = F.btrim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(" ")), "(?U)[\\s\\x1c-\\x1f]+", " "))
    x = rows.select(order, source, collapsed.alias("_t")).where("_t <> ''")
    return rows.join(x.groupBy(source, F.sha2("_t", 256)).agg(F.min(order).alias(order)).select(order), order, "left_semi")


def short_sources(rows: DataFrame, minimums: DataFrame, source: str = "sourceId") -> DataFrame:
    """(source, n, minimum) of the sources of minimums that have fewer rows than their minimum, none included."""
    n = rows.groupBy(source).agg(F.count("*").alias("n"))
    return minimums.select(source, "minimum").join(n, source, "left").fillna(0, ["n"]).where("n < minimum").select(source, "n", "minimum")


def _broken(x: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    return x.select(*keep, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("rule"))


def manifest_violations(manifest: DataFrame, source_id: str, official: str, topics: int = 12) -> DataFrame:
    """(rule) that a manifest breaks: sourceId, baseUrl, targets (url, topicIds), requiredTopicIds, allowedOrigins and four limits. Limits and origins that are absent pass."""
    none = F.array().cast("array<string>")
    known = F.array_distinct(F.coalesce("requiredTopicIds", none))
    any_target = lambda f: F.coalesce(F.exists("targets", f), F.lit(False))
    ids = lambda t: F.coalesce(t["topicIds"], none)
    least = {"minimumChunks": 100, "minimumChunksPerTopic": 3, "maxSubjectResults": 28, "fetchAttempts": 1}
    rules = {
        "wrong source": ~F.col("sourceId").eqNullSafe(source_id),
        "base url": ~F.col("baseUrl").eqNullSafe(official),
        "too few targets": F.coalesce(F.size("targets"), F.lit(-1)) < 8,
        "topics": F.size(known) != topics,
        "target not official": any_target(lambda t: ~F.startswith(F.coalesce(t["url"], F.lit("")), F.lit(official))),
        "target without topics": any_target(lambda t: F.size(ids(t)) == 0),
        "target with unknown topic": any_target(lambda t: F.exists(ids(t), lambda i: ~F.coalesce(F.array_contains(known, i), F.lit(False)))),
        "allowed origins": F.col("allowedOrigins").isNotNull() & ~F.col("allowedOrigins").eqNullSafe(F.array(F.lit(official))),
    } | {c: F.col(c) < n for c, n in least.items()}
    return _broken(manifest, [], rules)


def provenance_violations(chunks: DataFrame, official: str) -> DataFrame:
    """(ord, id, rule) of converted documents' rows: a missing field, or else the role and the provenance; and inputs (sourceFile) from elsewhere on the web."""
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    required = ("id", "sourceId", "text", "excerptType", "role", "sourceUrl", "docling")
    whole = F.forall(F.array(*(F.col(c).isNotNull() for c in required)), lambda v: v)
    rules = {f"missing {c}": F.col(c).isNull() for c in required} | {
        "role": whole & (s("role") != "evidence"),
        "document provenance": whole & (s("docling.documentHash") == "") & (s("docling.sourceFile") == ""),
        "heading provenance": whole & (F.size(F.coalesce("docling.headings", F.array().cast("array<string>"))) == 0) & (s("chapter") == ""),
        "input not official": F.rlike(s("sourceFile"), F.lit("^https?://")) & ~F.startswith(s("sourceFile"), F.lit(official)),
    }
    return _broken(chunks, ["ord", "id"], rules)


def routing_violations(chunks: DataFrame, topics: DataFrame, official: str) -> DataFrame:
    """(rule, detail) of a routing corpus: fewer than 100 entries, no entry of role index, required topics (topics.id) without rows, urls from elsewhere."""
    total = chunks.agg(F.count("*").alias("n"), F.count_if(F.col("role") == "index").alias("i"))
    few = total.where(F.col("n") < LEAST_RUN).select(F.lit("too few entries").alias("rule"), F.col("n").cast("string").alias("detail"))
    unmarked = total.where("i = 0").select(F.lit("no index role").alias("rule"), F.lit(None).cast("string").alias("detail"))
    missing = topic_counts(chunks, topics).where("n = 0").select(F.lit("missing topic").alias("rule"), F.col("id").alias("detail"))
    url = F.coalesce("sourceUrl", F.lit(""))
    other = chunks.where((url != "") & ~F.startswith(url, F.lit(official))).select(F.lit("url not official").alias("rule"), url.alias("detail"))
    return few.unionByName(unmarked).unionByName(missing).unionByName(other)


def quota(pages: DataFrame, order: str, attempts: str, limit: int) -> DataFrame:
    """granted: how many attempts each row gets of a global quota, in order; the row that crosses it is cut.

    Sums of blocks of the order come first, so that only their totals meet in one place.
    """
    x = pages.withColumn("_b", F.floor(F.col(order) / 65536))
    blocks = x.groupBy("_b").agg(F.sum(attempts).alias("_s")).withColumn("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_p")
    own = F.coalesce(F.sum(attempts).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_own", own).join(blocks, "_b")
    return x.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(attempts), F.lit(limit) - F.col("_p") - F.col("_own"))).cast("long")).drop("_b", "_own", "_p")


def repair_matn(chunks: DataFrame) -> DataFrame:
    """Split stored matns again; what was commentary becomes the explanation, if there is none and it is long enough. Idempotent."""
    split = H.split_commentary(F.coalesce("hadithFullText", F.lit("")))
    x = chunks.withColumn("_s", F.when(F.coalesce("hadithFullText", F.lit("")) != "", split))
    moves = F.coalesce(F.col("_s.cut"), F.lit(False)) & (F.coalesce("explanationText", F.lit("")) == "") & (F.length(dedupe_form("_s.commentary")) >= LEAST_MATN)
    return x.withColumns({"explanationText": F.when(moves, F.col("_s.commentary")).otherwise(F.col("explanationText")), "hadithFullText": F.when(F.col("_s.cut"), F.col("_s.matn")).otherwise(F.col("hadithFullText"))}).drop("_s")


def result_title(raw: Column | str, suffixes: tuple[str, ...] | None = None) -> Column:
    """struct<ordinal, snippet, book> of a result's title: '12 - words' and, on its last line, a book's name."""
    from corvid.lexicon.framing import BOOK_SUFFIXES

    books = suffixes or BOOK_SUFFIXES
    book_end = f"(?:{'|'.join(map(re.escape, books))})$"
    c = F.col(raw) if isinstance(raw, str) else raw
    lines = F.filter(F.transform(F.split(H.clean(F.coalesce(c, F.lit(""))), "\n+"), lambda v: F.btrim(v)), lambda v: v != "")
    head = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    ordinal = F.regexp_extract(head, "^(\\d{1,5})\\s*[-–—:]\\s*(.*)$", 1)
    rest = F.when(ordinal != "", F.btrim(F.regexp_extract(head, "^(\\d{1,5})\\s*[-–—:]\\s*(.*)$", 2))).otherwise(head)
    first = F.coalesce(F.get(F.filter(lines, lambda v: ~F.rlike(v, F.lit("^\\d{1,5}\\s*[-–—:]\\s*$"))), F.lit(0)), F.array_join(lines, " "))
    snippet = F.regexp_replace(F.regexp_replace(F.btrim(F.regexp_replace(F.coalesce(F.nullif(rest, F.lit("")), first), "^\\d{1,5}\\s*[-–—]\\s*", "")), book_end, ""), "[،,:;\\s]+$", "")
    book = F.when(F.size(lines) > 1, F.regexp_extract(F.element_at(lines, -1), book_end, 0)).otherwise("")
    return F.struct(ordinal.alias("ordinal"), snippet.alias("snippet"), book.alias("book"))
