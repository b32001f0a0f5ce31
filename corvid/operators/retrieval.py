"""Evidence-gated lexical retrieval as joins and aggregates.

Document frequencies are kept by source, so that those of a scope (the sources and kinds of text that a query is restricted to) are sums. A query meets
a chunk only through an index join on token forms, or on grams of whole phrases and keywords.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import canonical, forms, let, py_search_form, search_form, stemmed, token_set, tokens, variants
from corvid.lexicon import words
from corvid.sources import Kept

from .evidence import CAP, KEYWORD, best_of_sources
from .registry import approved, passage, retrievable, small
from .substrings import containing

# Limits and weights of the scoring.
MOST, LEAST_TEXT, RARE_SHARE, RARE_LEAST, STEM, RARITY_CAP = 4, 40, 0.02, 3.0, 2.5, 6.0
#: Up to so many forms that queries ask for, texts keep no others.
MOST_FORMS = 20_000


def _in(x: Column, values) -> Column:
    return x.isin(*sorted(set(values)))


def generic(token: Column) -> Column:
    return _in(token, words.GENERIC_TOKENS)


def document_frequency(chunks: DataFrame, text: str = "text", keywords: str | None = "keywords", key: list[str] | None = None) -> DataFrame:
    """(key..., form, df): in how many rows a token form occurs, in the text or the keywords, once a row."""
    sets = [token_set(F.coalesce(F.col(text), F.lit("")))]
    if keywords:
        sets.append(F.flatten(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), tokens)))
    all_forms = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.concat(*sets)), variants)))  # a token is stemmed once a row
    return chunks.select(*(key or []), F.explode(all_forms).alias("form")).groupBy(*(key or []), "form").agg(F.count("*").alias("df"))


def rarity(n: Column, df: Column) -> Column:
    return F.least(F.lit(RARITY_CAP), 1 + F.log2((n + 1) / F.greatest(df, F.lit(1))))


def topics_of(queries: DataFrame, topics: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, topic_id, order, score, rank): two for each matching synonym, one for each keyword the query contains; the best `most`.

    A one-word synonym of three characters or fewer must be a whole form of a query token; others match as a substring, or if all of two or more
    of their longer tokens share a form with the query. Each of the three ways is a join on forms or grams, so queries don't meet topics
    that they share nothing with.
    """
    asked = F.coalesce("query", F.lit(""))
    q = queries.select("query_id", search_form(asked).alias("norm"), tokens(asked).alias("t")).where("norm <> ''").distinct()
    q_forms = q.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("t", forms)))).alias("form"))
    q = q.select("query_id", "norm")
    t = topics.select(F.col("id").alias("topic_id"), "order", "synonyms", "keywords")
    s = t.select("topic_id", "order", F.posexplode("synonyms").alias("place", "synonym")).withColumn("n", search_form("synonym"))
    short = (F.col("n") != "") & ~F.contains("n", F.lit(" ")) & (F.length("n") <= 3)
    key = ["query_id", "topic_id", "order", "place"]
    whole = q_forms.join(small(s.where(short).select("topic_id", "order", "place", F.col("n").alias("form"))), "form").select(key)
    part = containing(q, s.where(~short).select("topic_id", "order", "place", "n"), "norm", "n").select(key)
    longer = F.filter(tokens("synonym"), lambda v: F.length(v) >= 3)
    apart = s.where(~short).select("topic_id", "order", "place", longer.alias("longer")).where(F.size("longer") >= 2)
    apart = apart.select("topic_id", "order", "place", F.size("longer").alias("wanted"), F.posexplode("longer").alias("k", "token"))
    apart = apart.select("topic_id", "order", "place", "wanted", "k", F.explode(forms(F.col("token"))).alias("form"))
    apart = q_forms.join(small(apart), "form").groupBy(*key, "wanted").agg(F.count_distinct("k").alias("met")).where("met = wanted").select(key)
    synonyms = whole.unionByName(part).unionByName(apart).distinct().withColumn("score", F.lit(2))
    k = t.select("topic_id", "order", F.posexplode("keywords").alias("place", "keyword")).select("topic_id", "order", "place", search_form("keyword").alias("k"))
    keywords = containing(q, k, "norm", "k").select(*key, F.lit(1).alias("score"))
    x = synonyms.unionByName(keywords).groupBy("query_id", "topic_id", "order").agg(F.sum("score").cast("int").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "order")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def named_sources(queries: DataFrame, library: DataFrame) -> DataFrame:
    """(query_id, source_id, by_author, author_tokens) of the sources that a query names by an author's or two of a title's tokens."""
    ignored = {f for w in words.IGNORED_AUTHOR_TOKENS if (f := py_search_form(w))}
    stems = library.sparkSession.createDataFrame([(w,) for w in sorted(ignored)], "w string").select(canonical(F.col("w")).alias("w")).collect()  # the fixed list
    ignored |= {r[0] for r in stems if r[0]}
    author = F.filter(tokens("author"), lambda t: (F.length(t) >= 3) & ~_in(t, ignored))
    title = F.filter(tokens("title"), lambda t: (F.length(t) >= 4) & ~_in(t, ignored) & ~generic(t))
    parts = F.concat(F.transform(author, lambda t: F.struct(F.lit(True).alias("author"), t.alias("token"))), F.transform(title, lambda t: F.struct(F.lit(False).alias("author"), t.alias("token"))))
    named = library.select(F.col("id").alias("source_id"), F.posexplode(parts).alias("place", "part")).select("source_id", "place", "part.*")
    q = queries.select("query_id", search_form(F.coalesce("query", F.lit(""))).alias("norm")).distinct()
    x = containing(q, named, "norm", "token").groupBy("query_id", "source_id").agg(F.collect_set(F.when(F.col("author"), F.col("token"))).alias("author_tokens"), F.count_if(~F.col("author")).alias("title_hits"))
    return x.where((F.size("author_tokens") > 0) | (F.col("title_hits") >= 2)).select("query_id", "source_id", (F.size("author_tokens") > 0).alias("by_author"), F.sort_array("author_tokens").alias("author_tokens"))


def scripture_request(norm: Column) -> Column:
    """The query asks for the meaning of, or names, a verse or chapter."""
    has = lambda values: F.rlike(norm, F.lit("|".join(sorted({py_search_form(v) for v in values}))))
    return has(words.QURAN_HINTS) & (has(words.QURAN_CUES) | F.rlike(norm, F.lit("(?:سوره|سورة|ايه|آيه|اية|آية)\\s*(?:[0-9]+|[ء-ي]{2,})")))


def scope_statistics(index: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(df by form, source and verse flag; rows by source and verse flag), each with its sums over all sources under a null source.

    A row belongs to one source, so a scope's figures are sums over its sources, and no scope needs a pass of its own.
    """
    df = index.groupBy("form", "sourceId", "verse").agg(F.count("*").alias("df"))
    n = corpus.groupBy("sourceId", "verse").agg(F.count("*").alias("n"))
    everywhere = F.lit(None).cast("string").alias("sourceId")
    df = df.unionByName(df.groupBy("form", "verse").agg(F.sum("df").alias("df")).select("form", everywhere, "verse", "df"))
    return df, n.unionByName(n.groupBy("verse").agg(F.sum("n").alias("n")).select(everywhere, "verse", "n"))


def _whole(corpus: DataFrame, index: DataFrame, asked: DataFrame, t: DataFrame, kept: Kept) -> DataFrame:
    """(ord, whole: names of the queries of six characters or more that the chunk's text holds in search form).

    A text that holds a query holds each word between two blanks of it, so only texts with the rarest of these are read. Queries without such a word
    are looked up in all texts.
    """
    p = asked.where(F.length("norm") >= 6)
    inner = F.expr("slice(split(norm, ' '), 2, greatest(size(split(norm, ' ')) - 2, 0))")
    words_ = p.select("query_id", F.explode(token_set(F.array_join(inner, " "))).alias("token"))
    rarest = words_.join(t.where("form = token").select("query_id", "token", "df"), ["query_id", "token"]).groupBy("query_id").agg(F.min(F.struct("df", "token"))["token"].alias("form"))
    rarest = kept(rarest, "rarest-words")
    met = index.select("ord", F.explode(F.concat("kf", "tf")).alias("form")).join(small(rarest), "form").groupBy("ord").agg(F.collect_list("query_id").alias("ids"))
    read = corpus.select("ord", "text").join(small(kept(met, "phrase-texts"), 1_000_000, 128 << 20), "ord").select("ord", search_form("text").alias("body"), "ids")
    held = read.select("ord", "body", F.explode("ids").alias("query_id")).join(small(p), "query_id").where(F.contains("body", "norm")).select("ord", "query_id")
    rest = kept(p.join(rarest, "query_id", "left_anti"), "short-queries")
    if not rest.isEmpty():
        held = held.unionByName(containing(corpus.select("ord", search_form("text").alias("body")), rest, "body", "norm").select("ord", "query_id"))
    return held.groupBy("ord").agg(F.collect_set(F.col("query_id").cast("string")).alias("whole"))


def retrieve(queries: DataFrame, chunks: DataFrame, sources: DataFrame, excluded: DataFrame, topics: DataFrame, most: int = MOST, kept: Kept | None = None) -> DataFrame:
    """The selected passages: query_id, rank, and the passage columns with their score.

    queries: query_id, query. chunks: the corpus with its position `ord`, which breaks ties. The first passage of each source comes first, then the
    others, each by score. At least one row is returned even for a limit under one. Nulls: a null query finds nothing; null texts and keyword lists
    are empty; a null role is evidence. kept: holds the tables that are written for several joins, for the caller to delete.
    """
    kept = kept or Kept(queries.sparkSession)
    none = F.array().cast("array<string>")
    active = retrievable(sources, excluded)
    corpus = approved(chunks, sources, excluded).select("ord", "sourceId", F.coalesce("text", F.lit("")).alias("text"), F.filter(F.coalesce("keywords", none), lambda k: k.isNotNull()).alias("keywords"), F.coalesce("topics", none).alias("topics"), "role", (F.length(F.coalesce("quranText", F.lit(""))) * F.length(F.coalesce("quranReference", F.lit(""))) > 0).alias("verse"))
    library = active.where(F.coalesce("showInLibrary", F.lit(True)))
    q = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query")).withColumn("norm", search_form("query")).where("norm <> ''")
    named = named_sources(q, library).groupBy("query_id").agg(F.sort_array(F.collect_set("source_id")).alias("ids"), F.sort_array(F.collect_set(F.when(F.col("by_author"), F.col("source_id")))).alias("author_ids"), F.array_distinct(F.flatten(F.collect_list("author_tokens"))).alias("author_tokens"))
    matched = topics_of(q, topics).groupBy("query_id").agg(F.collect_list("topic_id").alias("matched"))
    q = q.join(named, "query_id", "left").join(matched, "query_id", "left").fillna({"norm": ""})
    q = q.withColumns({c: F.coalesce(c, none) for c in ("ids", "author_ids", "author_tokens", "matched")})
    cue = F.arrays_overlap(tokens("norm"), F.array(*(F.lit(py_search_form(w)) for w in words.AUTHORITY_HINTS)))
    q = q.withColumn("cue", cue).withColumn("allowed", F.when(F.col("cue") & (F.size("author_ids") > 0), F.col("author_ids")).otherwise(F.col("ids")))
    q = q.where(~F.col("cue") | (F.size("allowed") > 0))
    verses = F.coalesce(corpus.agg(F.max("verse")).scalar(), F.lit(False))
    q = kept(q.withColumn("verse_only", scripture_request(F.col("norm")) & verses), "queries")

    # query tokens, whether they tell anything, and their forms
    t = q.select("query_id", "author_tokens", F.explode(token_set("query")).alias("token"))
    name_forms = library.select(F.explode(F.flatten(F.transform(tokens("author"), variants))).alias("name")).where(F.rlike("name", F.lit("[؀-ۿ]"))).distinct()
    names = t.select("token", F.explode(F.array(F.col("token"), canonical(F.col("token")))).alias("name")).join(small(name_forms), "name", "left_semi").select("token", F.lit(True).alias("is_name")).distinct()
    t = t.join(small(names), "token", "left")
    own_name = F.array_contains("author_tokens", F.col("token")) | F.array_contains("author_tokens", canonical(F.col("token")))
    meaningful = ~generic(F.col("token")) & ~own_name & ((F.size("author_tokens") == 0) | F.col("is_name").isNull())
    t = t.select("query_id", "token", meaningful.alias("meaningful"), F.explode(variants(F.col("token"))).alias("form"))

    # the corpus is tokenised once, for the forms that are asked for and their stems; a scope's frequencies are sums of what its sources have
    sought = t.select(F.explode(F.array(F.col("form"), canonical(F.col("form")))).alias("form")).where("form <> ''").distinct()
    # a chunk stays one row: those of its forms that are sought, and its keywords in search form
    few = [r[0] for r in sought.limit(MOST_FORMS + 1).collect()]
    among = (lambda v: v.isin(*few) if few else F.lit(False)) if len(few) <= MOST_FORMS else lambda v: F.lit(True)
    # only words that may have another stem are stemmed
    both = lambda w: F.concat(F.filter(w, lambda v: ~stemmed(v)), F.filter(F.flatten(F.transform(F.filter(w, stemmed), variants)), among))
    text_forms = F.array_distinct(let(token_set("text", lambda v: among(v) | stemmed(v)), both))
    keyword_forms = F.array_distinct(F.flatten(F.transform(F.flatten(F.transform("keywords", tokens)), variants)))
    signal = lambda kw: F.exists(tokens(kw), lambda x: (F.length(x) >= 3) & ~generic(x))
    keys = F.transform("keywords", lambda kw: F.struct(search_form(kw).alias("key"), signal(kw).alias("flag")))
    traits = (F.col("role").eqNullSafe("index").alias("entry"), (F.length(F.btrim("text")) >= LEAST_TEXT).alias("long"))
    index = corpus.select("ord", "verse", "sourceId", "topics", *traits, keyword_forms.alias("kf"), keys.alias("keys"), text_forms.alias("tf"))
    index = kept(index.select("ord", "verse", "sourceId", "topics", "entry", "long", "keys", "kf", F.array_except("tf", "kf").alias("tf")), "index")
    held = index.select("sourceId", "verse", F.explode(F.concat("kf", "tf")).alias("form")).join(small(sought), "form", "left_semi")
    by_source, sizes = scope_statistics(held, index)
    scope = q.select("query_id", "verse_only", F.explode(F.when(F.size("allowed") > 0, F.col("allowed")).otherwise(F.array(F.lit(None).cast("string")))).alias("source"))
    within = (F.col("source").eqNullSafe(F.col("sourceId"))) & (~F.col("verse_only") | F.col("verse"))
    n = scope.join(small(sizes), within).groupBy("query_id").agg(F.sum("n").alias("n"))
    df = t.select("query_id", "form").join(scope, "query_id").join(by_source.withColumnRenamed("form", "held"), within & (F.col("form") == F.col("held"))).groupBy("query_id", "form").agg(F.sum("df").alias("df"))
    t = kept(t.join(df, ["query_id", "form"], "left").join(n, "query_id", "left").withColumns({"df": F.coalesce("df", F.lit(0)), "n": F.coalesce("n", F.lit(1))}), "query-tokens")
    # tokens of a query by how telling they are
    kinds = t.groupBy("query_id", "token").agg(F.first("meaningful").alias("meaningful"), (F.max("df") <= F.greatest(F.lit(RARE_LEAST), RARE_SHARE * F.first("n"))).alias("rare")).withColumn("distinctive", F.col("meaningful") & F.col("rare"))
    totals = kinds.groupBy("query_id").agg(F.count_if("meaningful").alias("n_meaningful"), F.count_if("distinctive").alias("n_distinctive"))

    # what a query looks for in a chunk: forms of its tokens, by weight (in the text, among the keywords); keywords that it contains; itself as a phrase
    asked = q.select("query_id", "norm")
    own = t.select("query_id", "token", "form", rarity(F.col("n"), F.col("df")).alias("plain"), F.greatest(rarity(F.col("n"), F.col("df")), F.lit(KEYWORD)).alias("listed"))
    stem = t.select("query_id", "token", canonical(F.col("form")).alias("form"), F.lit(STEM).alias("plain"), F.lit(STEM).alias("listed")).where("form <> ''")
    wanted = own.unionByName(stem).groupBy("query_id", "token", "form").agg(F.max("plain").alias("plain"), F.max("listed").alias("listed")).join(kinds, ["query_id", "token"])
    telling = ~generic(F.col("token"))
    name = F.col("query_id").cast("string").alias("name")
    wanted = wanted.select(F.lit("t").alias("kind"), F.col("form").alias("key"), name, "token", "plain", "listed", telling.alias("telling"), (telling & F.col("distinctive")).alias("distinctive"))
    bare = (F.lit("").alias("token"), F.lit(0.0).alias("plain"), F.lit(0.0).alias("listed"), F.lit(False).alias("telling"), F.lit(False).alias("distinctive"))
    met = containing(asked, kept(index.select(F.explode("keys.key").alias("key")).distinct(), "keywords"), "norm", "key")
    wanted = wanted.unionByName(met.select(F.lit("k").alias("kind"), "key", name, *bare))
    phrase = _whole(corpus, index, asked, t, kept)

    # evidence: chunks are dealt by their place once, and weighed where they lie
    chunk = ("ord", "sourceId", "verse", "entry", "long", "topics", "kf", "tf", "keys")
    x = index.repartition("ord").join(small(kept(phrase, "phrases")), "ord", "left").select(*chunk, F.coalesce("whole", none).alias("whole"))
    asking = q.join(totals, "query_id", "left").select("query_id", F.col("query_id").cast("string").alias("name"), "verse_only", "allowed", "matched", "n_meaningful", "n_distinctive")
    e = best_of_sources(x, kept(wanted, "wanted"), asking, max(1, min(most, MOST)))
    picked = diversified(e, "query_id", "sourceId", "score", "ord", most)
    found = chunks.alias("c").join(small(kept(picked, "picked")).alias("p"), F.col("c.ord") == F.col("p.ord")).join(small(active).alias("s"), F.col("c.sourceId") == F.col("s.id"))
    return found.select("p.query_id", "p.rank", "c.ord", *passage(F.col("p.score")))


def diversified(scored: DataFrame, query: str, source: str, score: str, tie: str, most: int = MOST) -> DataFrame:
    """Best row of each source first, then the rest, each by score and then tie: the first max(1, min(most, MOST)) a query, with rank.

    No later row of a source than that is ever among them, so the others go before anything is shuffled.
    """
    most = max(1, min(most, MOST))
    best = Window.partitionBy(query, source).orderBy(F.desc(score), tie)
    x = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most)
    order = Window.partitionBy(query).orderBy((F.col("_r") > 1).cast("int"), F.desc(score), tie)
    return x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_r")


def keywords_of(queries: DataFrame, matched: DataFrame, topics: DataFrame, found: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, keywords): two of each of the two best topics, then the passages' that the query contains, then the best topic's; distinct in search form."""
    t = topics.select(F.col("id").alias("topic_id"), "keywords")
    m = matched.join(small(t), "topic_id").select("query_id", F.col("rank").alias("a"), F.posexplode("keywords").alias("b", "kw"))
    first = m.where("a <= 2 and b < 2").withColumn("stage", F.lit(1))
    last = m.where("a = 1").withColumn("stage", F.lit(3))
    p = found.join(queries.select("query_id", search_form(F.coalesce("query", F.lit(""))).alias("norm")), "query_id")
    p = p.select("query_id", "norm", F.col("rank").alias("a"), F.posexplode("keywords").alias("b", "kw")).where((search_form("kw") != "") & F.contains("norm", search_form("kw"))).drop("norm").withColumn("stage", F.lit(2))
    x = first.unionByName(p).unionByName(last).withColumn("key", search_form("kw")).where("key <> ''")
    x = x.groupBy("query_id", "key").agg(F.min(F.struct("stage", "a", "b", "kw")).alias("v"))
    return x.groupBy("query_id").agg(F.slice(F.transform(F.sort_array(F.collect_list("v")), lambda v: v["kw"]), 1, most).alias("keywords"))


def lexical_topk(queries: DataFrame, docs: DataFrame, query_id: str, query: str, doc_id: str, text: str, source: str, most: int = MOST, kept: Kept | None = None) -> DataFrame:
    """The core of retrieval over any table: rarity-weighted token hits, capped, diversified by source.

    Texts are tokenised once; kept holds the table of their tokens, for the caller to delete.
    """
    kept = kept or Kept(docs.sparkSession)
    n = docs.count()
    asked = queries.select(query_id, F.explode(token_set(F.coalesce(F.col(query), F.lit("")))).alias("token"))
    index = kept(docs.select(doc_id, source, token_set(F.coalesce(F.col(text), F.lit(""))).alias("tokens")), "lexical-index")
    df = index.select(F.explode("tokens").alias("token")).join(small(asked.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    df = kept(df, "lexical-frequencies")
    weighted = small(asked.join(small(df), "token").select(query_id, "token", rarity(F.lit(n), F.col("df")).alias("weight")), 1_000_000, 128 << 20)
    # rows are dealt by their id once, and summed up where they lie
    held = index.repartition(doc_id).select(doc_id, source, F.explode("tokens").alias("token"))
    hit = held.join(weighted, "token").groupBy(query_id, doc_id, source).agg(F.least(F.round(F.sum("weight"), 6), F.lit(CAP)).alias("score"))
    return diversified(hit, query_id, source, "score", doc_id, most)


def overlap_pairs(needles: DataFrame, docs: DataFrame, needle_id: str, needle: str, doc_id: str, text: str) -> DataFrame:
    """(needle_id, doc_id, ratio) of all pairs with a ratio above 0: text.overlap_ratio by a join on words; each row of docs stands alone.

    A needle without words of three characters has ratio 1 with every row. Null texts have no words; a null needle has no pairs.
    """
    long = lambda c: F.filter(F.split(search_form(c), " "), lambda t: F.length(t) >= 3)
    asked = needles.select(F.col(needle_id), long(needle).alias("w")).withColumn("n", F.size("w"))
    words_ = asked.select(needle_id, "n", F.explode("w").alias("word")).groupBy(needle_id, "n", "word").agg(F.count("*").alias("k"))
    held = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id), F.array_distinct(long(text)).alias("w")).select("_row", doc_id, F.explode("w").alias("word"))
    x = held.join(small(words_), "word").groupBy("_row", doc_id, needle_id, "n").agg(F.sum("k").alias("k"))
    wordless = docs.select(doc_id).crossJoin(small(asked.where("n = 0").select(needle_id)))
    return x.select(needle_id, doc_id, (F.col("k") / F.col("n")).alias("ratio")).unionByName(wordless.withColumn("ratio", F.lit(1.0)))


def run_research(queries: DataFrame, chunks: DataFrame, sources: DataFrame, excluded: DataFrame, topics: DataFrame, kept: Kept | None = None) -> DataFrame:
    """(query_id, outcome, gate, topic_ids, keywords, passage_ids): gates, topics, keywords, retrieval, in this order. kept is as for retrieve()."""
    from .gates import outcome

    kept = kept or Kept(queries.sparkSession)
    gated = kept(outcome(queries), "gated")
    free = gated.where("outcome is null").select("query_id", F.col("rewritten").alias("query"))
    matched = kept(topics_of(free, topics), "matched")
    found = kept(retrieve(free, chunks, sources, excluded, topics, kept=kept), "found")
    kws = keywords_of(free, matched, topics, found)
    ids = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunkId"))), lambda x: x["chunkId"]).alias("passage_ids"))
    tops = matched.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "topic_id"))), lambda x: x["topic_id"]).alias("topic_ids"))
    x = gated.join(ids, "query_id", "left").join(tops, "query_id", "left").join(kws, "query_id", "left")
    none = F.array().cast("array<string>")
    return x.select("query_id", F.coalesce("outcome", F.when(F.size(F.coalesce("passage_ids", none)) > 0, "ok").otherwise("abstained")).alias("outcome"), "gate", *(F.coalesce(c, none).alias(c) for c in ("topic_ids", "keywords", "passage_ids")))
