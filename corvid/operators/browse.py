"""Look-ups, questionnaire paths, HTTP status guards and the deterministic brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.text import arabic_punctuation, first_sentences

from .registry import small


def first_match(df: DataFrame, column: str, value, order: str | None = None) -> DataFrame:
    x = df.where(F.col(column) == value)
    return (x.orderBy(order) if order else x).limit(1)


def by_topic(chunks: DataFrame, topic: str) -> DataFrame:
    return chunks.where(F.array_contains("topics", topic))


def by_source(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.where(F.col("sourceId") == source)


def display_split(passages: DataFrame, order: str, full: int = 24) -> DataFrame:
    """compact: whether a passage comes after the first `full`; ranks within blocks, as dense ids are made."""
    from .ingest import _numbered

    x = _numbered(passages.withColumn("ord", F.col(order)), "").withColumn("compact", F.col("id").cast("long") > full)
    return x.drop("id")


def questionnaire(areas: DataFrame, refinements: DataFrame, picks: DataFrame, topics: DataFrame) -> DataFrame:
    """(path_id, topic_ids, keywords) of picks (path_id, area_id, refinement_ids): the area's topics and those of its chosen refinements, in taxonomy order.

    Keywords: the refinements', distinct, eight at most; without any, two of each of the first two topics. Unknown areas have no row.
    areas: id, topicIds. refinements: ord, id, areaId, topicId, keywords. topics: id, order, keywords.
    """
    p = picks.join(small(areas.select(F.col("id").alias("area_id"), "topicIds")), "area_id")
    r = refinements.select("ord", F.col("id").alias("rid"), F.col("areaId").alias("area_id"), "topicId", F.col("keywords").alias("rk"))
    chosen = p.join(small(r), "area_id").where(F.array_contains("refinement_ids", F.col("rid"))).groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("ord", "topicId", "rk"))).alias("c"))
    p = p.join(chosen, "path_id", "left")
    none = F.array().cast("array<string>")
    p = p.withColumns({"ids": F.array_distinct(F.concat("topicIds", F.coalesce(F.transform("c", lambda v: v["topicId"]), none))), "kw": F.array_distinct(F.coalesce(F.flatten(F.transform("c", lambda v: v["rk"])), none))})
    t = p.select("path_id", "kw", F.explode("ids").alias("id")).join(small(topics.select("id", "order", "title", F.col("keywords").alias("tk"))), "id")
    t = t.groupBy("path_id").agg(F.first("kw").alias("kw"), F.sort_array(F.collect_list(F.struct("order", "id", "title", "tk"))).alias("t"))
    spare = F.array_distinct(F.flatten(F.transform(F.slice("t", 1, 2), lambda v: F.slice(v["tk"], 1, 2))))
    kw = F.when(F.size("kw") > 0, F.col("kw")).otherwise(spare)
    query = F.concat(F.lit("أريد البحث في "), F.array_join(F.transform("t", lambda v: v["title"]), " و"), F.lit("، وأفيد بالكلمات: "), F.array_join(F.slice(kw, 1, 5), "، "), F.lit("."))
    return t.select("path_id", F.transform("t", lambda v: v["id"]).alias("topic_ids"), F.slice(kw, 1, 8).alias("keywords"), query.alias("query"))


def all_paths(areas: DataFrame, refinements: DataFrame) -> DataFrame:
    """(area_id, refinement_ids): none, each single one, and all where there are two or more."""
    a, r = areas.select(F.col("id").alias("area_id")), refinements.select(F.col("areaId").alias("area_id"), "ord", "id")
    single = a.join(r, "area_id").select("area_id", F.array("id").alias("refinement_ids"))
    every = a.join(r, "area_id").groupBy("area_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda v: v["id"]).alias("refinement_ids")).where(F.size("refinement_ids") >= 2)
    return a.select("area_id", F.array().cast("array<string>").alias("refinement_ids")).unionByName(single).unionByName(every)


def related_questions(matched: DataFrame, topics: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, questions): two of the best topic, one of each other, distinct, four at most."""
    t = topics.select(F.col("id").alias("topic_id"), "relatedQuestions")
    x = matched.join(small(t), "topic_id").select("query_id", "rank", F.posexplode("relatedQuestions").alias("pos", "q")).where((F.col("pos") == 0) | ((F.col("pos") == 1) & (F.col("rank") == 1)))
    x = x.groupBy("query_id", "q").agg(F.min(F.struct("rank", "pos")).alias("o"))
    return x.groupBy("query_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("o", "q"))), lambda v: v["q"]), 1, most).alias("questions"))


def brief_lines(passages: DataFrame) -> DataFrame:
    """(query_id, rank, line): the deterministic summary's line of each passage."""
    shown = F.coalesce(*(F.nullif(F.btrim(c), F.lit("")) for c in ("hadithText", "hadithFullText")), F.col("text"))
    return passages.select("query_id", "rank", F.concat(F.col("rank").cast("string"), F.lit(". "), first_sentences(shown), F.lit(" (الموضع: "), arabic_punctuation("chapter"), F.lit(")")).alias("line"))


def http_status(body: Column | str, query: Column | str, most: int = 1000, most_bytes: int = 8192) -> Column:
    """413 for an oversized body, 400 for one that isn't a JSON object or has too long a query, else 200."""
    b = F.col(body) if isinstance(body, str) else body
    q = F.col(query) if isinstance(query, str) else query
    return F.when(F.octet_length(b) > most_bytes, 413).when(~F.rlike(F.coalesce(b, F.lit("")), F.lit("(?s)^\\s*\\{.*\\}\\s*$")) | F.try_parse_json(b).isNull() | (F.length(q) > most), 400).otherwise(200)


def verses(text: Column | str) -> Column:
    """Bracketed verses of a passage, in order."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit("﴿[^﴾]*﴾"), F.lit(0))


def numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Clamped to [-1, 1]; 0 for vectors of different or no length, or of norm zero."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / F.nullif(norm, F.lit(0.0))))).otherwise(0.0)


def suggestions(topics: DataFrame, most: int = 4) -> DataFrame:
    """(slug, title) of the first topics in order, for a query without an answer."""
    return topics.orderBy("order", "slug").limit(most).select("slug", "title")


# The brief's headings and its closing note.
BRIEF = "تنظيم آلي حتمي للمادة المسترجعة (بدون نموذج ذكاء اصطناعي):"
BRIEF_TOPICS = "موضوعات المسار البحثي:"
BRIEF_PASSAGES = "أبرز ما تضمنته المادة المسترجعة من المصدر المعتمد:"
BRIEF_NOTE = "ملاحظة منهجية: التلخيص أعلاه جُمّع حرفياً من المقاطع المسترجعة نفسها، ولم يُضف إليه أي معنى من خارجها. وصفُ المستخدم يبقى وصفاً شخصياً، ومحتوى المصدر يبقى محتوى المصدر."


def brief(queries: DataFrame, matched: DataFrame, topics: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, brief): heading, the matched topics' titles, a line of each passage, and the closing note. Queries without topics have no topic list."""
    titles = matched.join(small(topics.select(F.col("id").alias("topic_id"), "title")), "topic_id").select("query_id", F.struct(F.lit(1).alias("part"), "rank", F.concat(F.lit("• "), arabic_punctuation("title")).alias("line")).alias("v"))
    lines = brief_lines(passages).select("query_id", F.struct(F.lit(3).alias("part"), "rank", "line").alias("v"))
    fixed = lambda part, line: F.struct(F.lit(part).alias("part"), F.lit(0).alias("rank"), F.lit(line).alias("line"))
    frame = queries.select("query_id", F.explode(F.array(fixed(0, BRIEF + "\n"), fixed(2, BRIEF_PASSAGES), fixed(4, "\n" + BRIEF_NOTE))).alias("v"))
    heads = matched.select("query_id").distinct().select("query_id", F.explode(F.array(fixed(1, BRIEF_TOPICS), F.struct(F.lit(1).alias("part"), F.lit(1 << 30).alias("rank"), F.lit("").alias("line")))).alias("v"))
    x = frame.unionByName(heads).unionByName(titles).unionByName(lines).groupBy("query_id").agg(F.sort_array(F.collect_list("v")).alias("v"))
    return x.select("query_id", F.array_join(F.transform("v", lambda v: v["line"]), "\n").alias("brief"))


def verse_parts(text: Column | str) -> Column:
    """array<struct<verse, text>>: the passage cut into bracketed verses and the text between them, in order; nothing is lost."""
    parts = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit("﴿[^﴾]+﴾|(?:(?!﴿[^﴾]+﴾)[\\s\\S])+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.rlike(p, F.lit("^﴿[^﴾]+﴾$")).alias("verse"), p.alias("text")))


# Fixed value: characters of a text that are embedded.
EMBED = 1400


def embed_text(text: Column | str, role: str = "neutral", most: int = EMBED) -> Column:
    """The trimmed and clipped text, framed for its role: query, document or neutral. A null text is empty."""
    x = F.left(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit(most))
    frame = {"query": "task: question answering | query: ", "document": "title: none | text: "}.get(role)
    return F.concat(F.lit(frame), x) if frame else x


def health(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def distinct_by(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row, by a unique order, of each value of key; null is a value."""
    first = rows.groupBy(key.alias("_k")).agg(F.min(order).alias(order)).select(order)
    return rows.join(first, order, "left_semi")


def contains_all(held: DataFrame, group: str, member: str, wanted: DataFrame, key: str) -> DataFrame:
    """(group, key): groups that hold every member of a wanted set (relational division), by counts of a join on the members.

    held: (group, member), wanted: (key, member); repeats count once, null members are none. A set without members is no row of wanted and has
    no pair: every group holds it, so callers that list such sets know the answer. Only pairs that share a member are looked at.
    """
    w = wanted.select(key, F.col(member)).where(F.col(member).isNotNull()).distinct()
    sizes = w.groupBy(key).agg(F.count("*").alias("_wanted"))
    met = held.select(group, member).where(F.col(member).isNotNull()).distinct().join(small(w), member).groupBy(group, key).agg(F.count("*").alias("_met"))
    return met.join(small(sizes), key).where("_met = _wanted").select(group, key)


#: Queries and vectors that meet in one task, the bytes of either side, and the scores that a task holds at once.
QUERY_BLOCK, VECTOR_BLOCK, BLOCK_BYTES, SCORES = 8192, 8192, 16 << 20, 1 << 21


def nearest_rows(left, right, k: int):
    """(query_id, vec_id, score) of two Arrow tables (id, v): for each row of left its k most similar rows of right, ties to the smaller id.

    Scores are made for as many rows of left at once as SCORES has room for.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def unit(rows: pa.Table, width: int):
        """(places, unit vectors) of this width."""
        column = rows.column("v").combine_chunks()
        fits = np.flatnonzero(pc.list_value_length(column).to_numpy(zero_copy_only=False) == width)
        m = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), width).astype(float)
        norm = np.sqrt((m**2).sum(1, keepdims=True))
        return fits, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    parts = [[], [], []]
    if left.num_rows and right.num_rows:
        ids, theirs = left.column("id").to_numpy(), right.column("id").to_numpy()
        step = max(1, SCORES // len(theirs))
        for width in pc.unique(pc.list_value_length(left.column("v"))).to_pylist():
            at, a = unit(left, width)
            fits, b = unit(right, width)
            for since in range(0, len(at), step):
                asked = ids[at[since : since + step]]
                s = np.zeros((len(asked), len(theirs)))
                if width:
                    some = a[since : since + step] @ b.T
                    s[:, fits] = np.round(np.clip(some, -1, 1, out=some), 6, out=some)
                s[asked[:, None] == theirs[None, :]] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k] if k < len(theirs) else np.full(len(asked), -np.inf)
                for query, row, bound in zip(asked.tolist(), s, least, strict=True):
                    p = np.flatnonzero(row >= bound)
                    best = p[np.lexsort((theirs[p], -row[p]))[:k]]
                    best = best[np.isfinite(row[best])]
                    for part, values in zip(parts, (np.full(len(best), query, ids.dtype), theirs[best], row[best]), strict=True):
                        part.append(values)
    types = (left.schema.field("id").type, right.schema.field("id").type, pa.float64())
    cols = [pa.array(np.concatenate(part) if part else [], t) for part, t in zip(parts, types, strict=True)]
    return pa.table(cols, names=["query_id", "vec_id", "score"])


def cosine_topk(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 4) -> DataFrame:
    """(query_id, vec_id, rank, score): for each query row its k most similar other rows by cosine to six decimals, ties to the smaller id.

    Blocks of queries meet blocks of vectors, whose scores are matrix products of bounded size, and only the k best of each query leave a task; nothing is broadcast.
    Cosines are as in cosine(): 0 for a vector of norm zero. Null vectors and ids take no part, and vectors of another width than the
    query's have score 0. Repeated rows of an id take part each.
    """

    def sides(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        v = F.col(vector_col)
        if df.schema[vector_col].dataType.elementType.typeName() not in ("float", "double"):
            v = v.cast("array<double>")
        x = df.select(F.col(id_col).alias("id"), v.alias("v")).where("id is not null and v is not null")
        rows, held = x.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0)) * 8).first()
        blocks = max(1, -(-rows // size), -(-held // BLOCK_BYTES))
        return x.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks

    q, n_q = sides(queries, QUERY_BLOCK, "qb")
    v, n_v = sides(vectors, VECTOR_BLOCK, "vb")
    q = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    v = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    kind = vectors.schema[id_col].dataType.simpleString()
    meet = lambda left, right: nearest_rows(left, right, k)
    x = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(meet, f"query_id {kind}, vec_id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
