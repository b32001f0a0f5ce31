"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties, repeats and clashing names."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvid.llm import html_text, jaccard_join, language_id, line_quality, mixing, mtree, packing, pii, token_counts, tokenizing, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, " \t\n", "en", None, 3), (903, "x " * 30_000, "en", "s", 60_000), (904, "one", "en", "s", 3), (904, "one", "en", "s", 3), (None, "one two three four five six", "en", "s", 9)]


def docs(spark, rows=(), schema=DOCS):
    return spark.createDataFrame([*rows, *ODD], schema)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    for c in ("size", "target", "copies", "score", "pii", "ids", "token", "node", "n", "length", "rejected", "_doc"):
        df = df.withColumn(c, F.lit("kept"))
    return df


# ---- 1


def brute_top(rows, queries, k):
    out = []
    for q, v in rows:
        if q in queries:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_mtree_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "CELL_ROWS", 40)
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (150, 6)))] + [(1000 + i, [0.5] * 6) for i in range(70)]
    bad = [(2000, None), (2001, [float("nan")] * 6), (2002, [None] * 6), (None, [0.1] * 6), (2003, [float("inf")] * 6)]
    x = mtree.quantised(clashing(spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").withColumn("row", F.lit("kept"))))
    got = sorted(tuple(r) for r in mtree.top_k(x, x.where("vec_id % 50 = 0"), k=10).collect())
    rows = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in vectors]
    assert got == brute_top(rows, {i for i, _ in rows if i % 50 == 0}, 10)


def test_mtree_of_repeated_and_ragged_rows(spark, monkeypatch):
    monkeypatch.setattr(mtree, "CELL_ROWS", 16)
    rng = np.random.default_rng(2)
    vectors = [(7, [0.5] * 4)] * 12 + [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.3, (20, 4)), 20)] + [(50, [0.4] * 4)] * 3 + [(100 + i, [0.25] * 4) for i in range(90)]
    ragged = [(200, []), (201, [0.5]), (202, [0.5] * 5), (203, [9.0] * 3)]
    x = mtree.quantised(spark.createDataFrame(vectors + ragged, "vec_id long, embedding array<double>")).repartition(4)
    asked = x.where("vec_id in (7, 25, 50, 110, 200, 202)").dropDuplicates(["vec_id"])
    got = sorted(tuple(r) for r in mtree.top_k(x, asked, k=10).collect())
    rows = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in vectors]
    want = []
    for q in (7, 25, 50, 110):
        v = next(v for i, v in rows if i == q)
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    assert got == sorted(want)


@pytest.mark.parametrize("scale", [1025.0, 3e6, 1e12, 1e300])
def test_mtree_of_large_components(spark, monkeypatch, scale):
    monkeypatch.setattr(mtree, "CELL_ROWS", 16)
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.3, (120, 4)))] + [(200 + i, [float(x) * scale for x in v]) for i, v in enumerate(rng.normal(0, 1, (12, 4)))] + [(300, [scale, 0.0, 0.0, -scale]), (301, [scale] * 4), (302, [scale] * 4)]
    x = mtree.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3))
    rows = [(r["vec_id"], r["v"]) for r in x.collect()]
    whole = lambda c: max(-(1 << 63), min((1 << 63) - 1, int(np.floor(1024 * c)) if abs(c) < 1e15 else (1 << 63 if c > 0 else -(1 << 63))))
    assert sorted(rows) == [(i, [whole(c) for c in v]) for i, v in vectors]
    got = sorted(tuple(r) for r in mtree.top_k(x, x.where("vec_id % 25 = 0 or vec_id > 298"), k=10).collect())
    want = brute_top(rows, {i for i, _ in rows if i % 25 == 0 or i > 298}, 10)
    assert got == [(*r[:3], r[3] if -(1 << 63) <= r[3] < 1 << 63 else None) for r in want]


def test_mtree_small_and_empty(spark):
    x = mtree.quantised(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in mtree.top_k(x, x.where("vec_id = 1")).collect()] == [(1, 1, 2, 1024 * 2048)]
    assert mtree.top_k(x.limit(0), x).count() == 0 and mtree.top_k(x, x.limit(0)).count() == 0


# ---- 2 and 3

STRANGE = ["", " ", "a ", " a", "a  b", "a \n b", "<s> x </s>", "x<|endoftext|> y  <|endoftext|>z", "a  b", "don't  's, it.", "1,000.5 a,b ., x", "é̂ ﬁ ①", "日本 語。", "\x00 a.b", "🙂 🙂 x"]


def test_units_never_change_ids():
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = STRANGE + ["".join(rng.choice("ab .,\n'1é") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    plain = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenizing.byte_level(path)(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    model = sentencepiece.SentencePieceProcessor(model_file=(path := public_tokenizers.path("piece_bpe_32k.model")))
    assert tokenizing.piece_counts(path)(texts) == [len(model.encode(t)) for t in texts]


def test_cuts_in_bytes_never_change_ids(monkeypatch):
    """All white space of Unicode, what Python alone takes for it, and characters that end in the same bytes, beside every mark."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    white = [c for c in map(chr, range(0x3100)) if c.isspace()] + ["\u180e", "\u200b", "\ufeff"]
    letters = [*"ab1 .,\n\r'<|", "é", "×", "÷", "Ā", "ß", "م", "٣", "—", "”", "語", "Å", "\u0300", "🙂", "😅", "\0", "'s", "<|endoftext|>"]
    texts = [x + m + y for x in ["", *white, *letters] for m in " .,\n" for y in ["", *white, *letters]]
    texts += ["".join(rng.choice(letters if rng.random() < 0.8 else white) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    plain = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for size in (tokenizing.CHUNK_BYTES, 40):
        monkeypatch.setattr(tokenizing, "CHUNK_BYTES", size)
        assert tokenizing.byte_level(path)(texts) == want
        assert tokenizing.byte_level(path)([]) == [] and tokenizing.byte_level(path)(["", ""]) == [b"", b""]
    sliced = pa.array(["no", "é a.b", "", None, "c\nd"])[1:]
    assert [n for _, sizes in tokenizing.byte_level_batches(path)(sliced.fill_null("")) for n in sizes] == [len(plain.encode(t or "").ids) for t in sliced.to_pylist()]


def test_a_unit_is_looked_up_once_a_batch(monkeypatch):
    looked_up = Counter()

    class Counted(tokenizing._Memo):
        def __getitem__(self, unit):
            looked_up[unit] += 1
            return super().__getitem__(unit)

    monkeypatch.setattr(tokenizing, "_Memo", Counted)
    tokenizing.byte_level(public_tokenizers.path("byte_bpe_50k.json"), room=1 << 19)(["the sun, the moon and the sea.\nthe sky"] * 500)
    assert looked_up and max(looked_up.values()) == 1


def test_pieces_are_cut_and_ranked_as_one_by_one(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenizing, "CHUNK_BYTES", 300)
    monkeypatch.setattr(packing, "BATCH_PIECES", 3)
    tok = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(i, None if i % 9 == 0 else "a " * (i % 40)) for i in range(300)], "doc_id int, text string").coalesce(1)
    want, ranks = [], Counter()
    for i, text in df.collect():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 8 or 8
        for k, start in enumerate([0, *range(first, len(ids), 8)]):
            part = ids[start : start + 8] if k else ids[:first]
            want.append((i, k, start, len(part), np.array(part, "<u4").tobytes(), 0, ranks[len(part)]))
            ranks[len(part)] += 1
    got = packing.tokenised_pieces(df, path, 8, 2).collect()
    assert [(*r[:4], bytes(r[4]), *r[5:]) for r in got] == want


def test_token_counts_use_the_cache(spark, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df, cache = docs(spark, [(1, "Hello there. é", "en", "s", 1)]), f"file://{tmp_path}/cache"
    for _ in range(2):
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df, path, cache).collect())
        assert got == sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in df.collect())
        assert spark.read.parquet(cache).count() == df.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_a_second_run_of_the_counting_query_encodes_nothing(spark, tmp_path):
    from corvid.llm import queries

    unique = f"never counted before {random.Random().random()}"
    docs(spark, [(1, unique, "en", "s", 1), (2, unique, "en", "s", 1), (3, f"{unique} twice", "en", "s", 1)]).write.parquet(f"{tmp_path}/documents.parquet")
    cache = token_counts.cache_of(spark, public_tokenizers.path("piece_bpe_32k.model"))
    first = sorted(map(str, queries.op2_token_counts(spark, str(tmp_path)).collect()))
    held = spark.read.parquet(cache).count()
    assert sorted(map(str, queries.op2_token_counts(spark, str(tmp_path)).collect())) == first
    assert spark.read.parquet(cache).count() == held
    assert spark.read.parquet(cache).groupBy("content_digest").count().where("count > 1").where("content_digest = sha2('%s', 256)" % unique).count() == 0


def test_packing_is_exact_and_gapless(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    df = docs(spark, [(i, "word " * (7 * i % 900), "en", "s", 1) for i in range(60)]).where("doc_id is not null and doc_id <> 904")
    rows = packing.pack(df.repartition(3), path, max_len=256).collect()
    pieces, places = defaultdict(dict), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]][r["piece"]] = (r["start"], r["ids"])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in df.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        mine = [pieces[r["doc_id"]][k] for k in range(len(pieces[r["doc_id"]]))]
        assert b"".join(x for _, x in mine) == np.array(ids, "<u4").tobytes()
        assert [s for s, _ in mine] == [0, *range(len(ids) % 256 or 256, len(ids), 256)]
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 256
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 256) * 1.1 + 1
    assert packing.pack(empty(spark), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_exactly_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 129, 3000), rng.integers(70, 129, 500), rng.integers(1, 4, 50), np.clip(rng.lognormal(3, 1, 5000).astype(int), 1, 128)][seed]
    h, back = np.bincount(lengths, minlength=129), np.zeros(129, int)
    plan = packing.plan(h)
    for held, n in plan:
        assert sum(held) <= 128
        for v in held:
            back[v] += n
    assert (back == h).all()
    if seed != 1:
        assert sum(n for _, n in plan) <= 1.03 * lengths.sum() / 128 + 1


# ---- 4


def plain_spans(text):
    import re

    out = []
    for n, (kind, p) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), n, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("aB0123456789.@ +-()%_é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000) == plain_spans("") == []


def test_added_spans_on_held_out_examples():
    texts, spans, labels = pii.examples(400, seed=77)
    found = pii.find(texts, pii.model())
    hit = [any(s["kind"] == k and s["start"] < e and a < s["end"] for s in f) for f, (a, e, k) in zip(found, spans, strict=True)]
    real, other = [h for h, v in zip(hit, labels, strict=True) if v], [h for h, v in zip(hit, labels, strict=True) if not v]
    assert np.mean(real) > 0.8 and np.mean(other) < 0.1


def test_many_spans_take_linear_time():
    import time

    began = time.time()
    text = "10.0.0.1 at 030 123456, " * 45_000
    assert len(text) > 1 << 20
    found = pii.find([text], pii.model())[0]
    assert sum(s["base"] for s in found) == 45_000 and all(a["end"] <= b["start"] for a, b in zip(found, found[1:], strict=False)) and time.time() - began < 30


def test_pii_query_strings(spark, tmp_path):
    import hashlib

    from corvid.llm import queries

    df = clashing(docs(spark, [(1, "x@y.org 10.0.0.1 4111 1111 1111 1111, +49 30 1234567", "en", "s", 1), (2, "none", "en", "s", 1)]))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op4_boosted_pii(spark, str(tmp_path)).collect():
        text = next(d["text"] for d in df.collect() if d["doc_id"] == r["doc_id"]) or ""
        base = plain_spans(text)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_redaction(spark):
    df = clashing(docs(spark, [(1, "é mail a.b@c.org now", "en", "s", 20), (2, "card 4111 1111 1111 1111.", "en", "s", 5), (3, "clean 12 words", "en", "s", 14)]))
    out = pii.redact(df)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.where("doc_id < 10 or doc_id = 900").collect()}
    assert got == {1: ("é mail <EMAIL> now", 18), 2: ("card <CARD>.", 12), 3: ("clean 12 words", 14), 900: (None, None)}
    assert out.columns == df.columns and out.count() == df.count() and pii.redact(empty(spark)).count() == 0
    named = pii.redact(df.withColumns({c: F.lit("kept") for c in ("_pii", "row", "cut")})).where("doc_id = 1").first()
    assert (named["text"], named["_pii"], named["row"], named["cut"]) == ("é mail <EMAIL> now", "kept", "kept", "kept")


# ---- 5


def plain_quality(rows):
    import re

    word = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    held = defaultdict(set)
    for row, (_, t, s) in enumerate(rows):
        for v in (t or "").split("\n"):
            if word(v):
                held[s, " ".join(word(v)).lower()].add(row)
    out = []
    for i, t, s in rows:
        t = t or ""
        w, lines = word(t), [v for v in t.split("\n") if word(v)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(windows) < 3000 else set(range(len(w)))
        removed = sum(len(word(v)) for v in lines if len(held[s, " ".join(word(v)).lower()]) > line_quality.LINE_DOCS)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        left = len(w) - removed
        out.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, removed, not failed and not (removed and (left < line_quality.LEFT_WORDS or left < line_quality.LEFT_SHARE * len(w)))))
    return sorted(out)


def test_quality_equals_the_plain_version(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 40))
    line = lambda n: " ".join(word() for _ in range(n))
    common, rows = line(60), []
    for i in range(70):
        text = "\n".join(line(rng.randint(1, 30)) for _ in range(rng.randint(1, 5)))
        text += ("\n" + common.upper() if i % 2 else "\n" + common) if i < 60 else ""
        rows.append((i, text + ("\n" + text if i % 9 == 0 else "") + " #$", "en", "s" if i % 3 else "t", 0))
    rows += [(100 + i, "copy " + rows[65][1], "en", "s", 0) for i in range(40)]
    df = docs(spark, rows)
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in line_quality.quality(df).collect())
    assert got == plain_quality([(r["doc_id"], r["text"], r["source"]) for r in df.collect()])
    assert line_quality.quality(empty(spark)).count() == 0


def test_lines_above_limits_leave_the_text(spark):
    rows = [(i, f"Head {i} {'w%d ' % i * 60}\n\nAll  RIGHTS reserved\n \nTail {i}\n", "en", "s" if i < 30 else None, 0) for i in range(60)] + [(60, "all rights reserved", "en", "s", 0), (61, "All rights reserved\nx", "en", "other", 0)]
    df = docs(spark, rows)
    out = line_quality.cleaned(df)
    got = {r["doc_id"]: r["clean_text"] for r in out.collect()}
    assert all(got[i] == t.replace("All  RIGHTS reserved\n", "") for i, t, *_ in rows[:60]) and got[60] == "" and got[61] == rows[61][1] and got[900] == ""
    licence = docs(spark, [(i, "one licence line\nand its text " + "w " * 60, "en", "s", 0) for i in range(21)] + [(50 + i, "rare line", "en", "s", 0) for i in range(20)])
    got = {r["doc_id"]: r["clean_text"] for r in line_quality.cleaned(licence).collect()}
    assert {got[i] for i in range(21)} == {""} and {got[50 + i] for i in range(20)} == {"rare line"}  # exact copies are documents too
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, out.drop("clean_text").collect())) == sorted(map(key, line_quality.quality(df).collect()))
    assert line_quality.cleaned(empty(spark)).count() == 0
    # many lines above the limit, in every place of a text
    many = [(i, "\n".join(f"boiler line {v}" if v % 3 else f"own words {i} {v}" for v in range(i % 5, 90 + i % 7)), "en", None, 1) for i in range(40)]
    got = {r["doc_id"]: r["clean_text"] for r in line_quality.cleaned(spark.createDataFrame(many, DOCS)).collect()}
    held = defaultdict(set)
    for i, t, *_ in many:
        for v in t.split("\n"):
            held[v].add(i)
    assert got == {i: "\n".join(v for v in t.split("\n") if len(held[v]) <= line_quality.LINE_DOCS) for i, t, *_ in many}


# ---- 6


def test_language_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    aside = language_id.held_out(F.col("doc_id"))
    out = language_id.identify(df, language_id.train(df, ~aside)).where(aside)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert out.agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.03


def plain_vector(text):
    """Letter 1- to 3-grams counted one by one, in the slots of their hashes."""
    words, last = [""], False
    for c in text.lower():
        if c.isalpha():
            words[-1] += c
        elif words[-1]:
            words.append("")
        last = c.isalpha()
    words = [w for w in words if w]
    if not words:
        return {}
    s = " " + " ".join(words) + ("" if last else " ") + " "
    out = defaultdict(float)
    for n, salt in ((1, 1), (2, 2), (3, 3)):
        for k in range(len(s) - n + 1):
            part = s[k : k + n]
            if n > 1 or part != " ":
                h = ord(part[0])
                for c, factor in zip(part[1:], (0x9E3779B1, 0x85EBCA6B), strict=False):
                    h = (h * factor + ord(c)) % 2**32
                out[((h ^ salt) * 2654435761 % 2**32) >> 18] += 1
    return out


def test_op6_query_is_the_nearest_centroid(spark):
    from corvid.llm import queries

    folder = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.train(df, ~language_id.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in queries.op6_centroid_language(spark, folder).collect()}
    rows = df.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        v = {k: c * model.idf[k] for k, c in plain_vector(r["text"] or "").items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        cosines = [sum(x * model.centroids[k, j] for k, x in v.items()) / norm for j in range(model.centroids.shape[1])] if norm else []
        best = max(range(len(cosines)), key=lambda j: cosines[j], default=None)
        want = ("und", 0.0) if best is None else (model.languages[model.owner[best]], cosines[best])
        assert got[r["doc_id"]]["lang_pred"] == want[0] and abs(got[r["doc_id"]]["score"] - want[1]) < 1e-5
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_dirty_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 5)
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 50)
    rows = [(i, f"{'the dog' if i % 2 else 'le chien'} {i}", "en" if i % 2 else "fr", "s", 1) for i in range(400)] + [(1000 + i, "odd text", f"label {i}", "s", 1) for i in range(300)]
    model = language_id.train(spark.createDataFrame(rows, DOCS), F.lit(True))
    assert {"en", "fr"} <= {*model.languages} and len(model.languages) <= 5


def test_language_of_odd_texts(spark):
    model = language_id.fit(["the cat and the dog"] * 5 + ["le chat et le chien"] * 5, ["en"] * 5 + ["fr"] * 5)
    df = clashing(docs(spark, [(1, "12 34 !!", None, None, 1), (2, "the dog", None, None, 1)]))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, model).collect()}
    assert got[1] == got[900] == got[901] == ("und", 0.0) and got[2][0] == "en" and 0 < got[2][1] <= 1
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {2}
    assert language_id.identify(empty(spark), language_id.train(empty(spark), F.lit(True))).count() == 0


# ---- 7


def plain_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                up[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        r = root(k)
        least[r] = i if least[r] is None else least[r] if i is None else min(i, least[r])
    return sorted((str(i), len(s), str(least[root(k)] if s else i)) for k, (i, s) in enumerate(sets))


def near_rows(seed, groups=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common, rows = [rng.choice(words) for _ in range(40)], []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(3, 100))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(common + w if rng.random() < 0.3 else w), "en", "s", 0))
    return rows


def components_of(df, width, percent, **how):
    found = jaccard_join.jaccard_components(df, width, percent, **how).collect()
    return sorted(tuple(map(lambda v: v if isinstance(v, int) and not isinstance(v, bool) else str(v), (str(r["doc_id"]), r["n_shingles"], str(r["component_id"])))) for r in found)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (4, 50)])
def test_jaccard_equals_all_pairs(spark, width, percent):
    df = docs(spark, near_rows(3)).repartition(5)
    assert components_of(clashing(df), width, percent) == plain_components([(r["doc_id"], r["text"]) for r in df.collect()], width, percent)


@pytest.mark.parametrize(("derive", "medium"), [(True, 2), (False, 4)])
def test_jaccard_with_long_and_dealt_out_lists(spark, monkeypatch, derive, medium):
    """All lists of more than two sets are long, and frequent ones are dealt out, each part with a leader."""
    for name, value in (("SHORT_LIST", 2), ("MEDIUM_LIST", medium), ("HOT_LIST", 3), ("LOCAL_MIN", 1), ("PARTNERS", 1), ("ROUNDS", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    df = docs(spark, near_rows(9, 12)).repartition(3)
    assert components_of(df, 3, 60, derive=derive) == plain_components([(r["doc_id"], r["text"]) for r in df.collect()], 3, 60)


def test_only_neighbours_that_fit_become_rows(spark):
    rows = [(t, n, 20, 0, n % 2, 0, [0] * 8) for t in range(3) for n in range(40)]
    members = spark.createDataFrame(rows, "token long, node long, n int, pos int, component long, block int, bits array<long>")
    found = jaccard_join._beside(members, 0, lambda b: (F.col("node") == 7) & (F.col(f"{b}.component") == 0))
    got = found.collect()
    assert 1 <= len(got) <= 3 * jaccard_join.NEIGHBOURS and {(r["node"], r["component_b"]) for r in got} == {(7, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[: plan.index("Generate")]


def test_jaccard_with_clashing_numbers(spark):
    """Of the first half of a key only ten bits are left, so that different sets share it."""
    df = docs(spark, near_rows(5)).repartition(3)
    assert components_of(df, 4, 80, node_bits=10) == plain_components([(r["doc_id"], r["text"]) for r in df.collect()], 4, 80)


def test_answers_derived_from_a_leader(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(2000):
        leader = set(range(rng.randint(1, 60)))
        x, y = ({v for v in leader if rng.random() < 0.9} | {100 + rng.randint(0, 9) for _ in range(rng.randint(0, 5))} for _ in range(2))
        rows.append((len(x), len(y), len(leader), len(x & leader), len(y & leader), len(x & y)))
    least, most = jaccard_join.derived(*(F.col(c) for c in ("n", "m", "l", "a", "b")))
    out = spark.createDataFrame(rows, "n int, m int, l int, a int, b int, both int").select("*", least.alias("least"), most.alias("most")).collect()
    assert all(r["least"] <= r["both"] <= r["most"] for r in out)
    enough = [-(-80 * (r["n"] + r["m"]) // 180) for r in out]
    assert sum(r["least"] >= e for r, e in zip(out, enough, strict=True)) > 200  # a link without a look at the sets
    assert sum(r["most"] < e for r, e in zip(out, enough, strict=True)) > 20  # no link without one


def test_jaccard_drops_all_but_the_first(spark):
    df = clashing(docs(spark, [(1, "a b c d e f", "en", "s", 0), (2, "A b c d e f", "en", "s", 0), (3, "other words in here now", "en", "s", 0), (3, "x y z a b c d e", "en", "s", 0), (4, "other words in here now", "en", "s", 0), (None, "one two three four five six", "fr", None, 1)]))
    named = df.withColumns({c: F.lit("kept") for c in ("_near_id", "_near_content", "id", "content", "row", "near_key", "a.b")})
    assert sorted(map(str, jaccard_join.drop_near_copies(named).select("doc_id", "text").collect())) == sorted(map(str, jaccard_join.drop_near_copies(df).select("doc_id", "text").collect()))
    kept = jaccard_join.drop_near_copies(df)
    # of repeated rows, and of copies without an id, one stays; id 3 stands for two different texts
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 3, 900, 901, 902, 903, 904, None]))
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0 and jaccard_join.drop_near_copies(empty(spark)).count() == 0


# ---- 8


def test_mix_hits_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 200), "en", rng.choice(["a", "a", "a", "b", "c"]) if i % 40 else None, 0) for i in range(2000)]
    df = docs(spark, rows)
    out = [r.asDict() for r in mixing.mix(df).collect()]
    assert len(out) == df.count()
    total, by = sum(r["size"] for r in out), defaultdict(list)
    for r in out:
        assert r["copies"] <= 3
        by[r["source"]].append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        taken = sum(r["copies"] * r["size"] for r in v)
        assert abs(taken - v[0]["target"]) <= 0.02 * v[0]["target"] + 3 * max(r["size"] for r in v)
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 3 * v[0]["source_size"]
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(key, again)) == sorted(map(key, out))
    x = clashing(df)
    m = mixing.mixture(x)
    assert m.columns == x.columns and m.count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty(spark)).count() == 0


# ---- 9


def test_main_text_of_held_out_pages():
    model = html_text.model()
    pages = html_text.labelled_pages(200, seed=99)
    assert np.mean([html_text.main_text(p, model) == t for p, t in pages]) > 0.95


def test_marginals_equal_enumeration():
    """Sum-product over a tree against the sum over all labellings of its nodes."""
    import itertools
    import math

    tags = ("div", "p", "text", "li", "section")
    for seed in range(12):
        r = random.Random(seed)
        n = r.randint(2, 10)
        nodes = [html_text.Node("html", -1)] + [html_text.Node(r.choice(tags), r.randrange(k)) for k in range(1, n)]
        for v in nodes:
            v.size, v.text = r.randint(1, 90), "words. " * r.randint(0, 3)
        tree = html_text.TreeModel(np.array([r.uniform(-2, 2) for _ in range(html_text.WIDTH)]), {k: tuple(r.uniform(-2, 2) for _ in range(4)) for k in range(len(html_text.TAGS))})
        own = [sum(tree.unary[i] * v for i, v in html_text.features(x)) for x in nodes]
        total, on = 0.0, [0.0] * n
        for labels in itertools.product((0, 1), repeat=n):
            weight = math.exp(sum(o for o, v in zip(own, labels, strict=True) if v) + sum(tree.edges[html_text._TAG.get(nodes[k].tag, 21)][2 * labels[nodes[k].parent] + labels[k]] for k in range(1, n)))
            total += weight
            for k in range(n):
                on[k] += weight * labels[k]
        assert np.allclose(tree.marginals(nodes), [v / total for v in on], atol=1e-9)


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</p>" * 60_000, '<a href="x' * 100_000, "<p class='a\"" * 80_000, "<button>" * 100_000 + "text", "<object><p>" * 60_000])
def test_parsing_takes_linear_time(page):
    import time

    began = time.time()
    html_text.parse(page)
    assert time.time() - began < 5


def test_unclosed_elements_lose_no_text():
    page = "<article><p>One sentence is here.</p><{0} class=x><p>Another sentence is here.</p></article>"
    for tag in ("button", "object", "canvas", "select", "noscript", "svg"):
        assert [n.text for n in html_text.parse(page.format(tag)) if n.tag == "text"] == ["One sentence is here.", "Another sentence is here."]


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", "<article><h1>A title</h1><p>One&amp;two&nbsp; three <b>bo</b>ld<br>line.<p>Next sentence is here.</article><footer>&copy; x</footer>"), (2, "u", None), (3, "u", ""), (4, "u", "<div>" * 5000 + "Deep words are here too." + "</div>" * 5000), (5, "u", "<script>only"), (6, None, "<p>Unclosed <i>text goes on.")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[1] == (t := "A title\nOne&two three bold line.\nNext sentence is here.", len(t)) or got[1][0] == t
    assert got[2] == got[3] == got[5] == ("", 0) and set(got) == {1, 2, 3, 4, 5, 6}


# ---- 10


def test_warc_round_trip(spark, tmp_path):
    import gzip

    rows = [(5, "http://a.org/x#f", "<p>é</p>"), (3, "http://b.a.org/", "<p>é</p>"), (9, "HTTP://A.org/x", None), (8, None, ""), (4, "http://a.org/x", "long " * 90_000), (7, "http://a.org/x?q=1\r\nX: y", "<p>é</p>"), (None, "http://z", "<p>é</p>")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)
    got = {r["page_id"]: (r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.captures(df).collect()}
    want = {}
    for i, _, h in rows:
        p = (h or "").encode()
        first = min(j for j, _, g in rows if (g or "") == (h or "") and j is not None)
        want[i] = ("response" if i == first else "revisit", len(p), warc.digest(p), None if i == first else first)
    assert got == want
    written = warc.write(df)
    keys = [(r["url_key"], r["ts"]) for r in warc.merge(written).collect()]
    assert keys == sorted(keys) and len(keys) == len(rows)
    placed = sorted((r["position"], r["url_key"], r["ts"]) for r in warc.captures(df).collect())
    assert [p[1:] for p in placed] == keys and [p[0] for p in placed] == list(range(len(keys)))
    read = {r["page_id"]: r["payload"] for r in warc.read(written).where("record_type = 'response'").collect()}
    assert {i: bytes(p).decode() for i, p in read.items()} == {i: h or "" for i, _, h in rows if want[i][0] == "response"}
    for path in warc.export(written, str(tmp_path)):
        assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.captures(df, min_bytes=100).collect()}
    assert set(small.values()) == {"response"}


def test_index_of_many_ranges_is_in_global_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    rows = [(i if i % 50 else None, f"http://h{i % 7}.org/{i % 90 if i % 3 else 0}", f"<p>{i % 11}</p>") for i in range(500)]
    index = warc.merge(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)))
    got = [(r["url_key"], r["ts"].timestamp(), r["page_id"] is not None, r["page_id"] or 0) for r in index.collect()]
    assert got == sorted(got) and len(got) == 500 and index.select("archive").distinct().count() > 5
    assert sorted(r["position"] for r in index.collect()) == list(range(500))


def test_records_are_read_in_steps(monkeypatch):
    raw = [warc.record(i, "http://a.org", warc.EPOCH, bytes([i]) * 100_000, None, True) for i in range(5)]
    monkeypatch.setattr(warc, "STEP_BYTES", 7)
    found = list(warc.records(b"".join(raw)))
    assert [at for at, *_ in found] == [sum(map(len, raw[:k])) for k in range(5)] and all(len(block) > 100_000 for _, _, block in found)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(raw[0][:-3]))


def test_loser_tree_merges_any_runs():
    rng = random.Random(6)
    for k in range(0, 9):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 15))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda v: v)) == sorted(sum(runs, []))


def test_ids_crc_is_of_little_endian_words(spark):
    raw = np.array([1, 50_000, 2], "<u4").tobytes()
    assert spark.createDataFrame([(bytearray(raw),)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(raw)


def test_members_of_the_same_lists_meet_different_neighbours_in_each(spark):
    from corvid.llm import jaccard_join as J

    rows = [(token, node, 100, 0, node, [0] * 8, 7) for token in range(6) for node in range(40)]
    members = spark.createDataFrame(rows, "token long, node long, n int, pos int, component long, bits array<long>, block int")
    met = J._beside(members, 0, lambda b: F.col(f"{b}.node").isNotNull()).groupBy("node").agg(F.count_distinct("node_b").alias("k"), F.count("*").alias("rows")).toPandas()
    # all lists had one order: no set met more than NEIGHBOURS before it, however many lists it shared, and large groups of near copies were left to the exact step
    assert met.k.mean() > 2 * J.NEIGHBOURS and met.rows.max() <= 6 * J.NEIGHBOURS
