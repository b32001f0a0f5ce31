"""Byte-level BPE, periodic runs and whitening against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from corvid.llm import byte_bpe, periodic_runs, queries, tokenizing, whitening

DOCS = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "x " * 30_000), (904, "one"), (904, "one"), (None, "one two three"), (905, "y" * 50_000), (906, "a b a b a b a b a b tail")]
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def table(tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# ---- 11


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def strange(rng, n):
    for k in range(n):
        letters = "abcdeothnisr '.,\n1éß日本語🙂 \t-<|>مسأ" if k % 2 else "aeinotrhsd"
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) if k % 3 else rng.choice(["a", "ha", "é", "the", "=", " "]) * rng.randint(1, 300)


def test_transducer_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "HELD", 9)  # tokens are put out within words
    rng, split = random.Random(1), regex.compile(PATTERN)
    for room in (byte_bpe.STEPS, 50):  # with 50, the machine begins anew all the time
        machine = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS), room)
        for text in [*strange(rng, 1500), "<|endoftext|>", "x" * 5000]:
            assert [i for w in split.findall(text) for i in machine.encode(w.encode())] == library.encode_ordinary(text)


def test_neighbours_follow_exactly_if_plain_merging_keeps_them():
    rng = random.Random(2)
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS))
    tokens = [t for t in machine.ranks if machine._spines(t) is not None]
    for _ in range(20_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert machine.follows(a, b) == (machine.merged(a + b) == [a, b])


def test_vocabularies_whose_ranks_are_out_of_order():
    """Ranks in any order, tokens that merges never make: the rule is the library's all the same."""
    import tiktoken

    rng = random.Random(3)
    for _ in range(40):
        more = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))).encode() for _ in range(30)}
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(rng.sample(sorted(more), len(more)))}
        plain = tiktoken.Encoding("odd", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
        machine = byte_bpe.Transducer(ranks)
        for _ in range(100):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 25)))
            assert machine.encode(word.encode()) == plain.encode_ordinary(word), (ranks, word)


def test_streaming_decoder_equals_decode_with_replacement():
    rng = random.Random(4)
    decoder = byte_bpe.Decoder(byte_bpe.read_ranks(RANKS))
    for _ in range(3000):
        ids = [rng.choice((rng.randrange(256), rng.randrange(50_000))) for _ in range(rng.randint(0, 9))]
        got = "".join(decoder.feed([i]) for i in ids) + decoder.end()
        assert got == b"".join(decoder.tokens[i] for i in ids).decode(errors="replace")
    with pytest.raises(ValueError, match="no token"):
        decoder.feed([10**6])


def test_op11_query(spark, library, tmp_path):
    rows = [*ODD, *((1000 + k, t) for k, t in enumerate(strange(random.Random(5), 60)))]
    folder = table(tmp_path, "documents", spark.createDataFrame([(*r, "kept") for r in rows], DOCS + ", ids string"))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_byte_bpe_transducer(spark, folder).collect())
    want = [(str(i), len(ids := library.encode_ordinary(t or "")), sha(",".join(map(str, ids))), sha(library.decode_bytes(ids))) for i, t in rows]
    assert got == sorted(want)


def test_units_of_the_usual_pattern_never_change_ids(library):
    import tiktoken

    assert byte_bpe.USUAL == PATTERN
    other = r"\p{L}+|\s+|[^\s\p{L}]+"
    for pattern, plain in ((PATTERN, library), (other, tiktoken.Encoding("other", pat_str=other, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}))):
        to_ids, _ = byte_bpe._coder(RANKS, pattern)
        for text in [*strange(random.Random(11), 1500), "a\n b", "a.\nb, c", "x  \n\n y", "don't 's it.,"]:
            assert np.frombuffer(to_ids(text), "<u4").tolist() == plain.encode_ordinary(text)


def test_bpe_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ab cd", "x"), (None, None, "x")], DOCS + ", `a.row` string")
    coded = byte_bpe.encode(df, RANKS, PATTERN)
    assert coded.columns == ["doc_id", "a.row", "ids"] and byte_bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0
    back = byte_bpe.decode(coded, RANKS, PATTERN)
    assert sorted((str(r[0]), r[1], r[2]) for r in back.collect()) == [("1", "x", "ab cd"), ("None", "x", "")]
    assert byte_bpe.encode(df.select("text"), RANKS, PATTERN).count() == 2
    with pytest.raises(ValueError, match="ids"):
        byte_bpe.encode(df.withColumn("ids", F.lit(1)), RANKS, PATTERN)


# ---- 12


def plain_runs(s, times=4, least=6):
    found = {}
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            k = i
            while k + p < len(s) and s[k] == s[k + p]:
                k += 1
            if k + p - i >= max(least, times * p):
                found.setdefault((i, k + p), p)  # smaller periods come first
            i = k + 1
    # a multiple of a smaller period has the same stretch, which holds that period more often
    return sorted(((a, e - a, p) for (a, e), p in found.items()), key=lambda r: (r[0], r[2]))


def sequences(rng, n):
    for k in range(n):
        letters = rng.choice([1, 2, 2, 3, 5])
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
        s = (unit * 20)[: rng.randint(0, 40)] if k % 3 == 0 else [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
        if s and k % 2:
            s[rng.randrange(len(s))] = rng.randrange(letters)
        yield s + s[: rng.randint(0, len(s))]


def test_runs_equal_plain_search():
    for s in sequences(random.Random(6), 4000):
        assert periodic_runs.find_runs(s) == plain_runs(s), s
        assert periodic_runs.find_runs(s, 3, 7) == plain_runs(s, 3, 7), s
        assert periodic_runs.runs_of([b"%d" % v for v in s]) == plain_runs(s)


def test_smaller_suffixes_equal_their_definition():
    for s in sequences(random.Random(7), 1500):
        following, agree = periodic_runs.smaller_suffixes(s)
        for i in range(len(s)):
            j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
            assert following[i] == j
            if j < len(s):
                assert agree[i] == next((k for k in range(len(s) - j) if s[i + k] != s[j + k]), len(s) - j)


def test_a_pass_reads_each_item_a_few_times():
    class Counted(int):
        asked = 0

        def __eq__(self, other):
            Counted.asked += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    for s in ([0] * 20_000, ([0] * 50 + [1]) * 400, [0] * k + [1] if (k := 20_000) else [], sum(([0] * k + [1] for k in range(200)), []), b, ([0] * 500 + [1] + [0] * 499 + [2]) * 20):
        for sign in (1, -1):
            Counted.asked = 0
            periodic_runs.smaller_suffixes([Counted(sign * v) for v in s])
            assert Counted.asked <= 4 * len(s)


def planted(i, words):
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_op12_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [*ODD[:3], *ODD[4:], *((i, " ".join(rng.choice(("la", "li", f"w{rng.randrange(400)}")) for _ in range(rng.randint(1, 90)))) for i in range(300)), *((1000 + i, "\n".join(f"s{v}" for v in s)) for i, s in enumerate(sequences(rng, 100)))]
    folder = table(tmp_path, "documents", spark.createDataFrame([(*r, 5) for r in rows], DOCS + ", runs long"))
    want = []
    for i, t in rows:
        words = planted(i, (t or "").encode().split())
        runs = plain_runs(words)
        gone = {k for a, n, p in runs for k in range(a + p, a + n)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        want.append(tuple(map(str, (i, len(runs), *(best or [None] * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept)))))
    got = queries.op12_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted(want)
    assert sum(int(w[1]) for w in want) > 30


def test_runs_of_a_long_text_and_empty_tables(spark):
    df = spark.createDataFrame([ODD[3]], DOCS)
    assert [(r["runs"], r["collapsed"]) for r in periodic_runs.with_runs(df).collect()] == [([(0, 30_000, 1)], "x")]
    assert periodic_runs.with_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="runs"):
        periodic_runs.with_runs(df.withColumn("runs", F.lit(1)))


# ---- 13


def plain_whitening(rows, most):
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = {}
    for i, v in x.items():
        d = [n * c - s for c, s in zip(v, sums, strict=True)]
        out[i] = (sum(c * c for c in d), np.array(d, float) / n @ vectors / np.sqrt(values))
    return n, values / np.trace(centred.T @ centred / n), out


def held(got, rows, most):
    n, explained, want = plain_whitening(rows, most)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert {*by} == {*want}
    flip = None
    for i, (deviation, white) in want.items():
        each = sorted(by[i], key=lambda r: r["component"])
        assert [r["component"] for r in each] == list(range(1, len(white) + 1))
        assert {(r["n"], r["deviation"]) for r in each} == {(n, deviation)}
        mine = np.array([r["whitened"] for r in each])
        flip = np.sign(mine * white) if flip is None else flip
        assert np.allclose(mine * flip, white, atol=1e-7)
        assert np.allclose([r["explained"] for r in each], explained, rtol=1e-9) and each[0]["identity_error"] < 1e-9


def test_whitening_equals_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(9)
    scales = np.geomspace(8, 0.2, 20)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(0, 1, (400, 20)) * scales)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    bad = [(2000, None), (2001, [float("nan")] * 20), (2002, [None] * 20), (2003, [float("inf")] * 20), (2004, [1.0] * 19 + [None]), (2005, []), (2006, [1.0])]
    df = spark.createDataFrame([(*r, "kept") for r in rows + bad], "vec_id long, embedding array<double>, component string").repartition(5)
    got = queries.op13_whitening(spark, table(tmp_path, "embeddings", df))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held(got.collect(), rows, 16)


def test_whitening_of_few_dimensions_and_large_entries(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(v[0]), float(v[1]) * 1e13, float(v[0])]) for i, v in enumerate(rng.normal(0, 1, (50, 2)))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} <= {1, 2} and got[0]["identity_error"] < 1e-4  # two entries are one, so that the third has no variance
    assert {r["deviation"] for r in got} == {None}  # above 2**63
    some = [(i, [float(i), float(i * i), 2.0]) for i in range(6)]
    held(whitening.whiten(spark.createDataFrame(some, "vec_id long, embedding array<double>")).collect(), some, 2)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [0.0]), (None, [1.0]), (None, [1.0])], schema)).collect()
    assert sorted((str(r["vec_id"]), r["n"], r["deviation"], round(abs(r["whitened"]), 9)) for r in two) == [("1", 2, 64 * 64, 1.0), ("None", 2, 64 * 64, 1.0), ("None", 2, 64 * 64, 1.0)]


def test_even_texts_are_told_by_searches_that_skip_to_a_class():
    import re
    import time

    plain = re.compile(r"\x00|\s\s|(?<![A-Za-zÀ-ÖØ-öø-ÿ0-9])[.,]")
    gap = re.compile(r"(?<=\S)(?= )")
    rng = random.Random(12)
    bits = ["a", "É", "×", "÷", ".", ",", " ", "  ", "\n", "\t", "\0", "9", "\x1c", "\x85", "　", "‘", "x.", "ab cd"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        even = text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0").split("\0")
        assert tokenizing.units(text) == (gap.split(text) if plain.search(text) else even)

    def took(f, text):
        began = time.process_time()
        f(text)
        return time.process_time() - began

    # the one search was tried at every character: over half of the time that cutting takes
    text = "a word after another, and so on. " * 40_000
    assert min(took(tokenizing.units, text) for _ in range(5)) < 1.2 * min(took(plain.search, text) for _ in range(5))


def test_plain_words_are_one_match_of_the_usual_pattern(monkeypatch):
    found = []
    compiled = byte_bpe.regex.compile(byte_bpe.USUAL)

    class Seen:
        def findall(self, text):
            found.append(text)
            return compiled.findall(text)

    monkeypatch.setattr(byte_bpe.regex, "compile", lambda pattern: Seen())
    byte_bpe._coder.cache_clear()
    encode, decoder = byte_bpe._coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), byte_bpe.USUAL)
    byte_bpe._coder.cache_clear()
    text = "Plain words and  two, it's ÇA va 12ab."
    ids = np.frombuffer(encode(text), "<u4").tolist()
    assert decoder.feed(ids) + decoder.end() == text
    # every unit went through the pattern
    assert found and not [u for u in found if u.isascii() and u.strip(" ").isalpha() and not u.startswith("  ")]
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert ids == tiktoken.Encoding("x", pat_str=byte_bpe.USUAL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
