"""Language identification by nearest centroid over normalised TF-IDF character n-gram vectors, with rejection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim

#: Hash slots of n-grams; centroids a language; rows a language and characters a row of the sample that is fitted.
SLOTS, CENTROIDS, SAMPLE, SAMPLE_CHARS = 1 << 14, 4, 600, 20_000
#: Labels with the most rows that are learned, and rows of all of them together in the sample, which the driver holds.
LANGUAGES, SAMPLE_ROWS = 400, 24_000
#: A vector is rejected below this share of the least similarity seen for texts of about its length in its language.
MARGIN = 0.8
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of the text's letter 1- to 3-grams, in lower case, words apart; empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0)
    c = np.where(letter, c, np.uint32(32))
    c = np.concatenate([[np.uint32(32)], c[letter | np.concatenate([[False], letter[:-1]])], [np.uint32(32)]]).astype(np.uint32)
    mix = lambda h, salt: ((h ^ np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(18)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:] if len(two) > 1 else two[:0]
    counts = np.bincount(np.concatenate([mix(c[c != 32], 1), mix(two, 2), mix(three, 3)]), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    return slots, counts[slots].astype(np.float64)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # slots x all centroids
    owner: np.ndarray  # language of each
    floors: np.ndarray  # language x length class

    def score(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine with its nearest centroid (0 to 1), and whether it is too far from it."""
        slots, counts = grams(text or "")
        if not len(slots) or not self.languages:
            return UNKNOWN, 0.0, True
        v = counts * self.idf[slots]
        norm = np.linalg.norm(v)
        if not norm:
            return UNKNOWN, 0.0, True
        cosine = v @ self.centroids[slots] / norm
        best = int(np.argmax(cosine))
        value, language = float(min(1.0, max(0.0, cosine[best]))), int(self.owner[best])
        return self.languages[language], value, bool(value < MARGIN * self.floors[language, _length_class(counts)])


def _length_class(counts: np.ndarray) -> int:
    return min(15, int(np.log2(1 + counts.sum())))


def fit(texts: list[str], labels: list[str]) -> Model:
    languages = sorted(set(labels))
    vectors = [grams(t) for t in texts]
    df = np.zeros(SLOTS)
    for slots, _ in vectors:
        df[slots] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 0.1
    centroids, owner = [], []
    floors = np.ones((len(languages), 16))
    for k, language in enumerate(languages):
        mine = [v for v, label in zip(vectors, labels, strict=True) if label == language and len(v[0])]
        if not mine:
            continue
        x = np.zeros((len(mine), SLOTS), np.float32)
        for row, (slots, counts) in zip(x, mine, strict=True):
            row[slots] = counts * idf[slots]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rng = np.random.default_rng(7)
        c = x[rng.choice(len(x), min(CENTROIDS, len(x)), replace=False)]
        for _ in range(10):
            near = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.linalg.norm(c, axis=1, keepdims=True)
        centroids.append(c)
        owner += [k] * len(c)
        best, size = (x @ c.T).max(1), np.array([_length_class(v[1]) for v in mine])
        for s in range(15, -1, -1):  # shorter texts are less similar: a floor never rises towards them
            here = best[size == s]
            floors[k, s] = min(here.min() if len(here) else 1.0, floors[k, s + 1] if s < 15 else 1.0)
        for s in range(int(size.min())):  # lengths below any seen
            floors[k, s] = 0.0
    return Model(languages, idf, np.concatenate(centroids).T if centroids else np.zeros((SLOTS, 0)), np.array(owner, int), floors)


def held_out(id_column: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on up to SAMPLE texts a language, of at most SAMPLE_CHARS characters, in order of a hash of their id.

    Longer texts don't train. Of more than LANGUAGES labels, those with the fewest rows aren't learned, and with many labels each has fewer
    rows in the sample: the driver gets at most about SAMPLE_ROWS texts, however dirty the labels are.
    """
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect()}
    most = max(1, min(SAMPLE, SAMPLE_ROWS // max(1, len(sizes))))
    texts, labels = [], []
    chance = F.pmod(F.xxhash64(id_col), F.lit(1_000_000))
    share = F.lit(0)
    for language, n in sorted(sizes.items()):
        share = F.when(F.col(lang_col) == language, min(1_000_000, 1 + 1_300_000 * most // n)).otherwise(share)
    seen: dict[str, int] = {}
    drawn = rows.where(chance < share).select(text_col, lang_col, chance.alias("_c"), id_col).orderBy("_c", id_col, text_col).limit(2 * most * max(1, len(sizes)))
    for text, language, *_ in drawn.collect():
        if seen.setdefault(language, 0) < most:
            seen[language] += 1
            texts.append(text)
            labels.append(language)
    return fit(texts, labels)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected, from the text alone and all of it.

    A null text, or one without a letter, is UNKNOWN with score 0 and rejected. An empty table gives an empty result;
    repeated rows equal results; of equally near centroids the first language in order of its name wins. Columns named
    lang_pred, score or rejected are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        claim("language")
        found = [shared.value.score(t.as_py()) for t in texts]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=["lang_pred", "score", "rejected"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.withColumn("_language", predict(F.col(text_col))).select(*kept, "_language.lang_pred", "_language.score", "_language.rejected")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, with their own columns only, without those that identify() rejects."""
    found = identify(docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("text")), model)
    return found.where(~F.col("rejected")).select("_doc.*")
