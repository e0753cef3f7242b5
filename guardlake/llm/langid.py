"""Language identification by nearest centroids.

A text becomes a unit vector of TF-IDF weights of hashed byte n-grams (its letters, lower case). Each
language has several centroids, found by spherical k-means on a bounded sample of its distinct labelled texts; a text
takes the language of the centroid with the largest cosine, and is flagged `rejected` if it is farther from it than
nearly all training texts of that language are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm.common import map_arrow, stored

#: At most this many distinct texts of a language, and about so many of all, are used for fitting: those with the smallest
#: hashes. Every language has one at least; with more languages than SAMPLE_ROWS, the most frequent ones are learned.
LANGUAGE_ROWS, SAMPLE_ROWS = 400, 20_000
CENTROIDS = 4
BUCKETS = 1 << 12
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case words of letters with single blanks around; '' if there is no letter."""
    kept = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {kept} " if any(c.isalpha() for c in kept) else ""


def gram_counts(clean: str) -> np.ndarray:
    """Log-damped counts of hashed 2-, 3- and 4-byte grams."""
    b = np.frombuffer(clean.encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] | b[1:] << 8
    three = two[:-1] | b[2:] << 16
    four = three[:-1] | b[3:] << 24
    h = np.concatenate([two * np.uint32(0x85EBCA6B), three * np.uint32(0x9E3779B1), four * np.uint32(0xC2B2AE35)]) >> np.uint32(20)
    return np.log1p(np.bincount(h, minlength=BUCKETS).astype(np.float32))


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    reach: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        clean = letters(text)
        if not clean or not self.languages:
            return UNKNOWN, 0.0, True
        v = gram_counts(clean) * self.idf
        cosines = self.centroids @ v / max(float(np.linalg.norm(v)), 1e-12)
        k = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[k])))
        return self.languages[self.owner[k]], score, score < float(self.reach[self.owner[k]])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit rows; starts from the mean's nearest row and then the rows farthest off."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[of == j].sum(axis=0) if (of == j).any() else c[j] for j in range(len(c))]))
    return c


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, hash, v) of each (lang, hash) of the partition once; there are as many as the sample has, at most."""
    seen: set[tuple[str, int]] = set()
    for b in batches:
        rows = []
        for key, text in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True):
            if key not in seen:
                seen.add(key)
                rows.append((*key, gram_counts(letters(text)).astype(np.float16).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "hash", "v"])


def sample(rows: DataFrame, language_rows: int = LANGUAGE_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, hash) of the texts that are learned: of each language the distinct texts with the smallest hashes.

    Hashes below a share of the range are gathered, the share twice what the estimated number of distinct texts asks
    for, and doubled for languages that had too few; what is gathered is bounded by the sample however often texts repeat.
    """
    spark = rows.sparkSession
    keyed = rows.select("lang", F.xxhash64("text").alias("hash"))
    counts = keyed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("d")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()
    each = max(1, min(language_rows, sample_rows // max(1, len(counts))))
    found, shares = None, {r["lang"]: min(1.0, 2.0 * each / max(1, r["d"])) for r in counts}
    while shares:
        wanted = spark.createDataFrame([(lang, -(1 << 63) + (int(share * (1 << 53)) << 11) - 1) for lang, share in sorted(shares.items())], "l string, most long")
        below = keyed.join(F.broadcast(wanted), F.col("lang") == F.col("l")).where("hash <= most").select("lang", "hash").distinct()
        ranked = below.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("rank") <= each)
        got = stored(ranked.select("lang", "hash"), "sample")
        enough = {r["lang"]: r["n"] for r in got.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        done = [lang for lang, share in shares.items() if share >= 1 or enough.get(lang, 0) >= each]
        part = got.where(F.col("lang").isin(done)) if len(done) < len(shares) else got
        found = part if found is None else found.unionByName(part)
        shares = {lang: min(1.0, 4 * share) for lang, share in shares.items() if lang not in set(done)}
    return found if found is not None else keyed.limit(0)


def fit(rows: DataFrame, language_rows: int = LANGUAGE_ROWS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of rows (text, lang); rows without lang, text or letters teach nothing."""
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = sample(rows, language_rows, sample_rows).select(F.col("lang").alias("l"), F.col("hash").alias("h"))
    texts = rows.select("lang", F.xxhash64("text").alias("hash"), "text").join(F.broadcast(chosen), (F.col("lang") == F.col("l")) & (F.col("hash") == F.col("h"))).select("lang", "hash", "text")
    vectors = map_arrow(texts, _vector_rows, "lang string, hash long, v binary").groupBy("lang", "hash").agg(F.max("v").alias("v"))
    found = sorted((r["lang"], bytes(r["v"])) for r in vectors.collect())
    languages = sorted({lang for lang, _ in found})
    x = np.stack([np.frombuffer(v, np.float16) for _, v in found]).astype(np.float32) if found else np.zeros((0, BUCKETS), np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = _unit(x * idf)
    owner, centroids, reach = [], [], []
    of = np.array([lang for lang, _ in found])
    for i, lang in enumerate(languages):
        own = x[of == lang]
        c = spherical_kmeans(own, CENTROIDS)
        owner += [i] * len(c)
        centroids.append(c)
        reach.append(0.8 * np.quantile((own @ c.T).max(axis=1), 0.01))
    return Model(languages, np.array(owner, int), np.concatenate(centroids) if centroids else np.zeros((0, BUCKETS), np.float32), idf, np.array(reach))


def _predict_rows(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return rows


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1) and rejected for every document.

    Null texts and texts without letters are `und` with score 0, and so is everything if nothing could be learned.
    Equal texts get equal answers; ties go to the first language in order. Extra columns are ignored.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _predict_rows(model), "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept out of learning: crc32(doc_id as text) mod 4 is 2. A null doc_id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
