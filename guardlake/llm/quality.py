"""Importance resampling with hashed n-gram models.

A text's n-grams are its distinct words (ASCII punctuation off, lower case) and the distinct runs of one to three word
shapes (letters of a case, digits and marks as they follow each other), hashed to buckets. The target model counts, for
each bucket, the labelled texts worth having (quality 1, not toxic); the raw model counts all texts of the corpus. The log
ratio of a bucket is log p_target - log p_raw, taken as zero where the two counts differ by less than SHRINK deviations;
a document's importance is the sum over its n-grams, and k documents are sampled without replacement by Gumbel top-k.

A step of its own, `unwanted`, holds labelled toxic and low-quality texts against the target in the same way, and rejects
documents that one of the two explains better by more than MARGIN, whatever the draw said.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import free_names, loose_words, map_arrow, shingle_hashes, stored, word_hashes

#: The models are fitted on at most about this many labelled rows, chosen by a hash of their doc_id.
SAMPLE_ROWS = 20_000
WORD_BITS, SHAPE_BITS = 20, 18
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Deviations that a bucket's count must be off for its ratio to count: in the draw, and in the step against unwanted text.
SHRINK, SIGNIFICANT = 2.0, 4.0
#: Log ratio beyond which a document counts as explained by unwanted text.
MARGIN = 10.0
#: The draw takes the share of target texts among the labelled ones and so much more of all documents.
DRAW_SLACK = 0.05
TARGET, LOW, TOXIC = 1, 2, 3
EVERY_TARGET = 4  # target texts with all their copies, as raw text has them
_SHAPES = bytes(ord("A") if chr(b).isupper() and b < 128 else ord("a") if b >= 128 or chr(b).isalpha() else ord("9") if chr(b).isdigit() else b for b in range(256))
_RUNS = re.compile(rb"([aA9])\1+")


def ngram_buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's words and shape n-grams, in order."""
    if not text:
        return np.zeros(0, np.int64)
    words = word_hashes(loose_words(text)) >> np.uint64(64 - WORD_BITS)
    shapes = word_hashes(_RUNS.sub(rb"\1", text.encode("utf-8", "surrogatepass").translate(_SHAPES)))
    runs = np.concatenate([shingle_hashes(shapes, k) for k in (1, 2, 3) if len(shapes) >= k] or [shapes]) >> np.uint64(64 - SHAPE_BITS)
    return np.concatenate([np.unique(words.astype(np.int64)), np.unique(runs.astype(np.int64)) + (1 << WORD_BITS)])


def labelled_classes(labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, kind) of about `most` labelled documents; several rows of one count by their worst label."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    share = min(1.0, most / max(1, known.count()))  # some rows stay, however many there are
    kind = F.when(F.col("t") > 0, TOXIC).when(F.col("q") > 0, TARGET).otherwise(LOW)
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < max(1, int(share * (1 << 40)))).select(F.col("doc_id").cast("long").alias("label_id"), kind.alias("kind"))


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = []
        for text in b.column(2).to_pylist():
            h = shingle_hashes(word_hashes(loose_words(text or "")), 5)
            keys.append(int(h.min()) - (1 << 63) if len(h) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], ["doc_id", "kind", "key"])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one partition: (bucket, kind, n); kind 0 is the whole corpus."""
    counts = {0: np.zeros(BUCKETS, np.int32)}
    for b in batches:
        for label, kind, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            buckets = ngram_buckets(text)
            for k in [0, *([kind] if kind else []), *([EVERY_TARGET] if label == TARGET else [])]:
                if k not in counts:
                    counts[k] = np.zeros(BUCKETS, np.int32)
                counts[k][buckets] += 1
    for kind, n in counts.items():
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), kind, np.int32)), pa.array(n[part].astype(np.int64))], ["bucket", "kind", "n"])


@dataclass
class Model:
    """Log ratios by bucket: of target against raw text, against toxic and against low-quality text; and the share of
    target texts among the labelled ones (1 without any)."""

    raw: np.ndarray
    toxic: np.ndarray
    low: np.ndarray
    share: float = 1.0

    def log_ratios(self, text: str | None) -> tuple[float, float]:
        """(importance, smaller ratio against unwanted text)."""
        b = ngram_buckets(text)
        raw, toxic, low = (float(x[b].sum(dtype=np.float64)) for x in (self.raw, self.toxic, self.low))
        return raw, min(toxic, low)


def raw_ratio(totals: dict[str, float]) -> Column:
    """log p_target - log p_raw of a bucket, one occurrence added to both; 0 if the target's count is near what raw text
    lets expect."""
    expected = F.col("raw") * F.lit(totals["every"] / max(totals["raw"], 1.0))
    off = F.abs(F.col("every") - expected) / F.sqrt(expected + 0.5)
    return F.when(off >= SHRINK, F.log((F.col("every") + 1) / (expected + 1))).otherwise(0.0)


def unwanted_ratio(bad: str, texts: dict[str, float]) -> Column:
    """log p_target - log p_bad of a bucket, with the corpus as common prior; 0 unless the counts differ significantly."""
    n_t, n_b = texts["target"], texts[bad]
    prior = F.col("raw") / F.lit(max(texts["raw"], 1.0)) + 0.02
    ratio = F.log((F.col("target") + prior) / F.lit(n_t + 1)) - F.log((F.col(bad) + prior) / F.lit(n_b + 1))
    both, share = F.col("target") + F.col(bad), n_t / max(n_t + n_b, 1.0)
    off = F.abs(F.col("target") - both * share) / F.sqrt(both * (share * (1 - share)) + 0.5)
    return F.when(off >= SIGNIFICANT, ratio).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled rows among `docs`, with counts over all of `docs`.

    The target model counts labelled texts with all their copies, as the raw model does. In the models against unwanted
    text, of labelled near copies (equal smallest shingle hash) one counts. Without labelled target texts all ratios are one.
    The labelled rows (bounded by `sample_rows`) are broadcast; the driver receives the buckets with a ratio, at most
    as many as there are buckets.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = F.broadcast(labelled_classes(labels, sample_rows))
    copies = map_arrow(plain.join(marked, F.col("doc_id") == F.col("label_id")).select("doc_id", F.col("kind").cast("int").alias("kind"), "text"), _copy_keys, "doc_id long, kind int, key long")
    chosen = stored(copies.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "kind")).alias("c")).select("c.*").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("kind").alias("kind")), "labelled")
    kinds = {r["kind"]: r["n"] for r in chosen.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    both = F.broadcast(labelled_classes(labels, sample_rows).select(F.col("label_id").alias("any_id"), F.col("kind").cast("int").alias("label")))
    known = plain.join(both, F.col("doc_id") == F.col("any_id"), "left").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"), "left")
    counted = map_arrow(known.select("label", "kind", "text"), _count_rows, "bucket int, kind int, n long")

    def of(kind: int, name: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).cast("double").alias(name)

    table = stored(counted.groupBy("bucket").agg(of(0, "raw"), of(TARGET, "target"), of(LOW, "low"), of(TOXIC, "toxic"), of(EVERY_TARGET, "every")), "ngrams")
    model = Model(*(np.zeros(BUCKETS, np.float32) for _ in range(3)))
    if kinds.get(TARGET):
        totals = table.agg(F.sum("raw").alias("raw"), F.sum("every").alias("every")).first().asDict()
        texts = {"raw": float(max(1, docs.count())), "target": float(kinds[TARGET]), "low": float(kinds.get(LOW, 0)), "toxic": float(kinds.get(TOXIC, 0))}
        against = {"raw": raw_ratio(totals)} | {bad: unwanted_ratio(bad, texts) for bad in ("toxic", "low") if texts[bad]}
        ratios = table.select("bucket", *[x.cast("float").alias(name) for name, x in against.items()])
        found = ratios.where(" or ".join(f"{name} <> 0" for name in against)).toArrow()
        at = found.column("bucket").to_numpy()
        for name in against:
            getattr(model, name)[at] = found.column(name).to_numpy()
        model.share = kinds[TARGET] / sum(kinds.values())
    return model


def gumbel(doc_id: int | None, text: str | None) -> float:
    """Standard Gumbel noise that depends on the row alone."""
    h = xxhash.xxh3_64_intdigest(f"{doc_id}:".encode() + (text or "").encode("utf-8", "surrogatepass"), seed=5)
    return -math.log(-math.log(((h >> 11) + 0.5) / (1 << 53)))


def _score_rows(model: Model, id_at: int, text_at: int, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(id_at).to_pylist(), b.column(text_at).to_pylist()
            found = [model.log_ratios(t) for t in texts]
            keys = [r + gumbel(d, t) for d, t, (r, _) in zip(ids, texts, found, strict=True)]
            columns = [pa.array([f[0] for f in found], pa.float64()), pa.array(keys, pa.float64()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names)

    return rows


def _scored(docs: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """The rows with log_ratio, sample_key and unwanted, stored, so scored once; and the names of the three."""
    names = free_names(docs, "log_ratio", "sample_key", "unwanted")
    types = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{n} double" for n in names)])
    return stored(map_arrow(docs, _score_rows(model, docs.columns.index("doc_id"), docs.columns.index("text"), [*docs.columns, *names]), types), "scores"), names


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly: histograms of 4096 bins narrow the range until few values are left."""
    if k <= 0:
        return math.inf
    lo, hi, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0 or k >= n:
        return -math.inf
    while True:
        inside = values.where(F.col(column).between(lo, hi))
        width = (hi - lo) / 4096
        if not width or lo + width == lo:
            return lo
        bins = sorted(inside.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(4095)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True)
        for _, n, low, high in bins:
            if k <= n:
                break
            k -= n
        lo, hi = low, high
        if lo == hi:
            return lo
        if n <= 4096:
            return sorted((r[0] for r in values.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)[k - 1]


def draw_size(n: int, model: Model) -> int:
    """Documents that the draw takes of n, if nothing else is asked for."""
    return math.ceil(n * min(1.0, model.share + DRAW_SLACK))


def _sampled(docs: DataFrame, labels: DataFrame, k: int | None, margin: float) -> tuple[DataFrame, list[str]]:
    """The rows that were drawn and are not explained by unwanted text, with their scores."""
    model = fit(docs, labels)
    scored, names = _scored(docs, model)
    size = draw_size(scored.count(), model) if k is None else k
    ratio, key, bad = names
    drawn = scored.where(F.col(key) >= kth_largest(scored, key, size))
    return drawn.where(F.col(bad) > -margin), names


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, margin: float = MARGIN) -> DataFrame:
    """doc_id, log_ratio, sample_key and unwanted (the smaller log ratio of target against toxic and against low-quality
    text) of the documents drawn and not rejected. k: how many are drawn; by default `draw_size`.

    Null and empty texts have no n-gram and ratio one. Repeated rows have equal keys and stay or go together, so more
    than k rows can stay where the last place is shared. Extra columns, whatever their names, are ignored. Without labels
    everything is drawn.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _sampled(plain, labels, k, margin)[0].drop("text")


def keep_sample(docs: DataFrame, labels: DataFrame, k: int | None = None, margin: float = MARGIN) -> DataFrame:
    """The documents that `resample` gives, all columns."""
    return _sampled(docs, labels, k, margin)[0].select(*[F.col(f"`{c}`") for c in docs.columns])
