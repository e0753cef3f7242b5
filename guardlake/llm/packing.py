"""Packing along a space-filling curve.

Every document is tokenised once and stored as ids, with the projection of its hashed n-gram vector to a few
dimensions. The projections, standardised over all documents and taken through the normal distribution, are the
coordinates of a Hilbert key. The curve is cut into ranges of about equal numbers of ids, a task sorts a range by
(key, doc_id), and since the ids before each range are known, sequences run on over the ends of ranges: all are full
but the very last, however many partitions there are.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm.common import map_arrow, shuffle_partitions, stored, tokenizer_path

SEQ_LEN = 2048
END_ID = 1
DIMS, BITS = 4, 12
BUCKETS = 1 << 12
#: Bits of a key that the cuts of the curve do not look at, and bits of the coarse bins that come to the driver.
FINE_BITS, COARSE_BITS = 16, 16
#: Ids of a range at most (but for one document's own), however few shuffle partitions there are.
RANGE_IDS = 1 << 28
#: Bytes of text encoded at a time, and of ids in one batch that is given back.
ENCODE_BYTES = 2 << 20

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
IDS_SCHEMA = "doc_id long, " + ", ".join(f"x{i} float" for i in range(DIMS)) + ", n long, ids binary"


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20240607).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def hashed_vector(text: bytes) -> np.ndarray:
    """Unit vector of log-damped counts of hashed 4-byte grams; zero for an empty text."""
    b = np.frombuffer(text + b"\0\0\0", np.uint8).astype(np.uint32)
    h = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(0x9E3779B1)
    v = np.log1p(np.bincount(h >> np.uint32(20), minlength=BUCKETS).astype(np.float32)) if text else np.zeros(BUCKETS, np.float32)
    norm = math.sqrt(float(v @ v))
    return v / norm if norm else v


def hilbert_key(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points with integer axes (n, dims), each below 2**bits.

    Gray-code form of the curve: going down the bit planes, the axes below are inverted or
    exchanged with the first as the plane's bit says; the planes are then interleaved.
    """
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for i in range(dims):
            on = (x[i] & plane) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        plane >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in range(bits - 1, 0, -1):
        flip ^= np.where(x[dims - 1] >> q & 1, (1 << q) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for q in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> q & 1)
    return key


def curve_keys(points: np.ndarray) -> np.ndarray:
    """The Hilbert key of each standardised point (n, dims)."""
    quantile = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), otypes=[float])(points)
    return hilbert_key(np.minimum((quantile * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


class Encoder:
    """ids of a text by a vocabulary of the `tokenizers` library (at most 65 536 ids), 16 bits each.

    Where the same vocabulary also lies beside the file as ranks (`.tiktoken`), that library encodes: it gives the same
    ids five times as fast.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel unit
        self.path = path
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        self.fast = self._by_ranks(ranks) if os.path.exists(ranks) else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        return tokenizer

    @staticmethod
    def _by_ranks(path: str) -> Callable[[str], list[int]]:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            return np.array(self.fast(text), "<u2")
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _chunks(texts: list[bytes], most: int = ENCODE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about `most` bytes of text, one text at least."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _encode_rows(path: str, end_id: int):
    end = np.array([end_id], "<u2")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for lo, hi in _chunks(texts):
                points = np.zeros((hi - lo, DIMS), np.float32)
                for i in range(lo, hi):
                    points[i - lo] = hashed_vector(texts[i]) @ _projection()
                ids = [encoder.encode(t.decode("utf-8", "replace")) for t in texts[lo:hi]]
                sizes = pa.array([len(x) + 1 for x in ids], pa.int64())
                raw = pa.array([np.concatenate([x, end]).tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *(pa.array(points[:, j]) for j in range(DIMS)), sizes, raw], ["doc_id", *(f"x{j}" for j in range(DIMS)), "n", "ids"])

    return encode


def _key(moments: list[tuple[float, float]]) -> Column:
    """The Hilbert key of a stored row; moments: mean and deviation of each projection."""
    means, scales = (np.array(x) for x in zip(*moments, strict=True))

    @F.pandas_udf("long")
    def key(*xs: pd.Series) -> pd.Series:
        points = np.stack([x.to_numpy(np.float64) for x in xs], axis=1)
        return pd.Series(curve_keys((points - means) / scales) if len(points) else np.zeros(0, np.int64))

    return key(*[F.col(f"x{j}") for j in range(DIMS)])


class Cuts:
    """Ranges of the curve: a new one starts at each of `bins`; a bin with more ids than a range may hold is dealt over
    `parts` ranges of its own by a hash."""

    def __init__(self, rows: list[tuple[int, int]]) -> None:
        self.bins = np.array([r[0] for r in rows], np.int64)
        self.parts = np.array([r[1] for r in rows], np.int64)
        width = np.where(self.parts > 1, self.parts + 1, 1)
        self.first = np.cumsum(width) - width
        self.total = int(width.sum())

    def ranges(self, bins: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        i = np.maximum(np.searchsorted(self.bins, bins, "right") - 1, 0)
        own = np.where(bins == self.bins[i], hashes % self.parts[i], self.parts[i])
        return self.first[i] + np.where(self.parts[i] > 1, own, 0)


def curve_cuts(rows: DataFrame, target: int) -> Cuts:
    """Cuts of the curve so that ranges have about `target` ids. rows: key, n.

    Ids are summed by bins of the key; what comes to the driver are the sums of the coarse bins (65 536 at most) and the
    bins in which a range starts or that exceed one.
    """
    bins = rows.groupBy(F.shiftright("key", FINE_BITS).alias("bin")).agg(F.sum("n").alias("n"))
    bins = stored(bins.withColumn("coarse", F.shiftright("bin", DIMS * BITS - FINE_BITS - COARSE_BITS)), "bins")
    sums, before = [], 0
    for coarse, n in sorted(tuple(r) for r in bins.groupBy("coarse").agg(F.sum("n")).collect()):
        sums.append((coarse, before))
        before += n
    bases = bins.sparkSession.createDataFrame(sums or [(0, 0)], "coarse long, base long")
    ahead = F.col("base") + F.sum("n").over(Window.partitionBy("coarse").orderBy("bin")) - F.col("n")
    placed = bins.join(F.broadcast(bases), "coarse").select("bin", "n", ahead.alias("before"))
    starts = (F.col("before") == 0) | (F.floor(F.col("before") / target) != F.floor((F.col("before") - 1) / target)) | (F.floor((F.col("before") + F.col("n") - 1) / target) != F.floor(F.col("before") / target))
    found = placed.where(starts).select("bin", F.ceil(F.col("n") / target).cast("long")).collect()
    return Cuts(sorted(tuple(r) for r in found) or [(0, 1)])


def _range(cuts: Cuts) -> Column:
    @F.pandas_udf("int")
    def of(key: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series(cuts.ranges(key.to_numpy() >> FINE_BITS, spread.to_numpy()).astype(np.int32))

    return of(F.col("key"), F.col("spread"))


def _cut_rows(bases: dict[int, int], seq_len: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, rows, held = None, 0, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for where, doc, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if where != now:
                    now, at = where, bases[where]
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                start, total = 0, len(ids)
                while start < total:
                    take = min(total - start, seq_len - at % seq_len)
                    rows.append((doc, start, take, ids[start : start + take].tobytes(), total, at // seq_len, at % seq_len))
                    start += take
                    at += take
                    held += 4 * take
                    if held >= ENCODE_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return cut


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents into sequences of at most `seq_len` ids.

    Takes `doc_id` and `text` (other columns, whatever their names, are ignored); gives a row for each piece of a
    document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    Every document ends with `end_id`. All sequences are full but the last one of the table.

    Null text counts as empty and gives the end id alone. Repeated rows are packed each; rows with a null
    doc_id sort first among equal keys. Ties of the key go by doc_id, then by a checksum of the ids. An empty table
    gives no rows. One very long text spans many sequences; a key that many documents share is dealt over ranges by
    doc_id.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    ids = stored(map_arrow(plain, _encode_rows(path, end_id), IDS_SCHEMA), "ids")
    first = ids.agg(F.sum("n").alias("n"), *[f(f"x{j}").alias(f"{f.__name__}{j}") for j in range(DIMS) for f in (F.avg, F.stddev_pop)]).first()
    moments = [(first[f"avg{j}"] or 0.0, first[f"stddev_pop{j}"] or 1.0) for j in range(DIMS)]
    keyed = ids.withColumn("key", _key(moments))
    target = max(1, min(RANGE_IDS, -(-(first["n"] or 0) // shuffle_partitions(spark))))
    cuts = curve_cuts(keyed.select("key", "n"), target)
    placed = keyed.withColumn("spread", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).withColumn("range", _range(cuts))
    bases, before = {}, 0
    for where, n in sorted(tuple(r) for r in placed.groupBy("range").agg(F.sum("n")).collect()):
        bases[where] = before
        before += n
    dealt = placed.select("range", "doc_id", "ids", "key").repartitionById(cuts.total, "range")
    ordered = dealt.sortWithinPartitions("range", "key", "doc_id", F.crc32("ids")).select("range", "doc_id", "ids")
    return map_arrow(ordered, _cut_rows(bases, seq_len), PIECE_SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
