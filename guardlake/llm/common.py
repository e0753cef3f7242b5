"""What the operators of this package share: reading tables, the shared folder, word hashes."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What punctuation becomes before words are split: ASCII marks turn to spaces.
WORD_BREAKS = bytes(32 if (b < 128 and not chr(b).isalnum()) else b for b in range(256))
#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Set to a local one only where it is unset (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="guardlake-"))
        found = sc.getCheckpointDir()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may be gone at exit
            pass

    atexit.register(drop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage ends here, and lost executors cost nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of about BATCH_BYTES (one row at least), so a worker's memory does not depend on how
    many rows or how long texts a partition has. The bound is a setting of the session and stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(key, None) or "")
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    if any("." in c or "`" in c for c in df.columns):  # mapInArrow looks columns up by name; functions go by place
        df = df.toDF(*free_names(df, *[f"c{i}" for i in range(len(df.columns))]))
    return df.mapInArrow(rows, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after them where a column of the table has that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rekeyed(name: str):
    """The long column under an equal value that the optimizer does not take for the column itself.

    A join against an aggregate on the same key would reuse the aggregate's partitioning, and
    adaptive execution can then not split a hot key. With this, both sides get an exchange of
    their own and skewed partitions are split.
    """
    return F.col(name).bitwiseXOR(F.lit(0).cast("long"))


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= _MIX[3]
    x ^= x >> np.uint64(32)
    x *= _MIX[3]
    x ^= x >> np.uint64(32)
    return x


#: Words longer than this are hashed one by one.
LONG_WORD = 64
_IN_WORD = np.ones(256, np.uint8)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = 0
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a text, parted by ASCII white space."""
    inside = np.zeros(len(text) + 2, np.uint8)
    inside[1:-1] = _IN_WORD[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time over all words at once; nothing is cached."""
    starts, ends = word_bounds(text)
    sizes = ends - starts
    padded = text + bytes(8)
    eights = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    out = sizes.astype(np.uint64) * _MIX[0]
    which, at, left = slice(None), starts, sizes
    while len(at):
        out[which] = mix64(out[which] ^ (eights[at] & _LOW_BYTES[np.minimum(left, 8)])) * _MIX[1]
        more = np.flatnonzero((left > 8) & (left <= LONG_WORD))
        which = more if isinstance(which, slice) else which[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return out


def words_of_all(texts: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text, computed over all of them at once."""
    hashes, starts = word_hashes(joined := b"\n".join(texts)), word_bounds(joined)[0]
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return [hashes[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def loose_words(text: str) -> bytes:
    """Lower-cased text in which ASCII punctuation is white space; `word_hashes` takes its words."""
    return text.lower().encode("utf-8", "surrogatepass").translate(WORD_BREAKS)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k words; a shorter text is one run; no words, no run."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        acc *= _MIX[i % 5]
        acc += hashes[i : n - width + 1 + i]
    return mix64(acc)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies: GUARDLAKE_TOKENIZERS or the installed public_tokenizers."""
    if folder := os.environ.get("GUARDLAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
