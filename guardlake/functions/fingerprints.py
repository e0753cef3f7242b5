"""Content fingerprints: rolling hashes of byte runs, winnowed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from guardlake.functions.text import canonicalize

# Run length in bytes, window, base and prime modulus of the rolling hash; hits that prove reuse.
RUN, WINDOW, BASE, MODULUS = 32, 8, 257, (1 << 61) - 1
MIN_HITS = 3
_M, _LOW = np.uint64(MODULUS), np.uint64((1 << 32) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _M) + (x >> np.uint64(61))
    return np.where(x >= _M, x - _M, x)


def _times(x: np.ndarray, y: int) -> np.ndarray:
    """x * y modulo 2**61 - 1 for x below it: y is cut in pieces that keep products inside 64 bits."""
    out, shift = np.zeros_like(x), 0
    low = x & _LOW
    high = x >> np.uint64(32)
    while y:
        part = np.uint64(y & 0xFFFF)
        value = _fold(low * part)
        upper = _fold(high * part)
        for _ in range(2):  # times 2**32, in two steps of 16 bits
            upper = _shift16(upper)
        value = _fold(value + upper)
        for _ in range(shift):
            value = _shift16(value)
        out = _fold(out + value)
        y >>= 16
        shift += 1
    return out


def _shift16(x: np.ndarray) -> np.ndarray:
    """x * 2**16 modulo 2**61 - 1: the bits shifted out come in again below."""
    return _fold(((x << np.uint64(16)) & _M) | (x >> np.uint64(45)))


def rolling_hashes(data: bytes) -> np.ndarray:
    """Hash of every run of RUN bytes: doubling the run length in each of five steps."""
    n = len(data) - RUN + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64)
    width = 1
    while width < RUN:  # hash of 2w bytes = hash of the first w times base**w, plus hash of the next w
        h = _fold(_times(h[: len(h) - width], pow(BASE, width, MODULUS)) + h[width:])
        width *= 2
    return h


def winnow(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct minima of every WINDOW consecutive hashes; of fewer, their minimum."""
    if not len(hashes):
        return hashes
    if len(hashes) <= WINDOW:
        return hashes.min(keepdims=True)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).min(axis=1))


def fingerprint_bytes(data: bytes) -> list[int]:
    return winnow(rolling_hashes(data)).astype(np.int64).tolist()


@F.pandas_udf(ArrayType(LongType()))
def _fingerprints(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fingerprint_bytes(t.encode("utf-8", "surrogatepass")))


def fingerprints(text: Column) -> Column:
    """Sorted fingerprints of the canonical text; empty below RUN bytes."""
    return _fingerprints(canonicalize(text))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


# Parts of paths that commonly lead to credentials.
SENSITIVE_MARKERS = (
    "/etc/passwd", "/etc/shadow", "/etc/sudoers", "/etc/hosts", "/.ssh", "/.aws", "/.gnupg", "/.netrc", "/.npmrc", "/.docker",
    "id_rsa", "id_ed25519", "credentials", "authorized_keys", ".env",
)
MIN_LITERAL = 12
# What counts as a URL and as a path; group 1 is set for paths alone.
LITERAL_PATTERN = r"""(?i)\b[a-z][a-z0-9+.-]*://[^\s'")>\]]+|(?:^|[\s'"(<\[])(~?/[A-Za-z0-9._/-]{6,})"""


def literals(text: Column) -> Column:
    """URLs and telling paths of a text, lower case, in order; repeats stay."""
    wholes = F.regexp_extract_all(text, F.lit(LITERAL_PATTERN), 0)
    paths = F.regexp_extract_all(text, F.lit(LITERAL_PATTERN), 1)

    def entry(whole: Column, path: Column) -> Column:
        is_path = path != ""
        value = F.regexp_replace(F.when(is_path, path).otherwise(whole), r"""[.,;)"']+\z""", "")
        return F.struct(is_path.alias("is_path"), value.alias("value"), F.lower(value).alias("lower"))

    def keep(e: Column) -> Column:
        marked = F.lit(False)
        for m in SENSITIVE_MARKERS:
            marked = marked | F.contains(e["lower"], F.lit(m))
        telling = marked | F.startswith(e["value"], F.lit("~")) | F.contains(e["value"], F.lit("."))
        long = F.octet_length(e["value"]) >= MIN_LITERAL
        return F.when(e["is_path"], telling & (long | marked)).otherwise(long)

    return F.transform(F.filter(F.zip_with(wholes, paths, entry), keep), lambda e: e["lower"])
