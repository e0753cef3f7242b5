"""Substring dedup over sliding spans of sentences.

A span is a run of several consecutive sentences: from every sentence the fewest (two at least) that
reach MIN_WORDS words, read forwards and backwards, so that a repeated passage of that many words is
covered whole by spans that lie inside it. A sentence of LONG_WORDS words is a span by itself. Spans are
hashed (128 bits), grouped over the corpus, and every sentence that a non-first occurrence covers is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import free_names, map_arrow, rekeyed, stored

MIN_WORDS, LONG_WORDS = 30, 50
#: A sentence ends after a mark and white space, or at a line end.
_END = re.compile(r"(?<=[.!?])[^\S\n]+|\s*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, code points, white space around left out."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def spans(counts: list[int], min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int]]:
    """(first, last + 1) of every span, in order, given the sentences' word counts. Linear in their number."""
    n, found = len(counts), set()
    j = total = 0
    for i in range(n):  # forwards from i
        while j < n and (total < min_words or j - i < 2):
            total += counts[j]
            j += 1
        if total >= min_words and j - i >= 2:
            found.add((i, j))
        if j > i:
            total -= counts[i]
        else:
            j = i + 1
    i, total = n, 0
    for j in range(n, 0, -1):  # backwards from j
        while i > 0 and (total < min_words or j - i < 2):
            i -= 1
            total += counts[i]
        if total >= min_words and j - i >= 2:
            found.add((i, j))
        if i < j:
            total -= counts[j - 1]
    found.update((k, k + 1) for k, c in enumerate(counts) if c >= long_words)
    return sorted(found)


def _span_rows(min_words: int, long_words: int):
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, tags, texts = (b.column(i).to_pylist() for i in range(3))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, tag, text in zip(docs, tags, texts, strict=True):
                words = [text[s:e].lower().encode("utf-8", "surrogatepass").split() for s, e in sentences(text or "")]
                joined = [b" ".join(w) + b"\n" for w in words]
                for i, j in spans(list(map(len, words)), min_words, long_words):
                    h = xxhash.xxh3_128_intdigest(joined[i] + joined[i + 1] if j - i == 2 else b"".join(joined[i:j]))
                    for column, value in zip(out, (doc, tag, i, j, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc, tag, first, last, source) of every span that is not its first occurrence; source is the first one's document.

    Spans are a table of their own, so texts are split and hashed once; hashes are counted before any place is compared.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("tag"), F.col("text").cast("string"))
    rows = stored(map_arrow(keyed, _span_rows(min_words, long_words), "doc long, tag long, first int, last int, k1 long, k2 long"), "spans")
    twice = rows.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").select(rekeyed("k1").alias("again"))
    shared = stored(rows.join(twice, F.col("k1") == F.col("again"), "left_semi"), "shared")
    place = F.struct("doc", "tag", "first")
    once = shared.groupBy("k1", "k2").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1")
    once = once.select(rekeyed("k1").alias("j1"), rekeyed("k2").alias("j2"), "origin")
    later = shared.join(once, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))).where(place != F.col("origin"))
    return later.select("doc", "tag", "first", "last", F.col("origin.doc").alias("source"))


def _cut(text: str, cuts: list[dict]) -> tuple[str, int]:
    """The text without the sentences covered, and how many those are."""
    where = sentences(text)
    gone = set()
    for c in cuts:
        gone.update(range(c["first"], c["last"]))
    parts, at = [], 0
    for k, (start, _) in enumerate(where):  # what stands between goes with the sentence before it
        end = where[k + 1][0] if k + 1 < len(where) else len(text)
        parts.append(text[at:start] if k == 0 else "")
        if k not in gone:
            parts.append(text[start:end])
        at = end
    return "".join(parts) if where else text, len(gone)


def _cut_rows(names: list[str]):
    at, cuts_at = names.index("text"), len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cuts = b.column(at).to_pylist(), b.column(cuts_at).to_pylist()
            done = [(t, 0) if t is None or not c else _cut(t, c) for t, c in zip(texts, cuts, strict=True)]
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array([t for t, _ in done], pa.string())
            totals = [len(sentences(t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array([n for _, n in done], pa.int64()), b.column(cuts_at + 1)], [*names, "n_sentences", "n_removed", "sources"])

    return cut


def dedup_spans(docs: DataFrame, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents, all columns, without the sentences of later repeats; n_sentences, n_removed and sources
    (doc_ids of the first occurrences, sorted) are added.

    Sentences are compared by their lower-cased words. Null text stays null, empty text empty. The order of
    occurrences is (doc_id, text hash, sentence); rows with equal doc_id and text stand in one place and keep
    the same. A null doc_id sorts first. Extra columns may have any names but those added here, which
    replace them.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed", "sources")]
    doc, tag, d, t, cuts, sources = free_names(docs, "doc", "tag", "d", "t", "cuts", "sources_")
    marks = repeated_spans(docs, min_words, long_words).groupBy("doc", "tag").agg(F.collect_set(F.struct("first", "last")).alias(cuts), F.array_sort(F.collect_set("source")).alias(sources))
    marks = marks.select(rekeyed("doc").alias(d), rekeyed("tag").alias(t), cuts, sources)
    here = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(doc), F.xxhash64("text").alias(tag))
    joined = here.join(marks, (F.col(doc) == F.col(d)) & (F.col(tag) == F.col(t)), "left").select(*[F.col(f"`{c}`") for c in names], cuts, sources)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in names]).schema)
    return map_arrow(joined, _cut_rows(names), f"{out}, n_sentences long, n_removed long, sources array<long>")
