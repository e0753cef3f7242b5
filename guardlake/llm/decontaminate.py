"""Benchmark decontamination by SimHash of item-sized windows.

A document is read in steps of STEP words. For every window size that some item needs, each window
that starts at a step gets a 64-bit SimHash of its words. A copy that reaches the threshold has lost at most a fifth of
its item's shingles, so an item's windows are short enough to fit into what must be left of it, and are indexed at every
shift: wherever a copy starts and whatever its ends lack, one document window lines up with one of the item's.
The index has four 16-bit blocks with all values one bit away: any two fingerprints within RADIUS
(7) share a block with at most one wrong bit, so none within the radius is lost. Candidates are then
verified by the exact weighted similarity of the word shingles of the whole item-sized window.

Items of fewer than SHORT words have too few for such windows: any of their shingles in a document makes the window
around it a candidate, which loses none.

Everything about a document happens in one task: no shuffle at all. Items travel in blocks of
bounded bytes, one pass for each block; weights of shingles are counted over the whole benchmark first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import loose_words, map_arrow, shingle_hashes, stored, word_hashes, words_of_all

STEP = 8
SIZES = (8, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
RADIUS = 7
SHINGLE, SIMILARITY = 5, 0.8
#: Items with fewer words are found by their shingles.
SHORT = 17
#: Most bytes of item texts that one block holds; more items make more blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of text that one round covers.
ROUND_BYTES = 1 << 20

HIT_SCHEMA = "doc_id long, item_id long, similarity double, word_start long, item_words long"


def window_size(n_words: int) -> int:
    """Window size for an item of so many words: with STEP - 1 words more it fits into the rest of a copy that lacks a
    fifth of the shingles at its ends. 0 for short items."""
    left = n_words - (n_words - SHINGLE + 1) // 5
    return 0 if n_words < SHORT else [m for m in SIZES if m + STEP - 1 <= left][-1]


def bit_counts(hashes: np.ndarray, step: int) -> np.ndarray:
    """Running sums of the 64 bits of the words' hashes, a row for every `step` words and one of zeros first."""
    n = len(hashes) // step
    out = np.zeros((n + 1, 64), np.int32)
    if n:
        bits = np.unpackbits(hashes[: n * step].view(np.uint8)).reshape(n, step, 64)
        np.cumsum(bits.sum(axis=1, dtype=np.uint8) if step < 256 else bits.sum(axis=1), axis=0, out=out[1:])
    return out


def simhashes(counts: np.ndarray, size: int, step: int) -> np.ndarray:
    """The SimHash of each window of `size` words that starts at a step."""
    k = size // step
    if len(counts) <= k:
        return np.zeros(0, np.uint64)
    return np.packbits(2 * (counts[k:] - counts[:-k]) > size, axis=1).view(np.uint64).ravel()


class Items:
    """Index of a block of benchmark items. rows: (item_id, text); weights: of the block's shingles that several items
    of the whole benchmark have, counted here if the block is all of it."""

    def __init__(self, rows: list[tuple], weights: dict[int, float] | None = None) -> None:
        self.rows = []
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        short: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in rows:
            h = word_hashes(loose_words(text or ""))
            if not len(h):
                continue
            k, size, own = len(self.rows), window_size(len(h)), shingle_hashes(h, SHINGLE)
            self.rows.append((item_id, h, Counter(own.tolist())))
            if not size:
                short.setdefault(min(SHINGLE, len(h)), []).extend((int(x), k, at) for at, x in enumerate(own.tolist()))
                continue
            counts = bit_counts(h, 1)
            prints = np.packbits(2 * (counts[size:] - counts[:-size]) > size, axis=1).view(np.uint64).ravel()
            by_size.setdefault(size, []).extend((x, k, shift) for shift, x in enumerate(prints.tolist()))
        if weights is None:
            spread = Counter(s for _, _, c in self.rows for s in c)
            weights = {s: 1.0 / n for s, n in spread.items() if n > 1}
        self.weight = weights
        self.plans = {size: self._blocks(entries) for size, entries in by_size.items()}
        self.short = {}
        for width, entries in short.items():
            entries.sort()
            self.short[width] = (np.array([e[0] for e in entries], np.uint64), np.array([e[1] for e in entries]), np.array([e[2] for e in entries]))

    @staticmethod
    def _blocks(entries: list[tuple[int, int, int]]):
        values = np.array([e[0] for e in entries], np.uint64)
        near = np.array([0, *(1 << i for i in range(16))], np.uint16)
        tables = []
        for b in range(4):
            part = (values >> np.uint64(16 * b)).astype(np.uint16)
            keys = (part[:, None] ^ near).ravel()
            owner = np.repeat(np.arange(len(values), dtype=np.int32), len(near))
            order = np.argsort(keys, kind="stable").astype(np.int32)
            first = np.searchsorted(keys[order], np.arange(65537, dtype=np.uint32))
            tables.append((first, owner[order]))
        return values, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), tables

    def candidates(self, plan: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, shift) of every pair of fingerprints within RADIUS."""
        values, item, shift, tables = self.plans[plan]
        windows, entries = [], []
        for b, (first, owner) in enumerate(tables):
            part = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            lo, n = first[part], first[part + 1] - first[part]
            hit = np.flatnonzero(n)
            if len(hit):
                n = n[hit]
                windows.append(np.repeat(hit, n))
                entries.append(owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)])
        if not windows:
            return (np.zeros(0, np.int64),) * 3
        w, e = np.concatenate(windows), np.concatenate(entries)
        near = np.bitwise_count(prints[w] ^ values[e]) <= RADIUS
        pairs = np.unique(np.stack([w[near], e[near]]), axis=1)
        return pairs[0], item[pairs[1]], shift[pairs[1]]

    def short_candidates(self, parts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(document, item, first word of the window) of every short item that has a shingle at its place in the window."""
        if not self.short:
            return
        every = np.concatenate(parts)
        ends = np.cumsum([len(h) for h in parts])
        for width, (values, item, at) in self.short.items():
            if len(every) < width:
                continue
            own = shingle_hashes(every, width)
            lo = np.searchsorted(values, own, "left")
            where = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == own)
            docs = np.searchsorted(ends, where, "right")
            for p, d in zip(where.tolist(), docs.tolist(), strict=True):
                if p + width <= ends[d]:  # else it runs into the next document
                    place = p - int(ends[d]) + len(parts[d])
                    for e in range(lo[p], np.searchsorted(values, own[p], "right")):
                        yield d, int(item[e]), max(0, place - int(at[e]))

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Exact weighted Jaccard of the shingles (with repeats) of an item and a window of word hashes. A shingle weighs
        one by the number of items that have it."""
        a, b = self.rows[item][2], Counter(shingle_hashes(window, SHINGLE).tolist())
        weight = self.weight.get
        inner = sum(weight(s, 1.0) * min(n, b[s]) for s, n in a.items() if s in b)
        return inner / (sum(weight(s, 1.0) * n for s, n in a.items()) + sum(weight(s, 1.0) * n for s, n in b.items()) - inner)


def document_hits(items: Items, texts: list[str | None], threshold: float) -> list[dict[int, tuple[float, int]]]:
    """For each text: item -> (best similarity, first word of the window)."""
    out: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
    held: list[tuple[int, bytes]] = []
    n_held = 0

    def flush() -> None:
        whole = words_of_all([t for _, t in held])
        parts = [h[: len(h) // STEP * STEP] for h in whole]
        counts = bit_counts(np.concatenate(parts), STEP)
        firsts = np.cumsum([0, *(len(h) // STEP for h in parts)])
        found = set(items.short_candidates(whole))
        for size in items.plans:
            all_prints = simhashes(counts, size, STEP)
            n = [max(0, (len(h) - size) // STEP + 1) if len(h) >= size else 0 for h in parts]  # none crosses into the next document
            doc = np.repeat(np.arange(len(parts)), n)
            place = np.arange(len(doc)) - np.repeat(np.cumsum([0, *n[:-1]]), n)
            w, item, shift = items.candidates(size, all_prints[firsts[doc] + place])
            found.update(zip(doc[w].tolist(), item.tolist(), np.maximum(0, place[w] * STEP - shift).tolist(), strict=True))
        for d, i, lo in found:
            score, best = items.similarity(i, whole[d][lo : lo + len(items.rows[i][1])]), out[held[d][0]]
            if score >= threshold and (i not in best or (score, -lo) > (best[i][0], -best[i][1])):
                best[i] = (score, lo)
        held.clear()

    for i, text in enumerate(texts):
        if text:
            held.append((i, loose_words(text)))
            n_held += len(text)
            if n_held >= ROUND_BYTES:
                flush()
                n_held = 0
    if held:
        flush()
    return out


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text in b.column(1).to_pylist():
            found = np.unique(shingle_hashes(word_hashes(loose_words(text or "")), SHINGLE))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple], dict[int, float] | None]]:
    """The items in blocks of about `block_bytes`, with the weights of their common shingles; each block alone comes to
    the driver. Counts of shingles over all items are a stored table, of which a block gets what it has."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n == 1:
        yield sorted({tuple(r) for r in rows.collect()}, key=repr), None
        return
    rows = stored(rows.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    shingles = map_arrow(rows.select("item_id", "text"), _shingle_rows, "shingle long")
    spread = stored(shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "spread")
    for k in range(n):
        part = rows.where(F.col("block") == k).select("item_id", "text")
        own = map_arrow(part, _shingle_rows, "own long").distinct()
        weights = spread.join(own, F.col("shingle") == F.col("own"), "left_semi").collect()
        yield sorted((tuple(r) for r in part.collect()), key=repr), {r["shingle"] & (1 << 64) - 1: 1.0 / r["n"] for r in weights}


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """A row for each (document, item) whose best window reaches the threshold.

    Null and empty texts have no hits, nor do items without words. Items of one to four words count as
    one shingle. Repeated rows are each reported, repeated items once; equal windows go to the first. Extra columns,
    whatever their names, are ignored.
    """
    out = None
    for rows, weights in item_blocks(benchmark):
        hits = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _hit_rows(rows, weights, threshold), HIT_SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    return out


def _hit_rows(rows: list[tuple], weights: dict[int, float] | None, threshold: float):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, weights)
        for b in batches:
            docs = b.column(0).to_pylist()
            found = [(docs[d], items.rows[i][0], score, at, len(items.rows[i][1])) for d, of in enumerate(document_hits(items, b.column(1).to_pylist(), threshold)) for i, (score, at) in sorted(of.items())]
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "similarity", "word_start", "item_words"), f, strict=True)) for f in found], pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("word_start", pa.int64()), ("item_words", pa.int64())]))

    return hits


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, in which no item is found."""
    at = docs.columns.index("text")
    for rows, weights in item_blocks(benchmark):
        docs = map_arrow(docs, _clean_rows(rows, weights, threshold, at, docs.columns), docs.schema)
    return docs


def _clean_rows(rows: list[tuple], weights: dict[int, float] | None, threshold: float, at: int, names: list[str]):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, weights)
        for b in batches:
            clean = b.filter(pa.array([not hits for hits in document_hits(items, b.column(at).to_pylist(), threshold)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(clean.columns, names)

    return clean
