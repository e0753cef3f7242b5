"""MinHash near-dedup with sequential Bayesian verification.

1. Every document gets its set of word shingles (64-bit hashes), the set's 128-bit digest, a MinHash
   signature in bands and a sketch of one-bit MinHashes. Documents with equal sets form one class, and only
   one representative of a class goes on, under the number of its row: a missing or repeated doc_id plays no part.
2. Representatives that share a band are candidates; their sets are stored. For members of big bands it is counted how
   many of their shingles no other such member has (linear: one aggregate over shingles). Every representative is
   paired with one lead of its bands, the one with the fewest shingles of its own, which joins large groups of copies
   without forming their pairs; the exact size of what it shares with the lead is kept.
3. A pair's sketches are compared batch by batch; it is dropped as soon as the posterior probability of
   reaching the threshold falls below MISS. It is also dropped where exact bounds exclude it: what the two can share is
   at most what neither lacks of a common lead's set, and what both have beside it; what each lacks and has beside is
   known as a bit map of hash buckets. Survivors are verified exactly on their whole sets.
4. Components of verified links. Where a band still holds several components, each member outside the component of
   the band's lead is compared with the members of the others, by the same tests inside the join, on sketches and
   counts alone; sets are fetched for survivors. Nothing is capped; components are then final.

Only lost: links that share no band (for the default 48 bands of 8: below 3e-7 at the threshold) and links that the
posterior bound drops.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import free_names, map_arrow, rekeyed, shingle_hashes, stored, word_hashes

SHINGLE, PERCENT = 5, 80
SKETCH_LONGS = 4
#: Posterior probability of similarity at the threshold below which a pair is dropped.
MISS = 1e-6
#: Bands with more members count as big: their members' own shingles are counted before any pair is formed.
BIG = 32
#: Rows (some 24 bytes each) up to which a counted set of keys is broadcast.
BROADCAST_ROWS = 500_000
#: Stand-in for a null doc_id in join keys.
NO_ID = -(1 << 63)
#: Shingle hashes that one batch of sets holds.
BATCH_HASHES = 1 << 18
#: Longs of a bit map of hash buckets.
MAP_LONGS = 4
MAPS = [f"{p}{j}" for p in "mb" for j in range(MAP_LONGS)]
SKETCH = [f"k{j}" for j in range(SKETCH_LONGS)]


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold shares no band with a probability below 1e-6."""
    s = percent / 100
    rows = 8 if percent >= 85 else 6 if percent >= 75 else 4
    bands = 8
    while (1 - s**rows) ** bands >= 3e-7:
        bands += 8
    return bands, rows


@lru_cache(4)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7_041_776)
    return (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, np.uint32)[:, None]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of a set of 64-bit hashes (not empty)."""
    a, b = _multipliers(n)
    h = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, h.shape[1], 512):
        np.minimum(out, (a * h[:, at : at + 512] + b).min(axis=1), out=out)
    return out


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of ASCII-lower-cased words; fewer words than k are one shingle."""
    return np.unique(shingle_hashes(word_hashes(text.lower()), k))


def _signature_rows(k: int, bands: int, rows: int):
    n = max(bands * rows, 64 * SKETCH_LONGS)
    salt = (np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(2).to_pylist()
            sizes, s1, s2 = [], [], []
            keys = np.zeros((len(texts), bands), np.int64)
            sketch = np.zeros((len(texts), SKETCH_LONGS), np.int64)
            for i, text in enumerate(texts):
                found = shingle_set(text, k) if text else np.zeros(0, np.uint64)
                sizes.append(len(found))
                if not len(found):
                    s1.append(0)
                    s2.append(0)
                    continue
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                s1.append(int(digest[0]))
                s2.append(int(digest[1]))
                sig = signature(found, n)
                parts = sig[: bands * rows].reshape(bands, rows)
                keys[i] = [xxhash.xxh3_64_intdigest(p.tobytes()) - (1 << 63) for p in parts] ^ salt
                bits = (sig[: 64 * SKETCH_LONGS] * np.uint32(0x9E3779B1)) >> np.uint32(31)
                sketch[i] = np.packbits(bits.astype(np.uint8)).view(np.int64)
            empty = np.array(sizes) == 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]), pa.int32())
            numbers = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            columns = [numbers, b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys[~empty].ravel()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(sketch[:, j]) for j in range(SKETCH_LONGS))], ["row", "doc", "tag", "n", "s1", "s2", "bands", *SKETCH])

    return sign


@lru_cache(8)
def most_different(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """For 64, 128, ... sketch bits: the most that may differ before the pair is dropped.

    One bit agrees with probability (1 + s) / 2 at similarity s; s has a uniform prior.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    agree, differ = np.log((1 + s) / 2), np.log((1 - s) / 2)
    out = []
    for bits in range(64, 64 * SKETCH_LONGS + 1, 64):
        for d in range(bits + 1):
            weight = (bits - d) * agree + d * differ
            weight = np.exp(weight - weight.max())
            if weight[s >= percent / 100].sum() < miss * weight.sum():
                break
        out.append(d - 1)
    return tuple(out)


def _plausible(a: str, b: str, percent: int) -> Column:
    """The sequential test of the pair of aliased rows of `data`, and the exact bounds: what one has alone is in no other
    set, and what both have is in their lead's set or beside it."""
    differ = [F.bit_count(F.col(f"{a}.k{j}").bitwiseXOR(F.col(f"{b}.k{j}"))) for j in range(SKETCH_LONGS)]
    tests = [reduce(Column.__add__, differ[: j + 1]) <= most for j, most in enumerate(most_different(percent))]
    counted = (F.col(f"{a}.own") >= 0) & (F.col(f"{b}.own") >= 0)

    def shared(x: str) -> Column:
        return F.col(f"{x}.n") - F.when(counted, F.col(f"{x}.own")).otherwise(0)

    def ones(prefix: str, a: str, b: str, but: bool) -> Column:
        """Buckets of the bit maps of both (or of a's but b's): there is a shingle at least in each."""
        words = [(F.col(f"{a}.{prefix}{j}"), F.col(f"{b}.{prefix}{j}")) for j in range(MAP_LONGS)]
        return reduce(Column.__add__, [F.bit_count(x.bitwiseAND(F.bitwise_not(y)) if but else x.bitwiseOR(y)) for x, y in words])

    def beside(x: str, y: str) -> Column:
        alone = F.greatest(F.when(counted, F.col(f"{x}.own")).otherwise(0), ones("b", x, y, True))
        return F.col(f"{x}.n") - F.col(f"{x}.inner") - F.least(alone, F.col(f"{x}.n") - F.col(f"{x}.inner"))

    inside = F.least(F.col(f"{a}.inner"), F.col(f"{b}.inner"), F.col(f"{a}.size") - ones("m", a, b, False))
    most = F.least(shared(a), shared(b))
    most = F.when(F.col(f"{a}.lead") == F.col(f"{b}.lead"), F.least(most, inside + F.least(beside(a, b), beside(b, a)))).otherwise(most)
    return reduce(Column.__and__, tests, most * 100 >= (F.col(f"{a}.n") + F.col(f"{b}.n") - most) * percent)


def _bit_map(hashes: Column, prefix: str) -> list[Column]:
    """A bit for each of 64 * MAP_LONGS buckets that a hash falls into, as longs named with the prefix."""

    def long(j: int) -> Column:
        own = F.filter(hashes, lambda h: F.pmod(F.shiftright(h, 6), F.lit(MAP_LONGS)) == j)
        return F.aggregate(own, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))))

    return [long(j).alias(f"{prefix}{j}") for j in range(MAP_LONGS)]


def _key(doc: str = "doc_id") -> Column:
    return F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(NO_ID))


def _tag(text: str = "text") -> Column:
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def _few(rows: DataFrame) -> DataFrame:
    """The stored rows, broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _set_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, sets, held = [], [], 0
            for rep, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = shingle_set(text or b"", k).view(np.int64)
                reps.append(rep)
                sets.append(found)
                held += len(found)
                if held >= BATCH_HASHES:
                    yield _set_batch(reps, sets)
                    reps, sets, held = [], [], 0
            if reps:
                yield _set_batch(reps, sets)

    return rows


def _set_batch(reps: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["rep", "hashes"])


def _sets_of(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(rep, hashes) of the wanted rows (rep, doc, tag, copies). Few of them are broadcast, so that other texts are never
    shuffled. Rows with equal doc_id and text hash have one text; any of them will do."""
    texts = docs.select(_key().alias("d"), _tag().alias("t"), F.col("text").cast("binary").alias("text"))
    ids = _few(stored(wanted.select("rep", F.coalesce("doc", F.lit(NO_ID)).alias("doc"), "tag"), "wanted"))
    found = texts.join(ids, (F.col("d") == F.col("doc")) & (F.col("t") == F.col("tag"))).select("rep", "text")
    sets = stored(map_arrow(found, _set_rows(k), "rep long, hashes array<long>"), "sets")
    many = _few(stored(wanted.where("copies > 1").select(rekeyed("rep").alias("rep_")), "many"))  # only these can have come twice
    again = stored(sets.join(many, F.col("rep") == F.col("rep_"), "left_semi").dropDuplicates(["rep"]), "sets")
    return sets.join(many, F.col("rep") == F.col("rep_"), "left_anti").unionByName(again)


def _measured(pairs: DataFrame, sets: DataFrame, maps: bool = False) -> DataFrame:
    """The pairs (u, v) with the sizes of their sets and of what they share, from whole sets; and, if asked for, bit maps
    of what v lacks of u's set and has beside it."""
    left = sets.select(rekeyed("rep").alias("u_"), F.col("hashes").alias("u_set"))
    right = sets.select(rekeyed("rep").alias("v_"), F.col("hashes").alias("v_set"))
    both = pairs.join(left, F.col("u") == F.col("u_")).join(right, F.col("v") == F.col("v_"))
    sizes = [F.size("u_set").alias("nu"), F.size("v_set").alias("nv"), F.size(F.array_intersect("u_set", "v_set")).cast("long").alias("inner")]
    if not maps:
        return both.select("u", "v", *sizes)
    apart = both.select("u", "v", *sizes, F.array_except("u_set", "v_set").alias("lacks"), F.array_except("v_set", "u_set").alias("beside"))
    return apart.select("u", "v", "nu", "nv", "inner", *_bit_map(F.col("lacks"), "m"), *_bit_map(F.col("beside"), "b"))


def _reaches(percent: int) -> Column:
    return (F.col("inner") > 0) & (F.col("inner") * 100 >= (F.col("nu") + F.col("nv") - F.col("inner")) * percent)


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over links (u, v), for every node that has one.

    Each round takes the smallest label among a node and its neighbours and then follows labels once more, so
    rounds grow as the logarithm of a component's diameter. Labels are a stored table; nothing is collected.
    """
    both = stored(links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links.select(F.col("v").alias("a"), F.col("u").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        of_b = labels.select(rekeyed("node").alias("n"), "comp")
        near = both.join(of_b, F.col("b") == F.col("n")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        lower = stored(lower, "labels")
        up = lower.select(rekeyed("node").alias("n"), F.col("comp").alias("up"))
        labels = stored(lower.join(up, F.col("comp") == F.col("n"), "left").select("node", "old", F.coalesce("up", "comp").alias("comp")), "labels")
        if labels.where("comp <> old").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: many links between two components are one link between their labels."""
    of = labels.select(rekeyed("node").alias("n"), "comp")
    ends = links.join(of, F.col("u") == F.col("n"), "left").select("v", F.coalesce("comp", "u").alias("cu"))
    ends = ends.join(of, F.col("v") == F.col("n"), "left").select("cu", F.coalesce("comp", "v").alias("cv")).where("cu <> cv")
    above = components(ends.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
    up = above.select(rekeyed("node").alias("n"), F.col("comp").alias("up"))
    old = labels.join(up, F.col("comp") == F.col("n"), "left").select("node", F.coalesce("up", "comp").alias("comp"))
    new = above.join(labels.select(rekeyed("node").alias("n")), F.col("node") == F.col("n"), "left_anti")
    return stored(old.unionByName(new), "labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with comp: their rep's component, itself if it has no link."""
    labels = labels.select(rekeyed("node").alias("node_"), "comp")
    return rows.join(labels, F.col("rep") == F.col("node_"), "left").select(*rows.columns, F.coalesce("comp", "rep").alias("comp"))


def _classified(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(row, doc, tag, n, comp, component_id) of every row; comp is the smallest row of its component, null without one."""
    bands, rows = banding(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), _tag().alias("tag"), F.col("text").cast("binary").alias("text"))
    schema = "row long, doc long, tag long, n long, s1 long, s2 long, bands array<long>, " + ", ".join(f"{k} long" for k in SKETCH)
    signed = stored(map_arrow(texts, _signature_rows(shingle, bands, rows), schema), "signed")
    classes = stored(signed.where("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("rep"), F.min("doc").alias("low"), F.count("*").alias("copies")), "classes")
    reps = stored(signed.join(classes.select(rekeyed("rep").alias("rep_"), "copies"), F.col("row") == F.col("rep_")).select("rep_", "doc", "tag", "n", *SKETCH, "bands", "copies").withColumnRenamed("rep_", "rep"), "reps")
    labels = _linked(reps, docs, shingle, percent)
    of = labels.select(rekeyed("node").alias("node_"), F.col("comp").alias("label"))
    placed = stored(classes.join(of, F.col("rep") == F.col("node_"), "left").select("s1", "s2", "low", F.coalesce("label", "rep").alias("comp")), "placed")
    lows = placed.groupBy("comp").agg(F.min("low").alias("component_id")).select(rekeyed("comp").alias("comp_"), "component_id")
    found = placed.join(lows, F.col("comp") == F.col("comp_")).select(rekeyed("s1").alias("c1"), rekeyed("s2").alias("c2"), "comp", "component_id")
    out = signed.select("row", "doc", "tag", "n", "s1", "s2").join(found, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") > 0), "left")
    return out.select("row", "doc", "tag", "n", "comp", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def _linked(reps: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, comp) of the representatives that have a link."""
    keyed = reps.select("rep", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select(rekeyed("band").alias("band_"), "members")
    members = stored(keyed.join(shared, F.col("band") == F.col("band_")).select("band", "rep", (F.col("members") > BIG).alias("big")), "members")
    inside = stored(members.groupBy("rep").agg(F.max("big").alias("big")), "inside")
    data = reps.drop("bands").join(inside.select(rekeyed("rep").alias("rep_"), "big"), F.col("rep") == F.col("rep_")).drop("rep_")
    data = stored(data.select("rep", "doc", "tag", "n", *SKETCH, "copies", "big"), "inside")
    sets = _sets_of(data, docs, shingle)
    own = stored(_own_shingles(data.where("big").select("rep"), sets), "own")
    ranked = members.join(own.select(rekeyed("rep").alias("rep_"), "own"), F.col("rep") == F.col("rep_"), "left").select("band", "rep", F.coalesce("own", F.lit(1 << 62)).alias("own"), "big")
    ranked = stored(ranked, "ranked")
    leads = ranked.groupBy("band").agg(F.min(F.struct("own", "rep")).alias("lead")).select(rekeyed("band").alias("band_"), "lead")
    members = stored(ranked.join(leads, F.col("band") == F.col("band_")).select("band", "rep", "lead"), "members")
    star = stored(members.groupBy("rep").agg(F.min("lead").alias("lead")).select("rep", F.col("lead.rep").alias("lead")), "leads")
    measured = stored(_measured(star.where("rep <> lead").select(F.col("lead").alias("u"), F.col("rep").alias("v")), sets, maps=True), "star")
    links = measured.where(_reaches(percent)).select("u", "v")
    labels = components(links)
    facts = star.join(measured.select(rekeyed("v").alias("v_"), "nu", "inner", *MAPS), F.col("rep") == F.col("v_"), "left").drop("v_")
    facts = facts.join(own.select(rekeyed("rep").alias("rep_"), "own"), F.col("rep") == F.col("rep_"), "left").select(rekeyed("rep").alias("r"), "lead", "nu", "inner", "own", *MAPS)
    data = data.join(facts, F.col("rep") == F.col("r")).select(
        "rep", "n", *SKETCH, F.coalesce("own", F.lit(-1)).alias("own"), "lead", F.coalesce("nu", "n").cast("long").alias("size"), F.coalesce("inner", "n").alias("inner"), *[F.coalesce(c, F.lit(0)).alias(c) for c in MAPS]
    )
    data = stored(data, "data")
    pairs = stored(_cross_pairs(_open_members(members.select("band", "rep", F.col("lead.rep").alias("lead")), labels), data, percent), "pairs")
    more = stored(_measured(pairs, sets).where(_reaches(percent)).select("u", "v"), "links")
    return labels if more.isEmpty() else _merged(labels, more)


def _own_shingles(reps: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, own): how many of its shingles no other of these documents has, which bounds the similarity of every
    pair among them (and of no other pair) from above."""
    rows = sets.join(_few(reps.select(rekeyed("rep").alias("rep_"))), F.col("rep") == F.col("rep_"), "left_semi").select("rep", F.explode("hashes").alias("shingle"))
    lone = rows.groupBy("shingle").agg(F.min("rep").alias("rep"), F.count("*").alias("n")).where("n = 1")
    counts = lone.groupBy("rep").agg(F.count("*").alias("own")).select(rekeyed("rep").alias("rep_"), "own")
    return reps.join(counts, F.col("rep") == F.col("rep_"), "left").select("rep", F.coalesce("own", F.lit(0)).alias("own"))


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, rep, comp, head) of bands that hold several components; head is the lead's component."""
    of = stored(_labelled(members, labels), "labelled")
    heads = of.where("rep = lead").select(rekeyed("band").alias("band_"), F.col("comp").alias("head"))
    several = of.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select(rekeyed("band").alias("open"))
    rows = of.join(several, F.col("band") == F.col("open"), "left_semi")
    return stored(rows.join(heads, F.col("band") == F.col("band_")).select("band", "rep", "comp", "head"), "open")


def _cross_pairs(rows: DataFrame, data: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (u < v) of different components that share an open band, but for pairs of a document and its lead,
    which are measured already."""
    rows = stored(rows.join(data.withColumn("rep_", rekeyed("rep")).drop("rep"), F.col("rep") == F.col("rep_")).drop("rep_"), "open")
    out, everyone = rows.where("comp <> head").alias("x"), rows.alias("y")
    once = (F.col("y.comp") == F.col("y.head")) | (F.col("x.rep") < F.col("y.rep"))
    new = (F.col("x.rep") != F.col("y.lead")) & (F.col("y.rep") != F.col("x.lead"))
    pairs = out.join(everyone, (F.col("x.band") == F.col("y.band")) & (F.col("x.comp") != F.col("y.comp")) & once & new & _plausible("x", "y", percent))
    return pairs.select(F.least("x.rep", "y.rep").alias("u"), F.greatest("x.rep", "y.rep").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles; words are
    ASCII-lower-cased and parted by ASCII white space. Fewer words than `shingle` are one shingle. Null, empty and
    blank texts have an empty set and are linked with nothing. component_id is the smallest doc_id
    reachable; kept says whether it is the document's own. Repeated rows get equal answers; rows with one doc_id and
    different texts are documents of their own. Documents without a doc_id are linked like any other; their component_id
    is null where none in reach has one. Extra columns, whatever their names, are ignored.
    """
    out = _classified(docs, shingle, percent)
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, one row of each component: the one with the smallest doc_id (null last), then by the
    hash of its text; of rows that are equal in both any one. Rows without words all stay."""
    out = stored(_classified(docs, shingle, percent).where("n > 0").select("row", "doc", "tag", "comp"), "classified")
    best = out.groupBy("comp").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "tag")).alias("best")).select(rekeyed("comp").alias("comp_"), "best")
    marked = out.join(best, F.col("comp") == F.col("comp_")).select(F.coalesce("doc", F.lit(NO_ID)).alias("doc"), "tag", (F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("tag") == F.col("best.tag"))).alias("stays"))
    keys = stored(marked.groupBy("doc", "tag").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "keys")
    doc, tag, d, t, stays = free_names(docs, "doc", "tag", "d", "t", "stays")
    keyed = docs.withColumns({doc: _key(), tag: _tag()})
    joined = keyed.join(_few(keys.select(rekeyed("doc").alias(d), rekeyed("tag").alias(t), F.col("stays").alias(stays))), (F.col(f"`{doc}`") == F.col(d)) & (F.col(f"`{tag}`") == F.col(t)), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = joined.where(F.col(stays)).dropDuplicates([doc, tag]).select(*names)
    return joined.where(F.col(stays).isNull()).select(*names).unionByName(once)


def oracle_sql(shingle: int, percent: int) -> str:
    """DuckDB: exact pairs by common shingles and their components, for small tables."""
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(shingle))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    sets as (select doc_id, case when len(w) = 0 then [] when len(w) < {shingle} then [array_to_string(w, ' ')]
                    else list_distinct(list_transform(range(1, len(w) - {shingle} + 2), lambda i: {run})) end as s from words),
    rows_ as (select doc_id, len(s)::bigint as n, unnest(s) as x from sets),
    common as (select a.doc_id as u, b.doc_id as v, any_value(a.n) as nu, any_value(b.n) as nv, count(*) as i from rows_ a join rows_ b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
    links as (select u, v from common where 100 * i >= {percent} * (nu + nv - i)),
    ways as (select u, v from links union all select v, u from links),
    reach as (select doc_id as u, doc_id as v from sets union select r.u, b.v from reach r join ways b on r.v = b.u),
    comp as (select u as doc_id, min(v) as component_id from reach group by 1)
    select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join comp using (doc_id)"""
