"""Line dedup by winnowing, in DataFrame functions only.

Every document is a sequence of line hashes (blank lines left out). Of every `min_run` consecutive
lines the rightmost smallest hash is selected, so any run of `min_run` lines that occurs twice has at
least one fingerprint in common wherever it stands; about half of the lines are selected. Fingerprints that occur once
in the corpus are dropped. The positions of the others are extended both ways: every window that selected the position is
keyed by the fingerprint and its lines left and right, and joined with the first position of that key.
Windows whose first position is elsewhere are later repeats. Those that follow each other in one document grow into
maximal runs, and all their lines go.

Runs of fewer lines that have `long_words` words (a paragraph on one line, say) are fingerprints of their own: each is
keyed whole and compared wherever it stands.

This deletes exactly the lines covered by some window or long run that already occurred before it in
the order of (doc_id, text hash, line): the SQL oracle says so without fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import free_names, rekeyed, stored

MIN_RUN = 3
#: Words that make a run of fewer lines count; None: such runs never count.
LONG_WORDS = 50


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _is_line(line: Column) -> Column:
    return F.trim(line) != ""


def _line_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "\n"), _is_line), lambda line: F.xxhash64(F.trim(line)))


def _take(values: Column, start: Column, n: int) -> Column:
    """n values from a 0-based place on, null beyond the end. Unlike slice(), this does not copy the whole array."""
    return F.array(*[F.get(values, start + j) for j in range(n)])


def _rightmost_min(window: Column) -> Column:
    """0-based place of the last smallest value."""
    return (F.size(window) - F.array_position(F.reverse(window), F.array_min(window))).cast("int")


def _anchors(hashes: Column, width: int) -> Column:
    """Selected positions: (at, fingerprint, low, around), where `around` has the lines of all windows that
    can hold the position and starts at line `low`."""

    def anchor(n: Column, h: Column, at: Column) -> Column:
        low = F.greatest(at - (width - 1), F.lit(0))
        high = F.least(at + (width - 1), n - 1)
        around = F.array_compact(F.array(*[F.when(low + j <= high, F.get(h, low + j)) for j in range(2 * width - 1)]))
        return F.struct(at.alias("at"), F.get(h, at).alias("fingerprint"), low.alias("low"), around.alias("around"))

    def of(h: Column) -> Column:
        n = F.size(h)
        starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
        places = F.array_distinct(F.transform(starts, lambda i: i + _rightmost_min(_take(h, i, width))))
        return F.when(n > 0, F.transform(places, lambda at: anchor(n, h, at)))

    return _let(hashes, of)


def _windows(at: Column, low: Column, around: Column, width: int) -> Column:
    """(line, key) of each window inside `around` that selected the position."""

    def of(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(a) - width, F.lit(0)))
        chosen = F.filter(starts, lambda j: j + _rightmost_min(_take(a, j, width)) == at - low)
        return F.transform(chosen, lambda j: F.struct((low + j).alias("line"), F.xxhash64(_take(a, j, width)).alias("key")))

    return _let(around, of)


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _tag() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, tag and text, with the tag taken before anything is exploded: beside an explode it would be hashed for each row."""
    return docs.select(_doc().alias("doc"), _tag().alias("tag"), F.col("text").cast("string").alias("text"))


def repeated_windows(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc, tag, line) of every window of `min_run` lines that occurred before.

    Selected positions and windows are tables of their own, so texts are split into lines once. Aggregates have keys
    that no join's partitioning serves: rows of a very common line are combined before they meet, and joins split them.
    """
    places = stored(_keyed(docs).select("doc", "tag", F.explode(_anchors(_line_hashes(F.col("text")), min_run)).alias("a")).select("doc", "tag", "a.*"), "anchors")
    twice = places.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select(rekeyed("fingerprint").alias("again"))
    shared = places.join(twice, places.fingerprint == twice.again, "left_semi")
    windows = shared.select("doc", "tag", "fingerprint", F.explode(_windows(F.col("at"), F.col("low"), F.col("around"), min_run)).alias("w")).select("doc", "tag", "fingerprint", "w.*")
    windows = stored(windows, "windows")
    first = windows.groupBy(rekeyed("fingerprint").alias("f"), rekeyed("key").alias("k")).agg(F.min(F.struct("doc", "tag", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(rekeyed("f").alias("f"), rekeyed("k").alias("k"), "first")
    later = windows.join(first, (F.col("fingerprint") == F.col("f")) & (F.col("key") == F.col("k"))).where(F.struct("doc", "tag", "line") != F.col("first"))
    return later.select("doc", "tag", "line")


def _long_runs(text: Column, min_run: int, long_words: int) -> Column:
    """(line, length, head, key) of each run of fewer than `min_run` lines with `long_words` words at least; head is its
    first line's hash."""
    lines = F.transform(F.filter(F.split(text, "\n"), _is_line), lambda line: F.struct(F.xxhash64(F.trim(line)).alias("hash"), F.regexp_count(line, F.lit(r"\S+")).alias("words")))

    def of(a: Column) -> Column:
        hashes, words = F.transform(a, lambda x: x["hash"]), F.transform(a, lambda x: x["words"])

        def runs(h: Column, w: Column, k: int) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), lambda i: F.size(h) - i >= k)
            long = F.filter(starts, lambda i: sum((F.get(w, i + j) for j in range(1, k)), F.get(w, i)) >= long_words)
            return F.transform(long, lambda i: F.struct(i.alias("line"), F.lit(k).alias("length"), F.get(h, i).alias("head"), F.xxhash64(_take(h, i, k)).alias("key")))

        return _let(hashes, lambda h: _let(words, lambda w: F.concat(*[runs(h, w, k) for k in range(1, min_run)])))

    return _let(lines, of)


def repeated_long_runs(docs: DataFrame, min_run: int = MIN_RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc, tag, line, length) of every run of fewer than `min_run` lines with `long_words` words that occurred before."""
    runs = _keyed(docs).select("doc", "tag", F.explode(_long_runs(F.col("text"), min_run, long_words)).alias("r")).select("doc", "tag", "r.*")
    runs = stored(runs, "runs")
    first = runs.groupBy("head", "key", "length").agg(F.min(F.struct("doc", "tag", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(rekeyed("head").alias("h"), rekeyed("key").alias("k"), F.col("length").alias("l"), "first")
    later = runs.join(first, (F.col("head") == F.col("h")) & (F.col("key") == F.col("k")) & (F.col("length") == F.col("l"))).where(F.struct("doc", "tag", "line") != F.col("first"))
    return later.select("doc", "tag", "line", "length")


def _without(lines: Column, runs: Column) -> Column:
    """The lines, joined, that no run covers; runs count non-blank lines. Linear in the lines."""

    def positions(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda line, i: F.when(_is_line(line), i)), lambda i: i.isNotNull())

    def kept(lines: Column, at: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["line"], r["line"] + r["length"] - 1))))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(gone, lambda k: F.get(at, k)))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return _let(lines, lambda whole: _let(positions(whole), lambda at: kept(whole, at)))


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """The documents, all columns, with later repeats of `min_run` or more consecutive lines, and of fewer lines with
    `long_words` words, deleted from `text`, and `n_lines` (non-blank lines before) and `n_removed` added.

    Lines are compared without surrounding blanks; blank lines separate nothing and stay. A document with
    fewer lines is one window of its own and is emptied where the same whole text came before. Null text stays
    null; empty text stays empty. Repeated rows (equal doc_id and text) stand in one place, so both keep
    what the first keeps. A null doc_id comes first. Extra columns may have any names but those added here, which
    replace them.
    """
    found = repeated_windows(docs, min_run).withColumn("length", F.lit(min_run))
    if long_words is not None and min_run > 1:
        found = found.unionByName(repeated_long_runs(docs, min_run, long_words))
    doc, tag, d, t, runs = free_names(docs, "doc", "tag", "d", "t", "runs")
    marks = found.groupBy("doc", "tag").agg(F.collect_set(F.struct("line", "length")).alias(runs)).select(rekeyed("doc").alias(d), rekeyed("tag").alias(t), runs)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    here = docs.select(*[F.col(f"`{c}`") for c in names], _doc().alias(doc), _tag().alias(tag))
    joined = here.join(marks, (F.col(doc) == F.col(d)) & (F.col(tag) == F.col(t)), "left")

    def count(text: Column) -> Column:
        return F.coalesce(F.size(F.filter(F.split(text, "\n"), _is_line)), F.lit(0)).cast("long")

    text = F.when(F.col(runs).isNull(), F.col("text")).otherwise(_without(F.split("text", "\n"), F.col(runs)))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names]
    left = joined.select(*columns, count(F.col("text")).alias("n_lines"))
    return left.withColumn("n_removed", F.col("n_lines") - count(F.col("text")))


def oracle_sql(min_run: int = MIN_RUN, long_words: int = LONG_WORDS) -> str:
    """DuckDB: the same result straight from windows of whole lines."""
    over = "over (partition by doc_id, tag order by idx)"
    ahead = ", ".join(f"lead(line, {i}) {over} as l{i}, coalesce(lead(words, {i}) {over}, 0) as w{i}" for i in range(1, min_run))
    keys = ", ".join(["line", *(f"l{i}" for i in range(1, min_run)), "case when n < %d then seq end" % min_run])
    longs, cover = [], ["late", *(f"coalesce(lag(late, {i}) {over}, false)" for i in range(1, min_run))]
    for k in range(1, min_run):
        is_long = f"(idx <= n - {k - 1} and {' + '.join(['words', *(f'w{i}' for i in range(1, k))])} >= {long_words})"
        longs.append(f"{is_long} and row_number() over (partition by {', '.join(['line', *(f'l{i}' for i in range(1, k)), is_long])} order by doc_id, idx) > 1 as late{k}")
        cover += [f"late{k}", *(f"coalesce(lag(late{k}, {i}) {over}, false)" for i in range(1, k))]
    return f"""
    with base as (select doc_id, text, hash(text) as tag, string_split(text, chr(10)) as parts from documents),
    raw as (select doc_id, tag, unnest(parts) as whole, generate_subscripts(parts, 1) as pos from base),
    lines as (select *, trim(whole) as line, len(regexp_extract_all(whole, '[^ \t\n\x0B\f\r]+')) as words, row_number() over (partition by doc_id, tag order by pos) as idx,
                     count(*) over (partition by doc_id, tag) as n from raw where trim(whole) <> ''),
    whole_docs as (select doc_id, tag, string_agg(trim(whole), chr(10) order by pos) as seq from raw where trim(whole) <> '' group by all),
    windows as (select l.*, w.seq, {ahead} from lines l join whole_docs w using (doc_id, tag)),
    starts as (select *, (n < {min_run} and idx = 1) or (n >= {min_run} and idx <= n - {min_run} + 1) as is_start from windows),
    marked as (select doc_id, tag, pos, idx, is_start and row_number() over (partition by {keys}, is_start order by doc_id, idx) > 1 as late, {", ".join(longs)} from starts),
    gone as (select doc_id, tag, pos, {" or ".join(cover)} as dead from marked),
    kept as (select r.doc_id, r.tag, string_agg(r.whole, chr(10) order by r.pos) filter (where not coalesce(g.dead, false)) as text,
                    count(*) filter (where trim(r.whole) <> '') as n_lines, count(*) filter (where coalesce(g.dead, false)) as n_removed
             from raw r left join gone g using (doc_id, tag, pos) group by all)
    select b.doc_id, case when b.text is null then null else coalesce(k.text, '') end as text,
           coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed
    from base b left join kept k on b.doc_id = k.doc_id and b.tag = k.tag"""
