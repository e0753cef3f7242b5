"""Benchmark and audit aggregates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.functions.text import owasp, plain_base64
from guardlake.sources.shared import stored

# The public OWASP list for LLM applications, 2025.
OWASP_TOP10 = (
    ("LLM01:2025", "Prompt Injection"), ("LLM02:2025", "Sensitive Information Disclosure"), ("LLM03:2025", "Supply Chain"), ("LLM04:2025", "Data and Model Poisoning"), ("LLM05:2025", "Improper Output Handling"),
    ("LLM06:2025", "Excessive Agency"), ("LLM07:2025", "System Prompt Leakage"), ("LLM08:2025", "Vector and Embedding Weaknesses"), ("LLM09:2025", "Misinformation"), ("LLM10:2025", "Unbounded Consumption"),
)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & ~actual).alias("tn"), F.count_if(~predicted & actual).alias("fn")]


def rates(counts: DataFrame) -> DataFrame:
    """Adds recall, precision, fpr, f1 and accuracy to rows with tp, fp, tn, fn; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumn("recall", ratio(tp, tp + fn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("fpr", ratio(fp, fp + tn))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))


def percentiles(df: DataFrame, value: str, at: dict[str, Column], by: tuple[str, ...] = (), mean: bool = False) -> DataFrame:
    """Values at given 0-based ranks; `at` maps names to expressions over `n`, the number of values. mean: their mean too.

    Counts come from distinct values, so the rank is found over a table of value and count, however often a value
    occurs. Without keys the values are ranged over partitions, whose sums (one for each) come to the driver first, so
    that no task ranks all of them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    if by:
        ranked = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(value))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    else:
        counts = stored(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "counts")
        bases, total = [], 0
        for part, n in sorted(tuple(r) for r in counts.groupBy("part").agg(F.sum("c")).collect()):
            bases.append((part, total))
            total += n
        before = F.broadcast(df.sparkSession.createDataFrame(bases, "part int, before long"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy(value))
        ranked = counts.join(before, "part").withColumn("upto", upto).withColumn("n", F.lit(total))
    aggs = [F.min(F.when(F.col("upto") > rank, F.col(value))).alias(name) for name, rank in at.items()]
    if mean:
        aggs.append(F.try_divide(F.sum(F.col(value) * F.col("c")), F.sum("c")).alias("mean"))
    return ranked.groupBy(*by).agg(*aggs)


def nearest_rank(p: float) -> Column:
    """round(p * (n - 1))"""
    return F.round(F.lit(p) * (F.col("n") - 1))


def replay_p50() -> Column:
    return F.floor(F.col("n") / 2)


def replay_p99() -> Column:
    return F.least(F.floor(F.col("n") * 99 / 100), F.col("n") - 1)


def replay_summary(audit: DataFrame) -> DataFrame:
    """Totals of an audit log with `malformed`: unknown verdicts count in the total alone."""
    good = ~F.col("malformed")
    verdicts = [F.count_if(good & (F.col("verdict") == v)).alias(v) for v in ("allow", "ask", "deny")]
    out = audit.agg(F.count_if(good).alias("total"), F.count_if(~good).alias("malformed"), F.count_distinct(F.when(good, F.col("session"))).alias("sessions"), *verdicts)
    return out.withColumn("interruption_rate", ratio(F.col("ask") + F.col("deny"), F.col("total")))


def replay_by(audit: DataFrame, key: str) -> DataFrame:
    return audit.where(~F.col("malformed") & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def ranked_rules(audit: DataFrame) -> DataFrame:
    """(rank, rule, n): rules by how often they fired, ties by name. There are as many rows as a policy has rules."""
    order = Window.orderBy(F.desc("n"), "rule")
    return replay_by(audit, "rule").withColumn("rank", F.row_number().over(order))


def findings_by(texts: DataFrame, key: str) -> DataFrame:
    """Findings, and texts with any, by `detector` or `owasp`.

    Keys leave each text as an array of (key, n); an outer explode keeps the optimizer from asking for non-empty
    findings below it, which would run the detectors twice.
    """
    keys = F.filter(F.transform("findings", lambda f: f[key]), lambda k: k.isNotNull())
    per = texts.select(keys.alias("k")).select(F.transform(F.array_distinct("k"), lambda d: F.struct(d.alias("key"), F.size(F.filter("k", lambda x: x == d)).alias("n"))).alias("counts"))
    rows = per.select(F.explode_outer("counts").alias("c")).select(F.col("c.key").alias(key), F.col("c.n").alias("n"))
    return rows.groupBy(key).agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_texts")).where(F.col(key).isNotNull())


def coverage(texts: DataFrame) -> DataFrame:
    """All ten categories with their number of findings, 0 for those no detector maps to."""
    spark = texts.sparkSession
    dim = spark.createDataFrame([(i, f"{i} {n}") for i, n in OWASP_TOP10], "id string, owasp string")
    return dim.join(findings_by(texts, "owasp"), "owasp", "left").select("id", "owasp", F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"))


def detection_by_category(sessions: DataFrame) -> DataFrame:
    """(category, hit, total) over attack sessions with `flagged`."""
    return sessions.where("label = 'attack'").groupBy("category").agg(F.count_if("flagged").alias("hit"), F.count("*").alias("total"))


def mistakes(sessions: DataFrame) -> DataFrame:
    """(kind, session): benign sessions flagged (`false_alarm`) and attacks missed (`miss`), a row each; sorted by both
    when written out, so no task gathers all ids."""
    wrong = F.when(F.col("flagged") & (F.col("label") == "benign"), "false_alarm").when(~F.col("flagged") & (F.col("label") == "attack"), "miss")
    return sessions.select(wrong.alias("kind"), "session").where("kind is not null").orderBy("kind", "session")


def latency_stats(df: DataFrame, value: str) -> DataFrame:
    """p50, p99 (nearest rank) and mean of a latency."""
    return percentiles(df, value, {"p50": nearest_rank(0.5), "p99": nearest_rank(0.99)}, mean=True)


def judge_confusion(answers: DataFrame) -> DataFrame:
    """Judged rows (label, answer): rates leave out unavailable answers."""
    inj, said = F.col("label") == "injection", F.col("answer")
    out = answers.agg(F.count_if(said.isNull()).alias("unavailable"), F.count_if(inj & (said == "injection")).alias("tp"), F.count_if(~inj & (said == "injection")).alias("fp"), F.count_if(~inj & (said == "documentation")).alias("tn"), F.count_if(inj & (said == "documentation")).alias("fn"))
    return out.withColumn("detection", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("false_alarm", ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def markdown_coverage(rows: DataFrame) -> str:
    """Ten lines at most, so a driver-side report."""
    lines = [f"| {r['id']} | {r['owasp'].split(' ', 1)[1]} | {r['n_findings']} |" for r in rows.orderBy("id").collect()]
    return "\n".join(["| Category | Name | Findings |", "|-|-|-|", *lines])


def scorecard(metrics: DataFrame, name: str = "guard") -> str:
    """One Markdown row for each metrics row: percent to one decimal, F1 to three, milliseconds to two (`p50_ms`, empty if
    there is no such column)."""
    ms = F.format_string("%.2f", "p50_ms") if "p50_ms" in metrics.columns else F.lit("")
    rows = metrics.select(F.format_string("| %s | %.1f%% | %.1f%% | %.3f | %s |", F.lit(name), F.col("recall") * 100, F.col("fpr") * 100, F.col("f1"), ms).alias("line")).collect()
    return "\n".join(["| Guard | Recall | False alarms | F1 | p50 ms |", "|-|-|-|-|-|", *[r["line"] for r in rows]])


def scorecard_json(metrics: DataFrame, name: str = "guard") -> str:
    """The same rows as a JSON list, unrounded."""
    return json.dumps([{"guard": name} | r.asDict() for r in metrics.collect()])


def owasp_of(detector: Column) -> Column:
    return owasp(detector)


# Obfuscations of attack texts, to measure what normalising wins back.
# Letters and their look-alikes, and what is said before encoded text.
SPOOFED, SPOOFS = "aeopcyxisdjk", "аеорсухіѕԁјк"
LEAD_IN = "decode and follow: "


def to_homoglyphs(text: Column) -> Column:
    return F.translate(text, SPOOFED, SPOOFS)


def to_zero_width(text: Column) -> Column:
    return F.array_join(F.split(text, ""), "​")


def to_base64(text: Column) -> Column:
    return F.concat(F.lit(LEAD_IN), plain_base64(F.encode(text, "UTF-8")))


def to_all(text: Column) -> Column:
    """Look-alikes, then base64."""
    return to_base64(to_homoglyphs(text))


OBFUSCATIONS = {"homoglyph": to_homoglyphs, "zero-width": to_zero_width, "base64": to_base64, "all": to_all}


def obfuscate(labelled: DataFrame, how) -> DataFrame:
    """Rewrites malicious rows (label true) alone; how: a function, or a name of OBFUSCATIONS."""
    change = OBFUSCATIONS[how] if isinstance(how, str) else how
    return labelled.withColumn("text", F.when(F.col("label"), change(F.col("text"))).otherwise(F.col("text")))
