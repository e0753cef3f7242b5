"""Whether untrusted content turns up again in later tool-call arguments.

Batch form: content and leaves are exploded to fingerprints and literals and joined on (session, epoch, key), so
state is a shuffle on the session's keys instead of a map in memory. A session's end starts a new epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.functions.fingerprints import MIN_HITS, fingerprints, literals
from guardlake.functions.hosts import trust

UNTRUSTED = 0


def with_epochs(events: DataFrame) -> DataFrame:
    """Adds epoch: how many ends of the session came before."""
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("epoch", F.coalesce(F.sum((F.col("kind") == "session_end").cast("int")).over(before), F.lit(0)))


def sources(events: DataFrame) -> DataFrame:
    """(session, epoch, seq, source, content) of untrusted content: results of low trust, and every report."""
    report = F.struct(F.lit("subagent").alias("origin"), F.lit(None).cast("string").alias("host"), F.col("name").alias("name"))
    source = F.when(F.col("kind") == "subagent_report", report).otherwise(F.col("source"))
    low = (F.col("kind") == "subagent_report") | ((F.col("kind") == "tool_result") & (trust(F.col("source.origin")) == UNTRUSTED))
    return events.where(low).select("session", "epoch", "seq", source.alias("source"), "content")


def earliest_marks(sources: DataFrame, key: Column) -> DataFrame:
    """For each key of the content, the earliest source in its session and epoch."""
    rows = sources.select("session", "epoch", "seq", "source", F.explode(key).alias("key"))
    return rows.groupBy("session", "epoch", "key").agg(F.min("seq").alias("mark_seq"), F.min_by("source", "seq").alias("source"))


def taint_marks(events: DataFrame) -> DataFrame:
    """(session, seq, source, mark_seq) of calls with tainted arguments; needs epoch and leaves.

    A leaf is tainted by three fingerprints or more that were seen before (of whatever sources; the earliest one
    marks it), or by one literal of an earlier source. The first tainted leaf of a call gives the mark.
    """
    calls = events.where("kind = 'tool_call'").select("session", "epoch", F.col("seq").alias("call_seq"), F.posexplode("leaves").alias("leaf", "text"))
    origin = sources(events)
    place = ["session", "epoch", "call_seq", "leaf"]
    prints = earliest_marks(origin, F.array_distinct(fingerprints(F.col("content"))))
    wanted = calls.select(*place, F.explode(F.array_distinct(fingerprints(F.col("text")))).alias("key"))
    by_print = (
        wanted.join(prints, ["session", "epoch", "key"]).where("mark_seq < call_seq").groupBy(*place)
        .agg(F.count("*").alias("hits"), F.min("mark_seq").alias("mark_seq"), F.min_by("source", "mark_seq").alias("source")).where(F.col("hits") >= MIN_HITS).drop("hits")
    )
    texts = earliest_marks(origin, F.array_distinct(literals(F.col("content"))))
    by_literal = (
        calls.join(texts, ["session", "epoch"]).where((F.col("mark_seq") < F.col("call_seq")) & F.contains(F.lower("text"), F.col("key")))
        .groupBy(*place).agg(F.min("mark_seq").alias("mark_seq"), F.min_by("source", "mark_seq").alias("source"))
    )
    marked = by_print.unionByName(by_literal).groupBy(*place).agg(F.min("mark_seq").alias("mark_seq"), F.min_by("source", "mark_seq").alias("source"))
    first = marked.groupBy("session", "call_seq").agg(F.min_by(F.struct("source", "mark_seq"), "leaf").alias("m"))
    return first.select("session", F.col("call_seq").alias("seq"), "m.source", "m.mark_seq")
