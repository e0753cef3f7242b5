"""Labelled corpora: texts, agent sessions and judge samples in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.schema import PROVENANCE

_EVENT = f"kind string, tool string, args string, content string, source {PROVENANCE}, name string, instructions string, granted_tools array<string>, server string, tools array<struct<name:string,description:string,schema:string>>"


def read_labelled(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(text, label) of all files in turn; blank lines are skipped and a bad line fails the read."""
    return spark.read.schema("text string, label boolean").option("mode", "FAILFAST").json(paths)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each session: id, label, category, root_tools, events, note."""
    return spark.read.schema(f"id string, label string, category string, root_tools array<string>, events array<struct<{_EVENT.replace(' string', ':string').replace(' array', ':array').replace(' struct', ':struct')}>>, note string").option("mode", "FAILFAST").json(path)


def session_events(sessions: DataFrame) -> DataFrame:
    """The events of all sessions in the event shape: numbered from 1, of the agent `main`."""
    rows = sessions.select(F.col("id").alias("session"), F.posexplode("events").alias("pos", "e"))
    return rows.select("session", F.lit("main").alias("agent"), F.lit(None).cast("string").alias("parent"), (F.col("pos") + 1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("at_ms"), "e.*")


def read_judge_samples(spark: SparkSession, path: str) -> DataFrame:
    """(content, label, note); a label other than injection or documentation fails the query."""
    rows = spark.read.schema("content string, label string, note string").option("mode", "FAILFAST").json(path)
    bad = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null"))))
    return rows.withColumn("label", F.when(F.col("label").isin("injection", "documentation"), F.col("label")).otherwise(bad.cast("string")))


def write_features(scored: DataFrame, path: str) -> None:
    """label, cheap_score, cheap_block, ml_p of every example as JSON lines."""
    scored.select("label", F.col("score").alias("cheap_score"), (F.col("action") == "block").alias("cheap_block"), "ml_p").write.mode("overwrite").json(path)
