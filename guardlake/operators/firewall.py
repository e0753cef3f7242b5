"""The text pipeline: detect, detect again after normalising, score, decide, mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.functions.text import normalize
from guardlake.operators.detect import DEFAULT, Detector, detect
from guardlake.operators.score import mask, merge_passes, risk_score, top_reasons
from guardlake.plans.policy import Policy, compile_policy, shipped


def scan(texts: DataFrame, detectors: tuple[Detector, ...] = DEFAULT, dual: bool = False, decode: bool = False) -> DataFrame:
    """Adds `findings` to rows with `text` and `direction`. dual: a second pass over the normalised text, for rows
    whose text changes by it."""
    out = texts.withColumn("findings", detect(F.col("text"), F.col("direction"), detectors))
    if dual:
        out = out.withColumn("_normal", normalize(F.col("text"), decode=decode))
        again = F.when(F.col("_normal") != F.col("text"), detect(F.col("_normal"), F.col("direction"), detectors))
        out = out.withColumn("_again", again)
        out = out.withColumn("findings", F.when(F.col("_again").isNull(), F.col("findings")).otherwise(merge_passes(F.col("findings"), F.col("_again")))).drop("_normal", "_again")
    return out


def text_signals(score: Column) -> dict[str, Column]:
    return {"direction": F.col("direction"), "findings": F.col("findings"), "risk_score": score}


def firewall(texts: DataFrame, policy: Policy | None = None, detectors: tuple[Detector, ...] = DEFAULT, dual: bool = False) -> DataFrame:
    """Adds findings, score, reasons, action, rule, message and masked (the text after a mask decision, else null)."""
    found = scan(texts, detectors, dual).withColumn("score", risk_score(F.col("findings")))
    decided = found.withColumn("_d", compile_policy(policy or shipped("text"), text_signals(F.col("score"))))
    return decided.select(
        *texts.columns, "findings", "score", top_reasons(F.col("findings")).alias("reasons"), F.col("_d.action").alias("action"), F.col("_d.rule").alias("rule"), F.col("_d.message").alias("message"),
        F.when(F.col("_d.action") == "mask", mask(F.col("text"), F.col("findings"))).alias("masked"),
    )


def is_flagged(threshold: int = 50) -> Column:
    """What counts as predicted malicious: a block, or a score from the threshold on."""
    return (F.col("action") == "block") | (F.col("score") >= threshold)
