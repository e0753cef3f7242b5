"""Chat requests as segments: which message decides, and what was seen up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_block(segments: DataFrame, by: str = "request", order: str = "pos") -> DataFrame:
    """(by, blocked_at, rule): the first segment whose action is a block, if any."""
    hit = F.col("action") == "block"
    return segments.groupBy(by).agg(F.min(F.when(hit, F.col(order))).alias("blocked_at"), F.min_by("rule", F.when(hit, F.col(order))).alias("rule"))


def accumulate(segments: DataFrame, by: str = "request", order: str = "pos") -> DataFrame:
    """The worst segment's score and reasons, and the owasp and atlas categories in the order first seen, of the segments
    up to and with the first block. Of equal scores the earliest counts."""
    stop = first_block(segments, by, order).select(F.col(by).alias("_by"), "blocked_at")
    seen = segments.join(stop, F.col(by) == F.col("_by")).where(F.col("blocked_at").isNull() | (F.col(order) <= F.col("blocked_at")))
    found = seen.select(by, order, F.posexplode_outer("findings").alias("i", "f"))

    def tags(kind: str) -> DataFrame:
        first = found.groupBy(by, F.col(f"f.{kind}").alias("tag")).agg(F.min(F.struct(order, "i")).alias("first")).where("tag is not null")
        return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda t: t["tag"]).alias(kind))

    none = F.array().cast("array<string>")
    worst = seen.groupBy(by).agg(F.max_by(F.struct("score", "reasons"), F.struct(F.col("score"), -F.col(order))).alias("w"), F.min("blocked_at").alias("blocked_at"))
    tagged = worst.join(tags("owasp"), by, "left").join(tags("atlas"), by, "left")
    return tagged.select(by, "w.score", "w.reasons", F.coalesce("owasp", none).alias("owasp"), F.coalesce("atlas", none).alias("atlas"), "blocked_at")
