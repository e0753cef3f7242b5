"""What happens to a model's reply: output decision, agent verdict and moderation, in this order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.functions.hof import case

# Labels that never count as harm, and the ways a reply can go.
HARMLESS = ("safe", "ok")
FORWARD, REFUSED_OUTPUT, REFUSED_CALL, REFUSED_CONTENT = "forward", "output", "agent", "moderation"


def moderation_hits(scores: Column, threshold: float = 0.8, categories: tuple[str, ...] = ()) -> Column:
    """Sorted categories of a map of label to score that reach the threshold; with `categories`, of those alone. Labels of
    harmless texts never count, in whatever case."""

    def hit(label: Column, score: Column) -> Column:
        found = (score >= threshold) & ~F.lower(label).isin(*HARMLESS)
        return found & label.isin(*categories) if categories else found

    return F.array_sort(F.map_keys(F.map_filter(F.coalesce(scores, F.create_map().cast("map<string,double>")), hit)))


def withhold(verdict: Column, enforce: Column) -> Column:
    """Whether a manifest is replaced by an error: only when enforcing, and only for ask and deny."""
    return enforce & F.coalesce(verdict.isin("ask", "deny"), F.lit(False))


def output_refused(action: Column) -> Column:
    """A reply is refused by the text policy on a block alone: masking counts for requests."""
    return F.coalesce(action == "block", F.lit(False))


def reply_outcome(action: Column, verdict: Column, enforce: Column, hits: Column, blocks: Column, streamed: Column) -> Column:
    """The first reason to refuse: text policy, then a denied call under enforcement, then moderation that blocks. Streamed
    replies pass the agent and moderation steps by."""
    whole = ~streamed
    return case(
        [
            (output_refused(action), F.lit(REFUSED_OUTPUT)),
            (whole & enforce & (verdict == "deny"), F.lit(REFUSED_CALL)),
            (whole & blocks & (F.size(hits) > 0), F.lit(REFUSED_CONTENT)),
        ],
        F.lit(FORWARD),
    )
