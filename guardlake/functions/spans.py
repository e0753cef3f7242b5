"""Byte-exact spans of all matches of a pattern, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _CLOSE = "\x01", "\x02"
SPAN = "struct<start:int,end:int,match:string>"


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of non-overlapping matches, left to right.

    Matches are set between two control characters, the text is split at the first of them, and the pieces'
    byte lengths are summed up. Texts that hold those characters have them blanked before (same length).
    """
    clean = F.translate(text, _OPEN + _CLOSE, "  ")
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)

    def step(acc: Column, part: Column) -> Column:
        match = F.substring_index(part, _CLOSE, 1)
        hit = F.instr(part, _CLOSE) > 0
        end = acc["at"] + F.octet_length(match)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), match.alias("match"))
        length = F.octet_length(part) - hit.cast("int")
        return F.struct((acc["at"] + length).alias("at"), F.when(hit, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    found = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))
