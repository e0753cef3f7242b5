"""Risk scores, reasons and masks over arrays of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.functions.hof import let
from guardlake.functions.text import token_for
from guardlake.schema import WEIGHTS


def weight(severity: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("float") for w in WEIGHTS]), severity.cast("int") + 1)


def contribution(f: Column) -> Column:
    """Weight times confidence in single precision, within 0 and 1; 0 if that is no number."""
    c = weight(f["severity"]) * f["confidence"]
    return F.when(F.isnan(c) | c.isNull(), F.lit(0).cast("float")).otherwise(F.greatest(F.least(c, F.lit(1).cast("float")), F.lit(0).cast("float")))


def risk_score(findings: Column) -> Column:
    """Noisy OR of the contributions, 0 to 100, multiplied in order and in single precision."""
    one = F.lit(1).cast("float")
    rest = F.aggregate(findings, one, lambda acc, f: (acc * (one - contribution(f)).cast("float")).cast("float"))
    return F.round(((one - rest) * F.lit(100).cast("float")).cast("float")).cast("int")


def top_reasons(findings: Column, n: int = 3) -> Column:
    """Labels of the n largest contributions; ties in order of appearance."""
    ranked = F.transform(findings, lambda f, i: F.struct((-contribution(f)).alias("c"), i.alias("i"), f["label"].alias("label")))
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda r: r["label"])


def dedupe(findings: Column) -> Column:
    """One finding for each (detector, severity), the most confident, the first among equals; in key order."""
    keyed = F.transform(findings, lambda f, i: F.struct(f["detector"].alias("d"), f["severity"].alias("s"), (-f["confidence"]).alias("c"), i.alias("i"), f.alias("f")))

    def first_of_key(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["d"] != x["d"]) | (F.get(s, i - 1)["s"] != x["s"]))

    order = F.array_sort(keyed, lambda a, b: _compare(a, b, ("d", "s", "c", "i")))
    return F.transform(let(order, first_of_key), lambda x: x["f"])


def _compare(a: Column, b: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for k in reversed(keys):
        out = F.when(a[k] < b[k], -1).when(a[k] > b[k], 1).otherwise(out)
    return out


def merge_passes(first: Column, second: Column) -> Column:
    """The second pass's findings without spans, if no earlier one has their detector and label, after the first's."""
    fields = ("detector", "severity", "confidence", "span_start", "span_end", "label", "owasp", "atlas")

    def bare(f: Column) -> Column:
        return F.struct(*[(F.lit(None).cast("int") if k.startswith("span") else f[k]).alias(k) for k in fields])

    def step(acc: Column, f: Column) -> Column:
        known = F.exists(acc, lambda g: (g["detector"] == f["detector"]) & (g["label"] == f["label"]))
        return F.when(known, acc).otherwise(F.array_append(acc, bare(f)))

    return F.aggregate(second, first, step)


def max_severity(findings: Column) -> Column:
    return F.array_max(F.transform(findings, lambda f: f["severity"]))


def mask(text: Column, findings: Column) -> Column:
    """The text with the findings' spans replaced by typed tokens: earlier starts first, of equal starts the
    longest, and what overlaps a span already taken is skipped."""
    raw = F.encode(text, "UTF-8")
    placed = F.filter(findings, lambda f: f["span_start"].isNotNull() & (f["span_start"] < f["span_end"]))
    ordered = F.array_sort(F.transform(placed, lambda f: F.struct(f["span_start"].alias("a"), (-f["span_end"]).alias("b"), f["detector"].alias("d"))))

    def build(b: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            piece = F.concat(acc["out"], F.substring(b, acc["at"] + 1, s["a"] - acc["at"]).cast("string"), token_for(s["d"]))
            ok = (s["a"] >= acc["at"]) & (-s["b"] <= F.octet_length(b))
            return F.when(ok, F.struct((-s["b"]).alias("at"), piece.alias("out"))).otherwise(acc)

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(b, acc["at"] + 1, F.octet_length(b)).cast("string")))

    return F.when(F.size(placed) == 0, text).otherwise(let(raw, build))
