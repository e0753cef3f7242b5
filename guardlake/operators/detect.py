"""Detectors: a text and its direction become an array of findings, all in the JVM.

`Detector` is the extension point: anything with a name and `findings(text, direction) -> Column`. Model
scores come in through `ModelDetector`, a pandas UDF around a scoring function that is loaded once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

from guardlake.functions.hof import all_of, let
from guardlake.functions.spans import SPAN, find_spans
from guardlake.functions.text import atlas, entropy, is_safe_label, luhn_valid, owasp
from guardlake.schema import FINDING, SEVERITIES

NO_FINDINGS = f"array<{FINDING}>"


class Detector(Protocol):
    name: str

    def findings(self, text: Column, direction: Column) -> Column: ...


@dataclass(frozen=True)
class Rule:
    """One pattern. gate: a further test of the match; first_only: report the first match alone. needs: groups of literals
    (lower case where the pattern ignores case), one of each of which is in every match: texts without are not searched."""

    detector: str
    pattern: str
    severity: str
    confidence: float
    label: str
    first_only: bool = False
    output_only: bool = False
    gate: str = ""
    needs: tuple[tuple[str, ...], ...] = ()
    digits: bool = False


# Patterns, severities and confidences of the rules.
INJECTION_RULES = (
    Rule("injection", r"(?i)ignore\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above)\s+instructions", "high", 0.9, "asks to ignore earlier instructions", needs=(("ignore",), ("instructions",))),
    Rule("injection", r"(?i)disregard\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above)", "high", 0.9, "asks to disregard what came before", needs=(("disregard",),)),
    Rule("injection", r"(?i)you\s+are\s+now\s+(?:in\s+)?(?:\bdan\b|developer\s+mode|do\s+anything\s+now)", "high", 0.9, "puts the model in another role", needs=(("you",), ("now",), ("dan", "developer", "anything"))),
    Rule("injection", r"(?i)(?:reveal|print|show|repeat)\s+(?:the\s+)?(?:your\s+)?(?:system\s+)?(?:prompt|instructions)", "medium", 0.9, "asks for the hidden prompt", needs=(("reveal", "print", "show", "repeat"), ("prompt", "instructions"))),
    Rule("injection", r"<\|im_(?:start|end)\|>", "medium", 0.9, "marks of a chat template", needs=(("<|im_",),)),
)
PII_RULES = (
    Rule("pii.email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "medium", 0.9, "e-mail", needs=(("@",),)),
    Rule("pii.ssn", r"\b\d{3}-\d{2}-\d{4}\b", "high", 0.9, "social security number", needs=(("-",),), digits=True),
    Rule("pii.ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "low", 0.9, "network address", needs=((".",),), digits=True),
    Rule("pii.credit_card", r"\b(?:\d[ -]?){13,19}\b", "high", 0.9, "payment card", gate="luhn", digits=True),
)
OUTPUT_RULES = tuple(
    Rule(f"output.{d}", p, s, c, label, first_only=True, output_only=True, needs=needs)
    for d, p, s, c, label, needs in (
        ("shell.rm_rf", r"(?i)\brm\s+-\w*[rf]\w*[rf]\w*", "critical", 0.9, "command that deletes a tree", (("rm",), ("-",))),
        ("shell.fork_bomb", r":\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:", "critical", 0.95, "function that forks without end", ((":()",),)),
        ("shell.pipe_exec", r"(?i)\b(?:curl|wget)\b[^\n|]*\|\s*(?:sudo\s+)?(?:ba)?sh\b", "critical", 0.9, "download run by a shell", (("curl", "wget"), ("|",), ("sh",))),
        ("shell.disk", r"(?i)(?:\bdd\s+if=|\bmkfs(?:\.\w+)?\b|>\s*/dev/sd[a-z])", "critical", 0.85, "command that overwrites a disk", (("if=", "mkfs", "/dev/sd"),)),
        ("shell.power", r"(?i)\b(?:shutdown|reboot|halt|poweroff)\b", "high", 0.7, "command that stops the machine", (("shutdown", "reboot", "halt", "poweroff"),)),
        ("html.script", r"(?i)<\s*script\b", "high", 0.85, "script element", (("<",), ("script",))),
        ("html.iframe", r"(?i)<\s*iframe\b", "medium", 0.75, "frame element", (("<",), ("iframe",))),
        ("html.js_uri", r"(?i)javascript:", "medium", 0.7, "script address", (("javascript:",),)),
        ("html.event_handler", r"(?i)\bon(?:error|load|click|mouseover)\s*=", "medium", 0.7, "handler attribute", (("onerror", "onload", "onclick", "onmouseover"),)),
        ("exfil.markdown_image", r"(?i)!\[[^\]]*\]\(\s*https?://[^)\s]+\?[^)\s]*=[^)\s]*\)", "high", 0.85, "image that sends data when shown", (("![",), ("http",), ("?",))),
    )
)
#: Our own choice.
ENTROPY_GATE = 3.5
SECRET_RULES = (
    Rule("secret.aws_key", r"\bAKIA[0-9A-Z]{16}\b", "critical", 0.95, "AWS access key", needs=(("AKIA",),)),
    Rule("secret.github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "critical", 0.95, "GitHub token", needs=(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),)),
    Rule("secret.slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "critical", 0.95, "Slack token", needs=(("xox",),)),
    Rule("secret.jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "high", 0.9, "JSON web token", needs=(("eyJ",),)),
    Rule("secret.private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "critical", 0.95, "private key header", needs=(("PRIVATE KEY-----",),)),
    Rule("secret.generic", r"[A-Za-z0-9+/_-]{24,}", "low", 0.5, "high-entropy string", gate="entropy"),
)
# What the heuristics count.
IMPERATIVES = r"(?i)\b(?:ignore|disregard|override|bypass|forget|reveal|pretend|act\s+as)\b"
#: The start of a run of 24 token characters; looking back keeps the search from starting anew at each of them.
TOKEN_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}"
IMPERATIVE_STEMS = ("ignore", "disregard", "override", "bypass", "forget", "reveal", "pretend", "act")
LONG_BASE64 = r"[A-Za-z0-9+/]{40,}={0,2}"
DELIMITERS = ("```", "###", "---", "<|")


#: Letters that ignoring case takes for ASCII ones although lower() does not.
_CASE_TWINS = {"ſ": "s", "ı": "i", "İ": "i", "K": "k"}


def folded(text: Column) -> Column:
    """Lower case, so that a literal is in it wherever a pattern that ignores case has it."""
    plain = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), _CASE_TWINS.items(), text)
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(plain))


@dataclass(frozen=True)
class View:
    """A text and what several rules ask of it, taken once: its folded form, whether it has a digit, and whether it has a
    run of 24 token characters."""

    text: Column
    low: Column
    digit: Column
    run: Column

    @staticmethod
    def fields(text: Column) -> Column:
        return F.struct(text.alias("text"), folded(text).alias("low"), text.rlike(r"(?U)\d").alias("digit"), text.rlike(TOKEN_RUN).alias("run"))

    @staticmethod
    def of(struct: Column) -> View:
        return View(struct["text"], struct["low"], struct["digit"], struct["run"])


def may_match(rule: Rule, view: View) -> Column:
    """Whether the text has what every match of the rule has: plain substring searches, far cheaper than the pattern."""
    where = view.low if rule.pattern.startswith("(?i)") else view.text
    groups = [view.digit] if rule.digits else [view.run] if rule.gate == "entropy" else []
    return all_of([*groups, *[reduce(Column.__or__, [F.contains(where, F.lit(x)) for x in group]) for group in rule.needs]])


def java_pattern(pattern: str) -> str:
    """The pattern under Unicode rules for classes, boundaries and case."""
    return pattern.replace("(?i)", "(?iU)", 1) if pattern.startswith("(?i)") else f"(?U){pattern}"


def _finding(detector: str, severity: Column, confidence: Column, start: Column, end: Column, label: Column) -> Column:
    d = F.lit(detector)
    return F.struct(
        d.alias("detector"), severity.cast("tinyint").alias("severity"), confidence.cast("float").alias("confidence"), start.cast("int").alias("span_start"), end.cast("int").alias("span_end"),
        label.alias("label"), owasp(d).alias("owasp"), atlas(d).alias("atlas"),
    )


@dataclass(frozen=True)
class RuleDetector:
    """All matches of a list of rules, in rule order."""

    name: str
    rules: tuple[Rule, ...]

    def _of(self, rule: Rule, view: View, direction: Column) -> Column:
        spans = F.when(may_match(rule, view), find_spans(view.text, java_pattern(rule.pattern))).otherwise(F.array().cast(f"array<{SPAN}>"))
        if rule.gate == "luhn":
            spans = F.filter(spans, lambda s: luhn_valid(s["match"]))
        elif rule.gate == "entropy":
            spans = F.filter(spans, lambda s: entropy(s["match"]) >= ENTROPY_GATE)
        if rule.first_only:
            spans = F.slice(spans, 1, 1)
        level = F.lit(SEVERITIES.index(rule.severity))
        found = F.transform(spans, lambda s: _finding(rule.detector, level, F.lit(rule.confidence), s["start"], s["end"], F.lit(rule.label)))
        if rule.output_only:
            found = F.when(direction == "output", found).otherwise(F.array().cast(NO_FINDINGS))
        return F.coalesce(found, F.array().cast(NO_FINDINGS))

    def seen(self, view: View, direction: Column) -> Column:
        return F.concat(*[self._of(r, view, direction) for r in self.rules])

    def findings(self, text: Column, direction: Column) -> Column:
        return let(View.fields(text), lambda v: self.seen(View.of(v), direction))


def heuristic_score(view: View) -> Column:
    """0 to 1, in single precision: imperatives, a long base64 run, smuggling delimiters."""
    text = view.text

    def times(weight: float, n: Column) -> Column:
        return F.lit(weight).cast("float") * F.least(n, F.lit(3)).cast("float")

    def count(mark: str) -> Column:
        n = ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")
        return F.when(F.contains(text, F.lit(mark)), n).otherwise(0)

    marks = sum((count(m) for m in DELIMITERS[1:]), count(DELIMITERS[0]))
    run = F.when(view.run & text.rlike(LONG_BASE64), F.lit(0.3).cast("float")).otherwise(F.lit(0).cast("float"))
    orders = reduce(Column.__or__, [F.contains(view.low, F.lit(x)) for x in IMPERATIVE_STEMS])
    said = F.when(orders, F.regexp_count(text, F.lit(java_pattern(IMPERATIVES)))).otherwise(0)
    total = (times(0.3, said) + run).cast("float") + times(0.1, marks)
    return F.least(total.cast("float"), F.lit(1.0).cast("float"))


@dataclass(frozen=True)
class HeuristicDetector:
    """One aggregate finding without a span from 0.30 on."""

    name: str = "injection"

    def findings(self, text: Column, direction: Column) -> Column:
        return let(View.fields(text), lambda v: self.seen(View.of(v), direction))

    def seen(self, view: View, direction: Column) -> Column:
        floor, medium, high = (F.lit(x).cast("float") for x in (0.3, 0.5, 0.75))

        def of(score: Column) -> Column:
            level = F.when(score >= high, 3).when(score >= medium, 2).otherwise(1)
            label = F.format_string("heuristic injection signals (score %.2f)", score)
            none = F.lit(None)
            return F.when(score >= floor, F.array(_finding("injection", level, score, none, none, label))).otherwise(F.array().cast(NO_FINDINGS))

        return F.coalesce(let(heuristic_score(view), of), F.array().cast(NO_FINDINGS))


INJECTION = RuleDetector("injection", INJECTION_RULES)
HEURISTICS = HeuristicDetector()
PII = RuleDetector("pii", PII_RULES)
OUTPUT = RuleDetector("output", OUTPUT_RULES)
SECRET = RuleDetector("secret", SECRET_RULES)
#: The order findings come in.
DEFAULT: tuple[Detector, ...] = (INJECTION, HEURISTICS, PII, SECRET, OUTPUT)


def detect(text: Column, direction: Column, detectors: tuple[Detector, ...] = DEFAULT) -> Column:
    """Findings of all detectors, in order; a null text has none."""

    def every(struct: Column) -> Column:
        view = View.of(struct)
        return F.concat(*[d.seen(view, direction) if hasattr(d, "seen") else d.findings(view.text, direction) for d in detectors])

    return let(View.fields(F.coalesce(text, F.lit(""))), every)


Score = Callable[[list[str]], list[dict[str, float]]]


def model_scores(load: Callable[[], Score]):
    """A pandas UDF text -> map of label to score; `load` runs once per worker task and gives the scorer."""

    @F.pandas_udf(MapType(StringType(), DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for texts in batches:
            yield pd.Series(scorer(texts.fillna("").tolist()))

    return score


def needs_model(findings: Column) -> Column:
    """No rule found anything high yet: only then the slow model is asked."""
    return ~F.exists(findings, lambda f: f["severity"] >= SEVERITIES.index("high"))


def injection_model_findings(p: Column, threshold: float = 0.5) -> Column:
    """The finding of an injection classifier's probability."""
    level = F.when(p >= 0.85, 3).otherwise(2)
    return F.when(p >= threshold, F.array(_finding("injection.ml", level, p, F.lit(None), F.lit(None), F.lit("model-detected injection")))).otherwise(F.array().cast(NO_FINDINGS))


def moderation_findings(scores: Column, threshold: float = 0.8) -> Column:
    """The one top label that is not a safe one, if it reaches the threshold."""
    worst = F.array_sort(F.filter(F.map_entries(scores), lambda e: ~is_safe_label(e["key"])), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))

    def of(top: Column) -> Column:
        detector = F.concat(F.lit("moderation."), F.lower(top["key"]))
        level = F.when(top["value"] >= 0.85, 3).otherwise(2).cast("tinyint")
        none_int, none = F.lit(None).cast("int"), F.lit(None).cast("string")
        return F.struct(detector.alias("detector"), level.alias("severity"), top["value"].cast("float").alias("confidence"), none_int.alias("span_start"), none_int.alias("span_end"), top["key"].alias("label"), none.alias("owasp"), none.alias("atlas"))

    return F.coalesce(F.transform(F.filter(F.slice(worst, 1, 1), lambda e: e["value"] >= threshold), of), F.array().cast(NO_FINDINGS))


def cascade(texts: DataFrame, probability, threshold: float = 0.5) -> DataFrame:
    """Adds a model's findings to `findings` of the rows that need the model; the others never reach Python."""
    asked = texts.where(needs_model(F.col("findings")))
    scored = asked.withColumn("findings", F.concat("findings", injection_model_findings(probability(F.col("text")), threshold)))
    return scored.unionByName(texts.where(~needs_model(F.col("findings"))))
