"""What a tool call does: leaves of its arguments, facets of an event, action class, sensitive paths."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from guardlake.schema import ACTION_CLASSES


def json_leaves(value: object) -> list[str]:
    """Non-empty strings of a JSON value, objects in sorted key order."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            if v:
                out.append(v)
        elif isinstance(v, list):
            stack.extend(reversed(v))
        elif isinstance(v, dict):
            stack.extend(v[k] for k in sorted(v, reverse=True))
    return out


def _leaves_of(text: str | None) -> list[str] | None:
    if text is None:
        return None
    try:
        return json_leaves(json.loads(text))
    except ValueError:
        return [text] if text else []


@F.pandas_udf(ArrayType(StringType()))
def _deep_leaves(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(_leaves_of)


def string_leaves(args: Column) -> Column:
    """The string leaves of JSON text; text that is no JSON is its own leaf. Nested values need a walk of unknown depth,
    which is the one thing here that goes through Arrow."""
    return _deep_leaves(args)


def args_text(leaves: Column) -> Column:
    """Leaves joined by blanks: patterns may span them."""
    return F.array_join(leaves, " ")


# Patterns of what a call does, by class.
DESTRUCTIVE = (
    r"\brm\s+(?:-[a-z]*\s+)*-[a-z]*[rf]", r"\bgit\s+push\b[^|;&\n]*--force", r"\bgit\s+reset\s+--hard", r"\bdrop\s+(?:table|database)\b",
    r"\btruncate\s+table\b", r"\bmkfs(?:\.[a-z0-9]+)?\b", r"\bdd\s+if=.*\bof=/dev/", r"\|\s*(?:sudo\s+)?(?:ba)?sh\b", r"\bshutdown\b", r"\breboot\b",
)
PRIVILEGE = (r"\bsudo\b", r"\bsu\s+-\b", r"\bchmod\b", r"\bchown\b", r"\bsetcap\b", r"\bvisudo\b")
NETWORK = (
    r"\bcurl\b[^|;&\n]*(?:--data|--data-\w+|--form|--upload-file|-X\s*(?:POST|PUT|PATCH|DELETE)|(?-i:-d\b|-F\b|-T\b))",
    r"\bwget\b[^|;&\n]*(?:--post-data|--post-file|--method\s*=\s*(?:POST|PUT))",
    r"(?:^|[|;\n]|&&)\s*(?:sudo\s+)?(?:nc|ncat)\b", r"\bscp\b", r"\brsync\b", r"\bgit\s+push\b", r"\b(?:npm|pip|pip3|cargo|gem|go)\s+publish\b",
    r"\baws\s+s3\s+(?:cp|sync|mv)\b", r"\bgh\s+(?:gist\s+create|issue\s+comment|pr\s+create|release\s+upload|api\b[^|;&\n]*-(?:f|-field|-input))",
    r"\baws\s+s3api\s+put-object\b", r"\b(?:xh|https?ie|http)\s+(?:POST|PUT|PATCH)\b", r">\s*/dev/tcp/", r"\bssh\b[^|;&\n]*<",
)
WRITE = (r"\bmkdir\b", r"\btouch\b", r"\bmv\b", r"\bcp\b", r"\btee\b", r"\bsed\s+-i\b", r">{1,2}\s*\S", r"\brm\b", r"\bgit\s+(?:commit|add|checkout|merge|rebase)\b")
SENSITIVE = (r"/\.ssh/", r"/\.aws/", r"/\.gnupg/", r"/etc/(?:passwd|shadow|sudoers)", r"\.env(?:\.|\z)", r"/\.npmrc", r"/\.netrc", r"authorized_keys", r"id_rsa", r"credentials")
# Tools that only read; a shell call counts by its command alone.
READ_ONLY_TOOLS = ("Read", "Grep", "Glob", "NotebookRead", "TodoRead", "WebFetch", "WebSearch", "Bash")


# What RE2 takes for boundaries and classes when it ignores case: ASCII alone, and the two letters that fold to ASCII ones.
_TWINS = {"s": r"\u017f", "k": r"\u212a"}
_RE2 = {
    r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]",
    r"\w": rf"[\w{''.join(_TWINS.values())}]", **{c: f"[{c}{twin}]" for c, twin in _TWINS.items()},
}


def re2_pattern(pattern: str) -> str:
    """What RE2, and so the SQL, matches by the pattern when it ignores case, for Java without its U flag."""

    def of(token: re.Match) -> str:
        t = token[0]
        if t[0] == "[" and t[1] != "^":
            return t[:-1] + "".join(twin for c, twin in _TWINS.items() if re.fullmatch(t, c, re.I)) + "]"
        return _RE2.get(t if t[0] == "\\" else t.lower(), t)

    return re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]|[ks]", of, pattern, flags=re.I)


def _any(text: Column, patterns: tuple[str, ...], re2: bool = False) -> Column:
    # Flags before the one with an r or f have neither: the same matches, but Java goes no deeper with each flag.
    pattern = "|".join(patterns).replace(r"(?:-[a-z]*\s+)*-", r"(?:-[a-eg-qs-z]*\s+)*+-")
    if not re2:
        return text.rlike("(?iUd)" + pattern)
    # All but ASCII and the two letters are alike to RE2: neither word nor space. So is a vertical tab, a space to Java.
    plain = F.regexp_replace(text, r"[^\x00-\x0A\x0C-\x7F]", "\x01")
    return F.when(text.rlike(f"[{''.join(_TWINS.values())}]"), text.rlike("(?id)" + re2_pattern(pattern))).otherwise(plain.rlike("(?id)" + pattern))


def touches_sensitive_path(text: Column, re2: bool = False) -> Column:
    return _any(text, SENSITIVE, re2)


def action_class(tool: Column, text: Column, re2: bool = False) -> Column:
    """Ordinal of the most severe class that matches. A sensitive path counts only for a call that acts.

    re2: boundaries, white space and case as in RE2, the SQL's engine: in "sudoñ" it finds the word "sudo", which Unicode rules do not.
    """
    base = F.when(tool.isin(*READ_ONLY_TOOLS), 0).otherwise(1)
    acting = F.greatest(base, F.when(_any(text, WRITE, re2), 1).otherwise(0), F.when(_any(text, NETWORK, re2), 2).otherwise(0))
    raised = F.when(_any(text, PRIVILEGE, re2) | ((acting >= 1) & touches_sensitive_path(text, re2)), 3).otherwise(0)
    return F.greatest(acting, raised, F.when(_any(text, DESTRUCTIVE, re2), 4).otherwise(0)).cast("tinyint")


def action_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ACTION_CLASSES)), ordinal.cast("int") + 1)


def with_leaves(events: DataFrame) -> DataFrame:
    """Adds `leaves`; only tool calls have any."""
    return events.withColumn("leaves", string_leaves(F.when(F.col("kind") == "tool_call", F.col("args"))))


def facets() -> Column:
    """array<struct<facet, text>> of an event with leaves: a row for each leaf of a call, one for a result, a
    spawn's instructions or a report, one for each tool of a manifest."""

    def one(name: str, text: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("facet"), F.coalesce(text, F.lit("")).alias("text")))

    kind = F.col("kind")
    return (
        F.when(kind == "tool_call", F.transform("leaves", lambda t: F.struct(F.lit("tool_args").alias("facet"), t.alias("text"))))
        .when(kind == "tool_result", one("tool_result", F.col("content")))
        .when(kind == "subagent_spawn", one("subagent_instructions", F.col("instructions")))
        .when(kind == "subagent_report", one("subagent_report", F.col("content")))
        .when(kind == "manifest_seen", F.transform("tools", lambda t: F.struct(F.lit("tool_description").alias("facet"), F.concat(t["name"], F.lit(": "), F.coalesce(t["description"], F.lit(""))).alias("text"))))
        .otherwise(F.array().cast("array<struct<facet:string,text:string>>"))
    )


def facet_direction(facet: Column) -> Column:
    return F.when(facet == "tool_args", "output").otherwise("input")
