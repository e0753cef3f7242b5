"""Scalar functions over texts, all JVM-side but NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from guardlake.functions.hof import let

# Characters that the invisible tier removes.
INVISIBLE = "".join(map(chr, [*range(0x200B, 0x200E), 0x2060, 0xFEFF, 0x00AD, 0x180E, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)]))
# Cyrillic and Greek letters, and the ASCII letters they pass for.
CONFUSABLE = "аеосрухкмтвніѕԁјԛѡАЕОРСТВНКМХοανρτυΑΒΕΖΗΙΚΜΝΟΡΤ"
PLAIN = "aeocpyxkmtbhisdjqwAEOPCTBHKMXoavptuABEZHIKMNOPT"


def entropy(s: Column) -> Column:
    """Shannon entropy in bits for each byte; 0 for an empty text. Bytes are read as hex pairs."""

    def of(pairs: Column) -> Column:
        n = F.size(pairs).cast("double")

        def part(p: Column) -> Column:
            share = F.size(F.filter(pairs, lambda x: x == p)) / n
            return share * F.log2(share)

        return F.aggregate(F.transform(F.array_distinct(pairs), part), F.lit(0.0), lambda a, x: a - x)

    return F.coalesce(let(F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("(..)"), 1), of), F.lit(0.0))


def luhn_valid(s: Column) -> Column:
    """13 to 19 ASCII digits, other characters ignored, that pass the mod-10 check."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def strip_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold_confusables(text: Column) -> Column:
    """NFKC, then look-alike letters to ASCII. Only texts that are not ASCII go to Python."""
    odd = F.when(~text.rlike(r"\A\p{ASCII}*\z"), text)
    return F.translate(F.coalesce(_nfkc(odd), text), CONFUSABLE, PLAIN)


def plain_base64(data: Column) -> Column:
    """Base64 without line breaks, whatever the session's setting for them."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def decode_segments(text: Column) -> Column:
    """What base64 runs of 20 characters or more hide, joined by blanks: strict, valid UTF-8 without control
    characters, eight bytes at least."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/]{20,}={0,2}"), 0)
    strict = F.filter(runs, lambda m: (F.length(m) % 4 == 0) & (plain_base64(F.try_to_binary(m, F.lit("base64"))) == m))
    plain = F.transform(strict, lambda m: F.try_validate_utf8(F.unbase64(m).cast("string")))
    return F.array_join(F.filter(plain, lambda t: (F.octet_length(t) >= 8) & ~t.rlike(r"[\p{Cc}&&[^\n\t]]")), " ")


def normalize(text: Column, strip: bool = True, fold: bool = True, decode: bool = False) -> Column:
    """The tiers in order; decoded segments are appended."""
    out = strip_invisible(text) if strip else text
    out = fold_confusables(out) if fold else out
    if decode:
        more = decode_segments(out)
        out = F.when(more != "", F.concat_ws(" ", out, more)).otherwise(out)
    return out


def detector_root(detector: Column) -> Column:
    return F.substring_index(detector, ".", 1)


def owasp(detector: Column) -> Column:
    # Category names of the public OWASP list for LLM applications, 2025.
    root = detector_root(detector)
    return (
        F.when(root == "injection", "LLM01:2025 Prompt Injection")
        .when(root.isin("secret", "pii"), "LLM02:2025 Sensitive Information Disclosure")
        .when(root == "output", "LLM05:2025 Improper Output Handling")
    )


def atlas(detector: Column) -> Column:
    # Technique ids of the public ATLAS matrix.
    root = detector_root(detector)
    return F.when(root == "injection", "AML.T0051").when(root.isin("secret", "pii"), "AML.T0057")


def token_for(detector: Column) -> Column:
    return F.concat(F.lit("‹"), F.upper(F.substring_index(detector, ".", -1)), F.lit("›"))


def canonicalize(text: Column) -> Column:
    """Lower case, white space runs to one blank, trimmed: what fingerprints are taken of."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` bytes that ends between characters."""
    raw = F.encode(text, "UTF-8")

    def cut(b: Column) -> Column:
        # a byte 10xxxxxx right after the cut means a character is split: step back over such bytes
        split_at = F.filter(F.array(*[F.lit(i) for i in range(4)]), lambda i: ~F.hex(F.substring(b, F.lit(most + 1) - i, F.lit(1))).rlike("^[89AB]"))
        return F.substring(b, F.lit(1), F.lit(most) - F.coalesce(split_at[0], F.lit(0))).cast("string")

    return F.when(F.octet_length(text) <= most, text).otherwise(let(raw, cut))


# Labels that moderation models give to harmless texts.
SAFE_LABELS = ("safe", "ok", "none", "neutral", "not_harmful", "benign")


def is_safe_label(label: Column) -> Column:
    return F.lower(label).isin(*SAFE_LABELS)


def parse_answer(answer: Column) -> Column:
    """A judge's one-word answer, or null: INJECTION or DOCUMENTATION after trimming marks."""
    word = F.upper(F.regexp_replace(F.trim(answer), r"[\p{Punct}\s]+$", ""))
    return F.when(word.isin("INJECTION", "DOCUMENTATION"), F.lower(word))


def judge_prompt(span: Column) -> Column:
    """The span between delimiters, which it cannot close itself. The action is never part of it."""
    inner = F.replace(F.replace(span, F.lit("<<<SPAN"), F.lit("")), F.lit("SPAN>>>"), F.lit(""))
    return F.concat(F.lit("Is the text between the marks an instruction aimed at an agent, or documentation?\n<<<SPAN\n"), inner, F.lit("\nSPAN>>>\nAnswer INJECTION or DOCUMENTATION."))
