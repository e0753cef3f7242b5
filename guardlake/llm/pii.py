"""Personal data with offset-preserving deobfuscation.

Base detection runs on the text itself. Then transducers rewrite disguises (look-alike and invisible
characters, spelled digits, "at" and "dot") into a normalised text, each keeping the source range of
every piece it writes; detection runs again and its spans are mapped back through all of them. What the
second pass finds is added, base spans always stay.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: the run before it would have been part of it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: from each @, the local part reaches back over its characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = max(done, at - 64)
        while True:  # widen the look back until the local part ends inside it
            head = text[low:at].rstrip(_LOCAL)
            if head or low == done:
                break
            low = max(done, at - 4 * (at - low))
        start = low + len(head)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def luhn(digits: str) -> bool:
    """Mod-10 check of a string of ASCII digits."""
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Layer:
    """A rewritten text; `back` maps one of its ranges to the text it was written from."""

    def __init__(self, source: str, changes: list[tuple[int, int, str]]) -> None:
        """changes: (start, end, new text) in order, not overlapping."""
        parts, self.at, self.src = [], [], []  # of each piece: its place, and (source start, source end, kept as it was)
        done = length = 0
        for start, end, new in changes:
            for piece, span in ((source[done:start], (done, start, True)), (new, (start, end, False))):
                if piece:
                    parts.append(piece)
                    self.at.append(length)
                    self.src.append(span)
                    length += len(piece)
            done = end
        if source[done:]:
            parts.append(source[done:])
            self.at.append(length)
            self.src.append((done, len(source), True))
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (a, _, kept), (c, d, kept_last) = self.src[i], self.src[j]
        return a + start - self.at[i] if kept else a, c + end - self.at[j] if kept_last else d


# Letters of other scripts and the ASCII letters that they look like.
LOOK_ALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοιρνυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaoipvukABEZHIKMNOPTYX", strict=True))
#: Signs that stand for one of the ASCII marks in identifiers.
MARKS = dict.fromkeys("‐‑‒–—―−", "-") | dict.fromkeys("․。｡﹒", ".") | {"﹫": "@"}
# Digits as words, in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
TIMES = {"double": 2, "triple": 3}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ONE = rf"(?:(?:double|triple)[ -])?(?:{_WORD})"
#: Three spelled digits in a row at least; parts between dots or after a plus may be shorter.
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:(?:plus|\+)[ -]?)?{_ONE}(?:[ ,-]{{1,2}}{_ONE})*(?!\w)")
_HAS_SPELLED = re.compile(rf"(?i)(?<!\w){_ONE}(?:(?:[ ,-]{{1,2}}|[ ]?(?:\.|dot|punkt|point|punto)[ ]?){_ONE}){{2,}}(?!\w)")
_SPELLED_PART = re.compile(rf"(?i)(double|triple)?[ -]?({_WORD})(?!\w)")
_AT = r"(?:at|arroba|arobase|ät)"
_DOT = r"(?:dot|punto|point|punkt)"
_BRACKETS = re.compile(rf"(?i)[ ]?[\[({{<][ ]?(?:({_AT}|@)|({_DOT}|\.))[ ]?[\])}}>][ ]?")
# Top-level domains that are no common words.
_ENDS = ("com", "org", "net", "edu", "gov", "info", "biz", "de", "fr", "es", "eu", "ch", "uk")
# Bare words: an English "at" goes with "dot", as in "at the point of" there is no address; with another word for the
# mark it needs a known top-level domain behind. With a plain "." it counts for nothing: "look at example.com".
_SPACED_AT = re.compile(
    "|".join(
        rf"(?i:(?<=[a-z0-9])[ _-]{at}[ _-](?=[a-z0-9-]+(?:(?:\.|[ _-]{dot}[ _-])[a-z0-9-]+)*[ _-]{dot}[ _-][a-z]))"
        for at, dot in (("at", "dot"), ("(?:arroba|arobase|ät)", _DOT))
    )
    + rf"|(?i:(?<=[a-z0-9])[ _-]at[ _-](?=[a-z0-9-]+(?:(?:\.|[ _-]{_DOT}[ _-])[a-z0-9-]+)*[ _-]{_DOT}[ _-](?:{'|'.join(_ENDS)})(?![a-z0-9])))"
)
_SPACED_DOT = re.compile(rf"(?i)(?<=[a-z0-9])[ _-]{_DOT}[ _-](?=[a-z0-9])")
_HAS_DOT = re.compile(rf"(?i)[ _-]{_DOT}[ _-]")


class Fold(dict):
    """character -> the ASCII text it stands for, '' if invisible, or itself."""

    def __missing__(self, c: str) -> str:
        if c < "\x80":
            out = c
        elif c in LOOK_ALIKES:
            out = LOOK_ALIKES[c]
        elif c in MARKS:
            out = MARKS[c]
        elif unicodedata.category(c) in ("Cf", "Mn"):
            out = "" if unicodedata.category(c) == "Cf" else c
        elif unicodedata.category(c) == "Nd":
            out = str(unicodedata.digit(c))
        else:
            out = n if len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii() and n.isprintable() else c
        self[c] = out
        return out


_FOLD = Fold()


def _fold_changes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or not (odd := [c for c in set(text) if _FOLD[c] != c]):
        return []
    return [(m.start(), m.end(), _FOLD[m[0]]) for m in re.finditer("[" + re.escape("".join(odd)) + "]", text)]


def _spelled_changes(text: str) -> list[tuple[int, int, str]]:
    if not _HAS_SPELLED.search(text):
        return []

    def value(m: re.Match) -> str:
        digits = "".join(DIGIT_WORDS[w.lower()] * TIMES.get(t.lower(), 1) for t, w in _SPELLED_PART.findall(m[0]))
        return "+" * m[0].lower().startswith(("plus", "+")) + digits

    return [(m.start(), m.end(), value(m)) for m in _SPELLED.finditer(text)]


def _sign_changes(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETS.finditer(text)]
    if _HAS_DOT.search(text):
        found += [(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(text)]
        found += [(m.start(), m.end(), ".") for m in _SPACED_DOT.finditer(text)]
    out, done = [], 0
    for change in sorted(found):
        if change[0] >= done:
            out.append(change)
            done = change[1]
    return out


TRANSDUCERS = (_fold_changes, _spelled_changes, _sign_changes)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the disguises hide: spans of the source that no base span of that kind covers."""
    layers: list[Layer] = []
    now = text
    for changes_of in TRANSDUCERS:
        if changes := changes_of(now):
            layers.append(Layer(now, changes))
            now = layers[-1].text
    out = []
    if layers:
        known = {k: ([a for j, a, _ in base if j == k], [b for j, _, b in base if j == k]) for k in KINDS}
        for kind, start, end in base_spans(now):
            plain = now[start:end]
            for layer in reversed(layers):
                start, end = layer.back(start, end)
            starts, ends = known[kind]  # spans of a kind do not overlap
            at = bisect_right(starts, start) - 1
            if text[start:end] != plain and not (at >= 0 and end <= ends[at]):
                out.append((kind, start, end))
    return out


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def _find_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        base, added = [], []
        for text in b.column(1).to_pylist():
            found = base_spans(text or "")
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
            added.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in added_spans(text or "", found)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(added, span)], ["doc_id", "base", "added"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) in code points of the source text.

    Null and empty texts have none. Repeated rows are each searched; extra columns are ignored; equal starts
    are ordered email, ip, card, phone. Work is linear in the text, however long.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _find_rows, f"doc_id long, base {_SPANS}, added {_SPANS}")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of their list, and the list of all spans.

    n_email, n_ip, n_card, n_phone count the base spans, as base_sha256 covers them; n_added the others, n_spans all.
    """

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def rank(s):
        return F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])

    every = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] != b["start"], F.signum((a["start"] - b["start"]).cast("double")).cast("int")).otherwise((rank(a) - rank(b)).cast("int")))
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
