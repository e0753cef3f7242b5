"""Streaming forms: taint over live sessions, and tail scans of streamed replies.

Both keep state by key with `applyInPandasWithState`; the batch operators are the reference for their results.
State of a session is bounded by `cap` entries (oldest out first) and ends with the session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guardlake.functions.fingerprints import MIN_HITS, literals
from guardlake.functions.hosts import trust

CAP = 10_000
TAINT_SCHEMA = "session string, seq bigint, source string, mark_seq bigint"


class Marks:
    """key -> (seq, source), in order of first record; a lower seq replaces a mark, the oldest key leaves first."""

    def __init__(self, entries: list, cap: int) -> None:
        self.of = {k: (s, src) for k, s, src in entries}
        self.cap = cap

    def record(self, keys, seq: int, source: str) -> None:
        for k in keys:
            if k in self.of:
                if seq < self.of[k][0]:
                    self.of[k] = (seq, source)
            else:
                while len(self.of) >= self.cap:
                    del self.of[next(iter(self.of))]
                self.of[k] = (seq, source)

    def entries(self) -> list:
        return [(k, s, src) for k, (s, src) in self.of.items()]


def leaf_mark(prints: Marks, texts: Marks, keys, leaf: str) -> tuple[int, str] | None:
    """The earliest mark of a leaf: of its fingerprints if enough were seen, or of a literal inside it."""
    hits = [prints.of[k] for k in set(keys) if k in prints.of]
    found = [min(hits)] if len(hits) >= MIN_HITS else []
    low = leaf.lower()
    found += [m for k, m in texts.of.items() if k in low]
    return min(found) if found else None


def _session_step(cap: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"p": [], "t": []}
        prints, texts = Marks(saved["p"], cap), Marks(saved["t"], cap)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out, ended = [], False
        for e in rows.to_dict("records"):
            if e["kind"] == "session_end":
                prints, texts, ended = Marks([], cap), Marks([], cap), True
                continue
            ended = False
            if e["records"]:
                prints.record(e["prints"][0], e["seq"], e["source"])
                texts.record(e["texts"], e["seq"], e["source"])
            elif e["kind"] == "tool_call":
                for keys, leaf in zip(e["prints"], e["leaves"], strict=True):
                    if mark := leaf_mark(prints, texts, keys, leaf):
                        out.append((key[0], e["seq"], mark[1], mark[0]))
                        break
        if ended:
            state.remove()
        else:
            state.update((json.dumps({"p": prints.entries(), "t": texts.entries()}, default=int),))
        yield pd.DataFrame(out, columns=["session", "seq", "source", "mark_seq"])

    return step


def stream_taint(events: DataFrame, cap: int = CAP) -> DataFrame:
    """(session, seq, source label, mark_seq) of tainted calls of a stream of events with `leaves`; append mode."""
    from guardlake.functions.hosts import provenance_label

    report = F.col("kind") == "subagent_report"
    records = report | ((F.col("kind") == "tool_result") & (trust(F.col("source.origin")) == 0))
    label = F.when(report, F.concat(F.lit("subagent:"), F.col("name"))).otherwise(provenance_label(F.col("source")))
    texts = F.when(records, F.array(F.coalesce("content", F.lit("")))).otherwise(F.coalesce("leaves", F.array().cast("array<string>")))
    each = events.select("session", "seq", "kind", records.alias("records"), label.alias("source"), texts.alias("leaves"), literals(F.coalesce("content", F.lit(""))).alias("texts"))
    flat = each.withColumn("prints", _prints_of("leaves"))
    keyed = flat.select("session", "seq", "kind", F.coalesce("records", F.lit(False)).alias("records"), "source", "leaves", "texts", "prints").groupBy("session")
    return keyed.applyInPandasWithState(_session_step(cap), TAINT_SCHEMA, "saved string", "append", GroupStateTimeout.NoTimeout)


def _prints_of(column: str):
    from pyspark.sql.types import ArrayType, LongType

    from guardlake.functions.fingerprints import fingerprint_bytes

    @F.pandas_udf(ArrayType(ArrayType(LongType())))
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda leaves: [fingerprint_bytes(" ".join(t.lower().split()).encode("utf-8", "surrogatepass")) for t in leaves])

    return of(F.col(column))



def _tail_step(patterns: list[tuple[str, str]], keep: int):
    import re

    compiled = [(name, re.compile(p)) for name, p in patterns]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, done = state.get if state.exists else ("", False)
        raw, out = bytes.fromhex(tail), []
        for e in pd.concat(list(batches)).sort_values("chunk_no", kind="stable").to_dict("records"):
            if done:
                continue
            raw = (raw + bytes(e["chunk"]))[-keep:]
            text = raw.decode("utf-8", "replace")
            if hit := next((name for name, p in compiled if p.search(text)), None):
                out.append((key[0], e["chunk_no"], hit))
                done = True
        state.update((raw.hex(), done))
        yield pd.DataFrame(out, columns=["request", "chunk_no", "detector"])

    return step


def stream_tail_scan(chunks: DataFrame, window: int = 4096) -> DataFrame:
    """(request, chunk_no, detector) where a streamed reply (request, chunk_no, chunk) is cut off: each chunk is scanned
    with the last 4 * max(window, 16) bytes, and the first dangerous match of high severity ends the request."""
    from guardlake.operators.detect import OUTPUT_RULES, SECRET_RULES
    from guardlake.schema import SEVERITIES

    high = SEVERITIES.index("high")
    patterns = [(r.detector, r.pattern) for r in (*SECRET_RULES, *OUTPUT_RULES) if not r.gate and SEVERITIES.index(r.severity) >= high]
    return chunks.groupBy("request").applyInPandasWithState(_tail_step(patterns, 4 * max(window, 16)), "request string, chunk_no bigint, detector string", "tail string, done boolean", "append", GroupStateTimeout.NoTimeout)
