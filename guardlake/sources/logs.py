"""Hook payloads, handshake lines and audit logs."""

from __future__ import annotations

import os
import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardlake.functions.hosts import provenance
from guardlake.functions.text import truncate_utf8
from guardlake.schema import AUDIT

MAX_CONTENT, MAX_BODY = 256 << 10, 8 << 20
_HOOK = "session_id string, hook_event_name string, cwd string, tool_name string, tool_input string, tool_use_id string, tool_response string, agent_id string, agent_type string, last_assistant_message string"
# Hook names and the event kinds they become.
HOOK_KINDS = {"PreToolUse": "tool_call", "PostToolUse": "tool_result", "SubagentStop": "subagent_report", "SessionStart": "session_start", "SessionEnd": "session_end"}


def response_text(raw: Column) -> Column:
    """A tool's response as text: null is empty, an object with a string `text` is that, else the JSON."""
    inner = F.get_json_object(raw, "$.text")
    return F.when(raw.isNull(), "").when(F.ltrim(raw).startswith("{") & inner.isNotNull(), inner).otherwise(raw)


def hook_events(lines: DataFrame) -> DataFrame:
    """Events of hook payloads (arrival, value): those without session or of other names give none.

    seq counts a session's events from 1 in order of arrival, and again after its end.
    """
    h = lines.where(F.octet_length("value") <= MAX_BODY).select("arrival", F.from_json("value", _HOOK).alias("h")).select("arrival", "h.*")
    kind = F.create_map(*[F.lit(x) for kv in HOOK_KINDS.items() for x in kv])[F.col("hook_event_name")]
    rows = h.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.coalesce("session_id", F.lit("")) != ""))
    order = Window.partitionBy("session_id").orderBy("arrival")
    epoch = F.coalesce(F.sum((F.col("kind") == "session_end").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("epoch", epoch).withColumn("seq", F.row_number().over(Window.partitionBy("session_id", "epoch").orderBy("arrival")).cast("bigint"))
    full = F.when(F.col("kind") == "tool_result", response_text(F.col("tool_response"))).when(F.col("kind") == "subagent_report", F.coalesce("last_assistant_message", F.lit("")))
    none = F.lit(None).cast("string")
    source = F.when(F.col("kind") == "tool_result", provenance(F.col("tool_name"), F.col("tool_input"), F.col("cwd")))
    return rows.select(
        F.col("session_id").alias("session"), F.coalesce("agent_id", F.lit("main")).alias("agent"), none.alias("parent"), "seq", F.lit(0).cast("bigint").alias("at_ms"), "kind", F.col("tool_name").alias("tool"),
        F.when(F.col("kind") == "tool_call", F.col("tool_input")).alias("args"), truncate_utf8(full, MAX_CONTENT).alias("content"), source.alias("source"), F.coalesce("agent_type", F.lit("subagent")).alias("name"),
        none.alias("instructions"), F.lit(None).cast("array<string>").alias("granted_tools"), none.alias("server"), F.lit(None).cast("array<struct<name:string,description:string,schema:string>>").alias("tools"),
        F.coalesce(F.octet_length(full) > MAX_CONTENT, F.lit(False)).alias("truncated"), "epoch",
    )


def manifests(lines: DataFrame) -> DataFrame:
    """Adds tools to lines (server, hs_seq, value) of JSON-RPC: only results with a list of tools that all have a
    string name are handshakes; the rest goes."""
    v = F.try_parse_json("value")
    tools = F.from_json(F.get_json_object("value", "$.result.tools"), "array<struct<name:string,description:string,inputSchema:string>>")
    is_list = F.ltrim(F.get_json_object("value", "$.result.tools")).startswith("[")
    named = F.size(F.filter(tools, lambda t: t["name"].isNull())) == 0
    shaped = F.transform(tools, lambda t: F.struct(t["name"].alias("name"), F.coalesce(t["description"], F.lit("")).alias("description"), t["inputSchema"].alias("schema")))
    return lines.where(v.isNotNull() & is_list & tools.isNotNull() & named).withColumn("tools", shaped)


def pins(handshakes: DataFrame) -> DataFrame:
    """(server, hash, hs_seq): the last hash of each server; its file name keeps letters, digits, _ and -."""
    last = handshakes.groupBy("server").agg(F.max_by("hash", "hs_seq").alias("hash"), F.max("hs_seq").alias("hs_seq"))
    return last.withColumn("file", F.regexp_replace("server", "[^A-Za-z0-9_-]", "_"))


def save_pins(pinned: DataFrame, path: str) -> None:
    """Append pins (server, hash, hs_seq, ...) to a store: a table in which the last row of a server counts."""
    pinned.select("server", "hash", "hs_seq").write.mode("append").parquet(path)


def load_pins(spark: SparkSession, path: str) -> DataFrame:
    """(server, hash, hs_seq, file) of a store: the last pin of each server."""
    return pins(spark.read.schema("server string, hash string, hs_seq bigint").parquet(path))


def write_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows as JSON lines."""
    rows.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows with `malformed`: a line that is no JSON object with the needed fields is counted, never fatal."""
    return parse_audit(spark.read.text(path))


def parse_audit(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.trim("value") != "").select("value", F.from_json("value", AUDIT).alias("a"))
    bad = F.try_parse_json("value").isNull() | F.col("a.session").isNull() | F.col("a.verdict").isNull()
    return rows.select("a.*", bad.alias("malformed"))


def options(file_values: dict[str, str], environ: dict[str, str] | None = None) -> dict[str, str]:
    """Engine options: GUARDLAKE_<NAME> in the environment wins over the file."""
    environ = dict(os.environ) if environ is None else environ
    return {k: environ.get(f"GUARDLAKE_{k.upper()}", v) for k, v in file_values.items()}


def is_loopback_url(url: str) -> bool:
    """Whether a URL's host is this machine; names that merely begin so are not."""
    if not re.match(r"(?i)https?://", url):
        return False
    try:
        host = urlsplit(url).hostname
    except ValueError:
        return False
    return host in ("localhost", "127.0.0.1", "::1")
