"""Chat requests and replies of the two common API shapes, as segments, tool calls and tool results.

Input rows have `request` (an id) and `body` (JSON text). What is not JSON gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OPENAI = "model string, stream boolean, messages array<struct<role:string,content:string,tool_call_id:string>>"
_CALLS = "choices array<struct<message:struct<content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>"


def openai_segments(requests: DataFrame) -> DataFrame:
    """(request, pos, role, text) of every message with content, whatever its role."""
    rows = requests.select("request", F.posexplode(F.from_json("body", _OPENAI)["messages"]).alias("pos", "m"))
    return rows.select("request", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("text")).where("text is not null")


def openai_tool_results(requests: DataFrame) -> DataFrame:
    """(request, pos, content) of tool messages."""
    return openai_segments(requests).where("role = 'tool' and text <> ''").select("request", "pos", F.col("text").alias("content"))


def openai_tool_calls(replies: DataFrame) -> DataFrame:
    """(request, pos, tool, args) of all choices' calls, in order."""
    choices = F.from_json("body", _CALLS)["choices"]
    calls = F.flatten(F.transform(choices, lambda c: F.coalesce(c["message"]["tool_calls"], F.array().cast("array<struct<function:struct<name:string,arguments:string>>>"))))
    rows = replies.select("request", F.posexplode(calls).alias("pos", "c"))
    return rows.select("request", "pos", F.col("c.function.name").alias("tool"), F.col("c.function.arguments").alias("args"))


def openai_reply_text(replies: DataFrame) -> DataFrame:
    """The first choice's content."""
    return replies.select("request", F.get(F.from_json("body", _CALLS)["choices"], F.lit(0))["message"]["content"].alias("text"))


def _blocks(content: Column) -> Column:
    """A content field as an array of blocks: a string is one text block."""
    block = "array<struct<type:string,text:string,name:string,input:string,content:string>>"
    is_list = F.ltrim(content).startswith("[")
    parsed = F.from_json(content, block)
    text = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(k) for k in ("name", "input", "content")]))
    return F.when(is_list & parsed.isNotNull(), parsed).otherwise(text)


_ANTHROPIC = "system string, messages array<struct<role:string,content:string>>"


def anthropic_blocks(requests: DataFrame) -> DataFrame:
    """(request, pos, role, block): the system text first, then all messages' blocks."""
    body = F.from_json("body", _ANTHROPIC)
    system = F.when(body["system"].isNotNull(), F.array(F.struct(F.lit("system").alias("role"), body["system"].alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    rows = requests.select("request", F.posexplode(F.concat(system, F.coalesce(body["messages"], F.array().cast("array<struct<role:string,content:string>>")))).alias("m", "msg"))
    each = rows.select("request", "m", F.col("msg.role").alias("role"), F.posexplode(_blocks(F.col("msg.content"))).alias("b", "block"))
    return each.select("request", F.struct("m", "b").alias("pos"), "role", "block")


def anthropic_segments(requests: DataFrame) -> DataFrame:
    return anthropic_blocks(requests).where("block.type = 'text' and block.text is not null").select("request", "pos", "role", F.col("block.text").alias("text"))


def anthropic_tool_results(requests: DataFrame) -> DataFrame:
    """Content of tool_result blocks: a string, or the texts inside joined by line ends."""
    inner = F.array_join(F.transform(F.filter(_blocks(F.col("block.content")), lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return anthropic_blocks(requests).where("block.type = 'tool_result'").select("request", "pos", inner.alias("content")).where("content <> ''")


def anthropic_tool_calls(replies: DataFrame) -> DataFrame:
    """tool_use blocks of a reply body {content: [...]}; a missing input is null."""
    rows = replies.select("request", F.posexplode(_blocks(F.get_json_object("body", "$.content"))).alias("pos", "b"))
    return rows.where("b.type = 'tool_use'").select("request", "pos", F.col("b.name").alias("tool"), F.col("b.input").alias("args"))


def anthropic_reply_text(replies: DataFrame) -> DataFrame:
    text = F.filter(_blocks(F.get_json_object("body", "$.content")), lambda b: b["type"] == "text")
    return replies.select("request", F.array_join(F.transform(text, lambda b: b["text"]), "\n").alias("text"))


def _placed(rows: DataFrame) -> Column:
    """pos, a number or (m, b), as (m, b) numbers that compare as such."""
    if isinstance(rows.schema["pos"].dataType, StructType):
        return F.struct(F.col("pos.m").cast("long").alias("m"), F.col("pos.b").cast("long").alias("b"))
    return F.struct(F.col("pos").cast("long").alias("m"), F.lit(0).cast("long").alias("b"))


def cycle_events(results: DataFrame, calls: DataFrame) -> DataFrame:
    """One request-and-reply cycle as a session of its own: results first, from an untrusted server, then calls."""
    none = F.lit(None).cast("string")
    source = F.struct(F.lit("mcp_server").alias("origin"), none.alias("host"), F.lit("api-tool").alias("name"))
    a = results.select(F.col("request").alias("session"), F.struct(F.lit(0).alias("k"), _placed(results).alias("p")).alias("o"), F.lit("tool_result").alias("kind"), F.lit("api-tool").alias("tool"), none.alias("args"), "content", source.alias("source"))
    b = calls.select(F.col("request").alias("session"), F.struct(F.lit(1).alias("k"), _placed(calls).alias("p")).alias("o"), F.lit("tool_call").alias("kind"), "tool", "args", none.alias("content"), F.lit(None).cast("struct<origin:string,host:string,name:string>").alias("source"))
    seq = F.row_number().over(Window.partitionBy("session").orderBy("o")).cast("bigint")
    empty = {"parent": none, "name": none, "instructions": none, "granted_tools": F.lit(None).cast("array<string>"), "server": none, "tools": F.lit(None).cast("array<struct<name:string,description:string,schema:string>>")}
    return a.unionByName(b).withColumn("seq", seq).drop("o").withColumns({"agent": F.lit("main"), "at_ms": F.lit(0).cast("bigint")} | empty)
