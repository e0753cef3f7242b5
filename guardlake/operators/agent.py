"""The agent pipeline over event logs: taint, authority, manifests, signals, policy, hook decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.functions.hosts import hosts, unlisted
from guardlake.functions.text import detector_root
from guardlake.operators.actions import action_class, args_text, facet_direction, facets, touches_sensitive_path, with_leaves
from guardlake.operators.detect import DEFAULT, NO_FINDINGS, Detector, detect
from guardlake.operators.score import dedupe, risk_score
from guardlake.operators.taint import taint_marks, with_epochs
from guardlake.plans.policy import FLAGS, Policy, compile_policy, shipped
from guardlake.sources.shared import stored

# Tools every agent has, whose names no server may take.
BUILTIN_TOOLS = ("Read", "Write", "Edit", "Bash", "Glob", "Grep", "WebFetch", "WebSearch", "Task")


def event_findings(events: DataFrame, detectors: tuple[Detector, ...] = DEFAULT) -> DataFrame:
    """Adds findings, with their facet, of all facets of an event in order; texts are not normalised here."""

    def of(f: Column) -> Column:
        found = detect(f["text"], facet_direction(f["facet"]), detectors)
        return F.transform(found, lambda x: x.withField("facet", f["facet"]))

    none = F.array().cast(NO_FINDINGS.replace("atlas:string>", "atlas:string,facet:string>"))
    rows = events.select("session", "seq", F.posexplode(facets()).alias("pos", "f")).select("session", "seq", "pos", of(F.col("f")).alias("found"))
    per = rows.groupBy("session", "seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "found"))), lambda p: p["found"])).alias("findings"))
    return events.join(per, ["session", "seq"], "left").withColumn("findings", F.coalesce("findings", none))


def escalations(events: DataFrame, roots: dict[str, list[str]] | None = None, default_root: tuple[str, ...] = ()) -> DataFrame:
    """(session, seq, agent, parent, extra) of spawns that ask for tools their parent lacks.

    Grants depend on which earlier spawns were refused, so each session is replayed in order; only spawns and
    ends go to the replay. The root agent `main` holds `default_root`, or what `roots` names for the session.
    """
    roots = roots or {}

    def replay(session: pd.DataFrame) -> pd.DataFrame:
        name = session["session"].iloc[0]
        start = {"main": set(roots.get(name, default_root))}
        grants, out = dict(start), []
        for e in session.sort_values("seq").to_dict("records"):
            if e["kind"] == "session_end":
                grants = dict(start)
                continue
            parent = e["parent"] or e["agent"]
            asked = set(e["granted_tools"] if e["granted_tools"] is not None else ())
            extra = sorted(asked - grants.get(parent, set()))
            if extra:
                out.append((name, e["seq"], e["name"], parent, extra))
            else:
                grants[e["name"]] = asked
        return pd.DataFrame(out, columns=["session", "seq", "agent", "parent", "extra"])

    needed = events.where("kind in ('subagent_spawn', 'session_end')").select("session", "seq", "kind", "agent", "parent", "name", "granted_tools")
    return needed.groupBy("session").applyInPandas(replay, "session string, seq bigint, agent string, parent string, extra array<string>")


def manifest_hash(tools: Column) -> Column:
    """SHA-256 of the tools by name, each with description and canonical schema, ended by zero bytes."""
    zero = F.lit("\0")

    def entry(t: Column) -> Column:
        schema = F.coalesce(F.to_json(F.parse_json(t["schema"])), F.lit("null"))
        return F.concat(t["name"], zero, F.coalesce(t["description"], F.lit("")), zero, schema, zero)

    by_name = F.array_sort(tools, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return F.sha2(F.array_join(F.transform(by_name, entry), "").cast("binary"), 256)


def manifest_diff(old: Column, new: Column) -> Column:
    """+added, -removed and ~changed tool names, or `no change`."""

    def names(tools: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(tools, lambda t: t["name"])))

    def marked(sign: str, which: Column) -> Column:
        return F.transform(which, lambda n: F.concat(F.lit(sign), n))

    def value(tools: Column, name: Column) -> Column:
        same = F.filter(tools, lambda t: t["name"] == name)
        return F.element_at(F.transform(same, lambda t: F.struct(F.coalesce(t["description"], F.lit("")), F.coalesce(F.to_json(F.parse_json(t["schema"])), F.lit("null")))), -1)

    common = F.array_intersect(names(new), names(old))
    changed = F.filter(common, lambda n: value(old, n) != value(new, n))
    parts = F.concat(marked("+", F.array_except(names(new), names(old))), marked("-", F.array_except(names(old), names(new))), marked("~", changed))
    return F.when(F.size(parts) == 0, "no change").otherwise(F.array_join(parts, " "))


def manifest_drift(handshakes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds hash and drifted to rows (server, hs_seq, tools): the last pin differs. A first sight is no drift, unless
    `known` (server, hash), the pins of an earlier run, says otherwise."""
    order = Window.partitionBy("server").orderBy("hs_seq")
    hashed = handshakes.withColumn("hash", manifest_hash(F.col("tools")))
    last = F.lag("hash").over(order)
    if known is None:
        return hashed.withColumn("drifted", F.coalesce(last != F.col("hash"), F.lit(False)))
    pinned = hashed.join(known.select("server", F.col("hash").alias("pinned_")), "server", "left")
    return pinned.withColumn("drifted", F.coalesce(F.coalesce(last, "pinned_") != F.col("hash"), F.lit(False))).drop("pinned_")


def tool_shadow(handshakes: DataFrame) -> DataFrame:
    """(server, hs_seq, shadow): the first declared name that a builtin or an earlier server owns, else null."""
    names = handshakes.select("server", "hs_seq", F.posexplode("tools").alias("pos", "t")).select("server", "hs_seq", "pos", F.col("t.name").alias("tool"))
    owner = F.first("server").over(Window.partitionBy("tool").orderBy("hs_seq", "server"))
    taken = F.col("tool").isin(*BUILTIN_TOOLS) | (owner != F.col("server"))
    hit = names.withColumn("taken", taken).where("taken").groupBy("server", "hs_seq").agg(F.min_by("tool", "pos").alias("shadow"))
    return handshakes.select("server", "hs_seq").join(hit, ["server", "hs_seq"], "left")


def inspect(events: DataFrame, policy: Policy | None = None, roots: dict[str, list[str]] | None = None, default_root: tuple[str, ...] = (), detectors: tuple[Detector, ...] = DEFAULT) -> DataFrame:
    """Verdict of every event: verdict, rule, message, fallback, risk_score, findings, taint, egress_hosts, action_class.

    Findings are scored after dropping repeats, and matched by the policy before. Lifecycle and unknown events are
    allowed. Rows are unique by (session, seq).
    """
    policy = policy or shipped("agent")
    staged = stored(with_epochs(with_leaves(events)), "events")  # findings, marks and facts all read the leaves
    found = event_findings(staged, detectors)
    marks = taint_marks(staged).withColumnRenamed("source", "taint")
    extra = escalations(events, roots, default_root).select("session", "seq", F.lit(True).alias("subagent_escalation"))
    text = args_text(F.coalesce("leaves", F.array().cast("array<string>")))
    call = F.col("kind") == "tool_call"
    rows = found.join(marks, ["session", "seq"], "left").join(extra, ["session", "seq"], "left")
    rows = rows.withColumn("_text", F.when(call, text)).withColumn("risk_score", risk_score(dedupe(F.col("findings"))))
    rows = rows.withColumn("action_class", F.when(call, action_class(F.col("tool"), F.col("_text"))))
    rows = rows.withColumn("egress_hosts", F.when(call, hosts(F.col("_text"))).otherwise(F.array().cast("array<string>")))
    signals = {k: F.lit(False) for k in FLAGS} | {
        "direction": F.lit(None).cast("string"), "findings": F.col("findings"), "risk_score": F.col("risk_score"), "taint_origin": F.col("taint.origin"), "action_class": F.col("action_class"),
        "unlisted_hosts": unlisted(F.col("egress_hosts"), list(policy.allowed_hosts)), "subagent_escalation": F.coalesce("subagent_escalation", F.lit(False)),
        "touches_sensitive_path": F.coalesce(touches_sensitive_path(F.col("_text")), F.lit(False)),
    }
    decided = rows.withColumn("d", compile_policy(policy, signals))
    inert = F.col("kind").isin("session_start", "session_end", "unknown")
    verdict = F.when(inert, "allow").otherwise(F.col("d.action"))
    return decided.select(
        "session", "seq", "kind", "tool", verdict.alias("verdict"), F.when(~inert, F.col("d.rule")).alias("rule"), F.when(~inert, F.col("d.message")).alias("message"), F.when(~inert, F.col("d.fallback")).alias("fallback"),
        "risk_score", "findings", "taint", "mark_seq", "egress_hosts", "action_class",
    )


def inspect_handshakes(handshakes: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Verdicts of manifests (server, hs_seq, tools): drift, shadowing and what the descriptions say."""
    policy = policy or shipped("agent")
    facts = manifest_drift(handshakes).join(tool_shadow(handshakes), ["server", "hs_seq"])
    texts = F.transform("tools", lambda t: F.concat(t["name"], F.lit(": "), F.coalesce(t["description"], F.lit(""))))
    found = F.flatten(F.transform(texts, lambda t: F.transform(detect(t, F.lit("input")), lambda x: x.withField("facet", F.lit("tool_description")))))
    rows = facts.withColumn("findings", found)
    signals = {k: F.lit(False) for k in FLAGS} | {
        "direction": F.lit(None).cast("string"), "findings": F.col("findings"), "risk_score": risk_score(dedupe(F.col("findings"))), "taint_origin": F.lit(None).cast("string"), "action_class": F.lit(None).cast("tinyint"),
        "unlisted_hosts": F.array().cast("array<string>"), "mcp_manifest_changed": F.col("drifted"), "mcp_tool_shadow": F.col("shadow").isNotNull(),
    }
    return rows.withColumn("d", compile_policy(policy, signals)).select("server", "hs_seq", "hash", "drifted", "shadow", F.col("d.action").alias("verdict"), F.col("d.rule").alias("rule"))


def resolve_escalation(verdict: Column, fallback: Column, answer: Column) -> Column:
    """An escalated verdict after the judge: an injection asks, anything else (or no answer) falls back."""
    return F.when(verdict == "escalate", F.when(answer == "injection", "ask").otherwise(F.coalesce(fallback, F.lit("allow")))).otherwise(verdict)


def hook_decision(verdict: Column, enforce: bool) -> Column:
    """What a hook is told: ask and deny only when enforcing, else the agent's own rules decide."""
    return F.when(F.lit(enforce) & verdict.isin("ask", "deny"), verdict).otherwise("defer")


def hook_reason(rule: Column, message: Column) -> Column:
    return F.concat(F.lit("["), rule, F.lit("] "), message)


def session_flags(verdicts: DataFrame) -> DataFrame:
    """(session, flagged): some event asks or denies, escalations taken at their fallback."""
    effective = resolve_escalation(F.col("verdict"), F.col("fallback"), F.lit(None).cast("string"))
    return verdicts.groupBy("session").agg(F.bool_or(effective.isin("ask", "deny")).alias("flagged"))


def verdict_rank(verdict: Column) -> Column:
    # Order of verdicts.
    return F.when(verdict == "deny", 3).when(verdict == "escalate", 2).when(verdict == "ask", 1).otherwise(0)


def worst_verdict(verdicts: DataFrame, by: str = "session") -> DataFrame:
    """The most severe verdict of each group, the first among equals."""
    return verdicts.groupBy(by).agg(F.max_by(F.struct("verdict", "rule", "seq"), F.struct(verdict_rank(F.col("verdict")), -F.col("seq"))).alias("w")).select(by, "w.*")


def judged_spans(verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """Escalated calls with the content that tainted them, for a judge; blank content leaves the fallback."""
    content = events.select("session", F.col("seq").alias("mark_seq"), "content")
    return verdicts.where("verdict = 'escalate'").join(content, ["session", "mark_seq"], "left").where(F.trim("content") != "").select("session", "seq", "content", "fallback")


def judge(spans: DataFrame, answer) -> DataFrame:
    """Adds answer from a callable over lists of prompts; an error counts as no answer."""
    from guardlake.functions.text import judge_prompt, parse_answer

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                b["raw"] = list(answer(b["prompt"].tolist()))
            except Exception:  # an unreachable judge must never decide
                b["raw"] = None
            yield b[["session", "seq", "fallback", "raw"]]

    asked = spans.select("session", "seq", "fallback", judge_prompt(F.col("content")).alias("prompt")).mapInPandas(ask, "session string, seq bigint, fallback string, raw string")
    return asked.select("session", "seq", "fallback", parse_answer(F.col("raw")).alias("answer"))


def audit_rows(verdicts: DataFrame, enforce: bool = False) -> DataFrame:
    """Verdicts as audit rows."""
    from guardlake.functions.hosts import provenance_label
    from guardlake.schema import SEVERITIES

    short = F.transform("findings", lambda f: F.struct(f["detector"].alias("detector"), F.element_at(F.array(*map(F.lit, SEVERITIES)), f["severity"].cast("int") + 1).alias("severity"), f["label"].alias("label"), f["facet"].alias("facet")))
    return verdicts.select("session", "seq", F.col("kind").alias("event"), "tool", "verdict", F.lit(not enforce).alias("shadow"), "rule", "risk_score", short.alias("findings"), F.when(F.col("taint").isNotNull(), provenance_label(F.col("taint"))).alias("taint"), "egress_hosts")


def roots_of(findings: Column) -> Column:
    return F.array_distinct(F.transform(findings, lambda f: detector_root(f["detector"])))
