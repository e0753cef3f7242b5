"""Policies as data: ordered rules compiled to one CASE expression.

Text rules may ask for direction, detector with min_severity, and risk_score_gte; agent rules for these and
facet, taint, action_class, min_action_class, egress_not_allowlisted and four booleans. A rule without
conditions matches everything; the first match decides; nothing matched gives the default.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.functions.hof import all_of, case
from guardlake.schema import ACTION_CLASSES, SEVERITIES

DECISION = "struct<action:string,rule:string,message:string,fallback:string>"
TEXT_ACTIONS, AGENT_ACTIONS = ("allow", "flag", "mask", "block"), ("allow", "ask", "deny", "escalate")
FLAGS = ("subagent_escalation", "touches_sensitive_path", "mcp_manifest_changed", "mcp_tool_shadow")
# Names of taint sources in policies, and the origins they stand for.
TAINT_ORIGINS = {"network": "network", "mcp": "mcp_server", "subagent": "subagent"}
TEXT_KEYS = {"detector", "min_severity", "direction", "risk_score_gte"}
AGENT_KEYS = {"detector", "min_severity", "facet", "taint", "action_class", "min_action_class", "risk_score_gte", "egress_not_allowlisted", *FLAGS}


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    when: dict = field(default_factory=dict)
    message: str | None = None
    fallback: str | None = None


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...]
    default: str = "allow"
    allowed_hosts: tuple[str, ...] = ()


def text_policy(data: dict) -> Policy:
    """From a mapping as read from YAML. Unknown keys are left alone."""
    rules = tuple(Rule(r["name"], r["action"], r.get("when") or {}, r.get("message")) for r in data.get("policies", []))
    for r in rules:
        if r.action not in TEXT_ACTIONS:
            raise ValueError(f"rule {r.name}: unknown action {r.action}")
        _check_names(r)
    return Policy(rules, data.get("default", "allow"))


def agent_policy(data: dict) -> Policy:
    """Checked as it is read: unknown keys, a missing or misplaced fallback and a default of escalate are errors."""
    if extra := set(data) - {"agent_policies", "egress_allowlist", "default"}:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    rules = []
    for r in data.get("agent_policies", []):
        if extra := set(r) - {"name", "when", "action", "fallback", "message"}:
            raise ValueError(f"rule {r.get('name')}: unknown keys {sorted(extra)}")
        rule = Rule(r["name"], r["action"], r.get("when") or {}, r.get("message"), r.get("fallback"))
        if extra := set(rule.when) - AGENT_KEYS:
            raise ValueError(f"rule {rule.name}: unknown conditions {sorted(extra)}")
        if rule.action not in AGENT_ACTIONS:
            raise ValueError(f"rule {rule.name}: unknown action {rule.action}")
        if rule.action == "escalate" and rule.fallback not in ("allow", "ask"):
            raise ValueError(f"rule {rule.name}: escalate needs a fallback of allow or ask")
        if rule.action != "escalate" and rule.fallback is not None:
            raise ValueError(f"rule {rule.name}: only escalate takes a fallback")
        _check_names(rule)
        rules.append(rule)
    default = data.get("default", "allow")
    if default not in ("allow", "ask", "deny"):
        raise ValueError(f"default cannot be {default}")
    return Policy(tuple(rules), default, tuple(data.get("egress_allowlist", ())))


def _check_names(rule: Rule) -> None:
    w = rule.when
    for key, names in (("min_severity", SEVERITIES), ("action_class", ACTION_CLASSES), ("min_action_class", ACTION_CLASSES)):
        if key in w and w[key] not in names:
            raise ValueError(f"rule {rule.name}: unknown {key} {w[key]}")
    for t in w.get("taint", ()):
        if t not in TAINT_ORIGINS:
            raise ValueError(f"rule {rule.name}: unknown taint source {t}")


def load(path: str | Path) -> Policy:
    """Read a YAML policy file (needs PyYAML); its first key says which kind it is."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return agent_policy(data) if "agent_policies" in data else text_policy(data)


def shipped(name: str) -> Policy:
    return load(Path(__file__).parent / "policies" / f"{name}.yaml")


def _has_finding(findings: Column, when: dict) -> Column:
    """Detector prefix (ending at a dot), severity and facet must hold for one and the same finding."""

    def same(f: Column) -> Column:
        tests = []
        if "detector" in when:
            tests.append((f["detector"] == when["detector"]) | f["detector"].startswith(when["detector"] + "."))
        if "min_severity" in when:
            tests.append(f["severity"] >= SEVERITIES.index(when["min_severity"]))
        if "facet" in when:
            tests.append(f["facet"] == when["facet"])
        return all_of(tests)

    return F.exists(findings, same)


def _condition(when: dict, s: dict[str, Column]) -> Column:
    tests = []
    if "direction" in when:
        tests.append(s["direction"] == when["direction"])
    if "risk_score_gte" in when:
        tests.append(s["risk_score"] >= when["risk_score_gte"])
    if when.keys() & {"detector", "min_severity", "facet"}:
        tests.append(_has_finding(s["findings"], when))
    if "taint" in when:
        tests.append(s["taint_origin"].isin(*[TAINT_ORIGINS[t] for t in when["taint"]]))
    if "action_class" in when:
        tests.append(s["action_class"] == ACTION_CLASSES.index(when["action_class"]))
    if "min_action_class" in when:
        tests.append(s["action_class"] >= ACTION_CLASSES.index(when["min_action_class"]))
    if when.get("egress_not_allowlisted"):  # false asks for nothing
        tests.append(F.size(s["unlisted_hosts"]) > 0)
    tests += [s[k] == when[k] for k in FLAGS if k in when]
    return all_of(tests)


def compile_policy(policy: Policy, signals: dict[str, Column]) -> Column:
    """The decision as a struct (action, rule, message, fallback) over the given signal columns."""

    def decision(action: str, rule: str | None, message: str | None, fallback: str | None) -> Column:
        values = {"action": action, "rule": rule, "message": message, "fallback": fallback}
        return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])

    pairs = [(_condition(r.when, signals), decision(r.action, r.name, r.message, r.fallback)) for r in policy.rules]
    return case(pairs, decision(policy.default, None, None, None))
