"""Row types: findings, events, audit rows; and the ordered enums as small integers."""

from __future__ import annotations

FINDING = "struct<detector:string,severity:tinyint,confidence:float,span_start:int,span_end:int,label:string,owasp:string,atlas:string>"
PROVENANCE = "struct<origin:string,host:string,name:string>"
EVENT = (
    "session string, agent string, parent string, seq bigint, at_ms bigint, kind string, tool string, args string, content string, "
    f"source {PROVENANCE}, name string, instructions string, granted_tools array<string>, server string, "
    "tools array<struct<name:string,description:string,schema:string>>"
)
AUDIT = (
    "at_ms bigint, session string, seq bigint, event string, tool string, verdict string, shadow boolean, rule string, risk_score int, "
    "findings array<struct<detector:string,severity:string,label:string,facet:string>>, taint string, judge string, egress_hosts array<string>, "
    "latency_us bigint, truncated boolean, raw string"
)

# Severities in order, and what each weighs in a risk score.
SEVERITIES = ("info", "low", "medium", "high", "critical")
WEIGHTS = (0.10, 0.30, 0.60, 0.85, 0.98)
# Action classes in order.
ACTION_CLASSES = ("read_only", "side_effecting", "network", "privilege_changing", "destructive")
# Trust in order.
TRUST = ("untrusted", "semi", "trusted")
