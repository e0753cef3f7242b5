"""DuckDB SQL for the detectors, scores and policies: generated from the same rule tables, written independently
of the Spark expressions."""

from __future__ import annotations

from guardlake.operators import actions
from guardlake.operators.detect import DELIMITERS, ENTROPY_GATE, IMPERATIVES, INJECTION_RULES, LONG_BASE64, OUTPUT_RULES, PII_RULES, SECRET_RULES, Rule
from guardlake.plans.policy import Policy
from guardlake.schema import SEVERITIES, WEIGHTS

OWASP = {"injection": "LLM01:2025 Prompt Injection", "secret": "LLM02:2025 Sensitive Information Disclosure", "pii": "LLM02:2025 Sensitive Information Disclosure", "output": "LLM05:2025 Improper Output Handling"}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LUHN = """(length(regexp_replace(m, '[^0-9]', '', 'g')) between 13 and 19 and list_sum(list_transform(range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1),
  lambda i: case when i % 2 = 1 then reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i]::int else (2 * reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i]::int) - 9 * (reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i]::int > 4)::int end)) % 10 = 0)"""


def matches(rule: Rule, text: str = "text", direction: str = "direction") -> str:
    """List of a rule's matches."""
    out = f"regexp_extract_all({text}, {quote(rule.pattern)})"
    if rule.gate == "luhn":
        out = f"list_filter({out}, lambda m: {LUHN})"
    elif rule.gate == "entropy":
        out = f"list_filter({out}, lambda m: list_aggregate(string_split(m, ''), 'entropy') >= {ENTROPY_GATE})"
    if rule.first_only:
        out = f"{out}[1:1]"
    if rule.output_only:
        out = f"case when {direction} = 'output' then {out} else [] end"
    return out


#: Rules in the order their findings come, None standing for the heuristics.
ORDER: tuple[Rule | None, ...] = (*INJECTION_RULES, None, *PII_RULES, *SECRET_RULES, *OUTPUT_RULES)


def heuristic(text: str = "text") -> str:
    marks = " + ".join(f"((length({text}) - length(replace({text}, '{m}', ''))) / {len(m)})::int" for m in DELIMITERS)
    return (
        f"least((0.3::float * least(len(regexp_extract_all({text}, {quote(IMPERATIVES)})), 3)::float + case when regexp_matches({text}, {quote(LONG_BASE64)}) then 0.3::float else 0::float end)"
        f" + 0.1::float * least({marks}, 3)::float, 1::float)"
    )


def scan(source: str, keys: str) -> str:
    """CTE `found`: keys, direction, n0..nk (matches of each rule) and h (heuristic score) over a source with text and
    direction."""
    counts = ", ".join(f"len({matches(r)}) as n{i}" for i, r in enumerate(ORDER) if r)
    return f"found as (select {keys}, direction, {counts}, {heuristic()} as h from (select * replace (coalesce(text, '') as text) from {source}))"


def h_on() -> str:
    return "(h >= 0.3::float)"


def n_findings() -> str:
    return " + ".join([*(f"n{i}" for i, r in enumerate(ORDER) if r), f"{h_on()}::int"])


def score() -> str:
    parts = []
    for i, r in enumerate(ORDER):
        if r is None:
            level = f"case when h >= 0.75::float then {WEIGHTS[3]}::float when h >= 0.5::float then {WEIGHTS[2]}::float else {WEIGHTS[1]}::float end"
            parts.append(f"case when {h_on()} then [({level} * h)::float] else []::float[] end")
        else:
            w = WEIGHTS[SEVERITIES.index(r.severity)]
            parts.append(f"list_transform(range(n{i}), lambda x: ({w}::float * {r.confidence}::float)::float)")
    every = "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])
    return f"round((1::float - list_reduce({every}, lambda a, c: (a * (1::float - c))::float, 1::float)) * 100::float)::int"


def has(prefix: str, min_severity: str = "info") -> str:
    """Whether some finding has the detector prefix and severity."""
    low, tests = SEVERITIES.index(min_severity), []
    for i, r in enumerate(ORDER):
        if r is None:
            if prefix == "injection":
                floor = {3: 0.75, 2: 0.5}.get(low, 0.3)
                tests.append(f"h >= {floor}::float" if low <= 3 else "false")
        elif (r.detector == prefix or r.detector.startswith(prefix + ".")) and SEVERITIES.index(r.severity) >= low:
            tests.append(f"n{i} > 0")
    return "(" + (" or ".join(tests) or "false") + ")"


def decision(policy: Policy, field: str) -> str:
    """CASE of a text policy over `found` with score; field: action or name."""
    out = []
    for r in policy.rules:
        tests = []
        if "direction" in r.when:
            tests.append(f"direction = '{r.when['direction']}'")
        if "risk_score_gte" in r.when:
            tests.append(f"score >= {r.when['risk_score_gte']}")
        if "detector" in r.when:
            tests.append(has(r.when["detector"], r.when.get("min_severity", "info")))
        out.append(f"when {' and '.join(tests) or 'true'} then {quote(r.action if field == 'action' else r.name)}")
    return f"case {' '.join(out)} else {quote(policy.default) if field == 'action' else 'null'} end"


def _counts(key_of) -> str:
    """Rows (key, n, texts) of `found`: findings, and texts with any, for each key of the rules' detectors."""
    groups: dict[str, list[str]] = {}
    for i, r in enumerate(ORDER):
        groups.setdefault(key_of("injection" if r is None else r.detector), []).append(f"{h_on()}::int" if r is None else f"n{i}")
    rows = [f"select {quote(k)} as key, sum({' + '.join(ns)})::bigint as n, count(*) filter (where {' + '.join(ns)} > 0) as texts from found" for k, ns in groups.items()]
    return " union all ".join(rows)


def by_detector() -> str:
    return _counts(lambda d: d)


def by_owasp() -> str:
    return _counts(lambda d: OWASP[d.split(".")[0]])


def any_of(text: str, patterns: tuple[str, ...]) -> str:
    return f"regexp_matches({text}, {quote('(?i)' + '|'.join(patterns))})"


def action_class(text: str, base: str = "0") -> str:
    """Ordinal of a call's class; base: that of its tool."""
    acting = f"greatest({base}, case when {any_of(text, actions.WRITE)} then 1 else 0 end, case when {any_of(text, actions.NETWORK)} then 2 else 0 end)"
    raised = f"case when {any_of(text, actions.PRIVILEGE)} or ({acting} >= 1 and {any_of(text, actions.SENSITIVE)}) then 3 else 0 end"
    return f"greatest({acting}, {raised}, case when {any_of(text, actions.DESTRUCTIVE)} then 4 else 0 end)"


def unlisted(host: str, allowed: tuple[str, ...]) -> str:
    names = [a.strip().rstrip(".").lower() for a in allowed]
    return f"({host} <> '' and not ({' or '.join(f'{host} = {quote(a)} or {host} like {quote(chr(37) + chr(46) + a)}' for a in names)}))"


def agent_decision(policy: Policy, field: str) -> str:
    """CASE of an agent policy over `found` with kind, origin (of the taint, null without), cls, unlisted and sensitive.
    Rules that ask for subagents or manifests match no row here."""
    facet = {"tool_args": "tool_call", "tool_result": "tool_result"}
    origins = {"network": "network", "mcp": "mcp_server", "subagent": "subagent"}
    out = []
    for r in policy.rules:
        w, tests = r.when, []
        if w.keys() & {"subagent_escalation", "mcp_manifest_changed", "mcp_tool_shadow"} or w.get("facet") == "tool_description":
            continue
        if "detector" in w:
            tests.append(has(w["detector"], w.get("min_severity", "info")))
        if "facet" in w:
            tests.append(f"kind = '{facet[w['facet']]}'")
        if "taint" in w:
            tests.append(f"origin in ({', '.join(quote(origins[t]) for t in w['taint'])})")
        if "action_class" in w:
            tests.append(f"cls = {actions.ACTION_CLASSES.index(w['action_class'])}")
        if "min_action_class" in w:
            tests.append(f"cls >= {actions.ACTION_CLASSES.index(w['min_action_class'])}")
        if w.get("egress_not_allowlisted"):
            tests.append("unlisted")
        if "touches_sensitive_path" in w:
            tests.append(f"sensitive = {str(w['touches_sensitive_path']).lower()}")
        value = {"action": r.action, "name": r.name, "fallback": r.fallback}[field]
        out.append(f"when {' and '.join(f'coalesce({t}, false)' for t in tests) or 'true'} then {quote(value) if value else 'null'}")
    return f"case {' '.join(out)} else {quote(policy.default) if field == 'action' else 'null'} end"
