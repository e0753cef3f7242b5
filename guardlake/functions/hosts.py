"""Hosts, allow-lists, URLs and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.functions.hof import case, let

# URL with its host in group 2, and user@host: of a copy command with its host in group 1.
URL_PATTERN = r"(?i)\b[a-z][a-z0-9+.-]*://([a-z0-9._~%-]+(?::[a-z0-9._~%-]+)?@)?(\[[0-9a-f:]+\]|[a-z0-9.-]+)"
SCP_PATTERN = r"(?i)\b[a-z0-9._-]+@([a-z0-9-]+(?:\.[a-z0-9-]+)+):"


def _bare(host: Column) -> Column:
    return F.lower(F.regexp_replace(host, r"\.+\z", ""))


def hosts(args_text: Column) -> Column:
    """Sorted distinct hosts that the text names; brackets of IPv6 addresses off."""
    urls = F.transform(F.regexp_extract_all(args_text, F.lit(URL_PATTERN), 2), lambda h: F.when(h.startswith("["), F.lower(F.translate(h, "[]", ""))).otherwise(_bare(h)))
    copies = F.filter(F.transform(F.regexp_extract_all(args_text, F.lit(SCP_PATTERN), 1), _bare), lambda h: F.contains(h, F.lit(".")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(urls, copies), lambda h: h != "")))


def is_allowed(host: Column, allowed: list[str]) -> Column:
    """The host is on the list, or below a name on it."""
    clean = _bare(F.trim(host))
    names = [a.strip().rstrip(".").lower() for a in allowed]
    out = F.lit(False)
    for name in names:
        out = out | (clean == name) | clean.endswith(f".{name}")
    return out


def unlisted(found: Column, allowed: list[str]) -> Column:
    return F.filter(found, lambda h: ~is_allowed(h, allowed))


def host_of(url: Column) -> Column:
    """Host of a URL, lower case; null if there is none."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    authority = F.regexp_replace(rest, r"(?s)[/?#].*$", "")
    host = F.lower(F.substring_index(F.substring_index(authority, "@", -1), ":", 1))
    return F.when(host != "", host)


def resolve(path: Column) -> Column:
    """Components of a path with `.` and `..` resolved; a leading root counts as one component."""
    root = F.when(path.startswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))

    def step(acc: Column, part: Column) -> Column:
        up = F.when((F.size(acc) > 0) & ~((F.size(acc) == 1) & (acc[0] == "/")), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.array_append(acc, part))

    return F.aggregate(F.split(path, "/"), root, step)


def is_inside(path: Column, root: Column) -> Column:
    """The path, resolved without looking at any file system, lies at or below the root."""
    return let(resolve(root), lambda r: F.slice(resolve(path), 1, F.greatest(F.size(r), F.lit(1))) == r) | (F.size(resolve(root)) == 0)


# Tools by what their result comes from.
NETWORK_TOOLS = ("WebFetch", "WebSearch")
PATH_TOOLS = ("Read", "Grep", "Glob", "NotebookRead")


def provenance(tool: Column, args: Column, cwd: Column) -> Column:
    """(origin, host, name) of a tool's result; args is JSON text."""

    def of(origin: str, host: Column | None = None, name: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(origin).alias("origin"), (none if host is None else host).alias("host"), (none if name is None else name).alias("name"))

    server = F.regexp_extract(tool, r"(?s)^mcp__(.*?)(__.*)?$", 1)
    host = F.coalesce(host_of(F.get_json_object(args, "$.url")), F.lit("unknown"))
    path = F.coalesce(*[F.get_json_object(args, f"$.{k}") for k in ("file_path", "path", "notebook_path")])
    full = F.when(path.startswith("/"), path).otherwise(F.concat(cwd, F.lit("/"), path))
    known = tool.isin(*PATH_TOOLS) & path.isNotNull() & cwd.isNotNull()
    return case(
        [
            (server != "", of("mcp_server", name=server)),
            (tool.isin(*NETWORK_TOOLS), of("network", host=host)),
            (known & is_inside(full, cwd), of("local_project")),
        ],
        of("local_system"),
    )


def trust(origin: Column) -> Column:
    """0 untrusted, 1 semi, 2 trusted."""
    return F.when(origin.isin("user_prompt"), 2).when(origin.isin("local_project", "local_system"), 1).otherwise(0).cast("tinyint")


def provenance_label(source: Column) -> Column:
    """user, project, system, network:host, mcp:name or subagent:name."""
    origin = source["origin"]
    short = F.regexp_replace(F.regexp_replace(origin, "^(user|mcp)_.*$", "$1"), "^local_", "")
    return F.concat_ws(":", short, F.coalesce(source["host"], source["name"]))
