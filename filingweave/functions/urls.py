"""Hosts, crawl rules and cache names."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def host_key(url: Column | str) -> Column:
    """`scheme://host[:port]` in lower case without default ports and user names; '' for anything but http(s)."""
    u = F.col(url) if isinstance(url, str) else url
    scheme = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(u, F.lit("HOST")))
    port = F.regexp_extract(F.regexp_replace(F.try_parse_url(u, F.lit("AUTHORITY")), "^.*@", ""), r":(\d+)$", 1)
    default = F.when(scheme == "https", "443").otherwise("80")
    shown = F.when((port == "") | port.isNull() | (port == default), "").otherwise(F.concat(F.lit(":"), port))
    ok = scheme.isin("http", "https") & (host != "") & ((port == "") | port.isNull() | (port.try_cast("int") <= 65535))
    return F.when(ok, F.concat(scheme, F.lit("://"), host, shown)).otherwise("")


def cache_name(url: Column | str) -> Column:
    """A file name for a response: host, hash of the url, tail of the path; unusual characters as '_'."""
    u = F.col(url) if isinstance(url, str) else url
    clean = lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}_.\-]", "_")
    host = F.substring(clean(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("local"))), 1, 40)
    tail = clean(F.substring_index(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/", -1))
    return F.concat_ws("_", host, F.substring(F.sha2(u, 256), 1, 12), F.coalesce(F.nullif(F.right(tail, F.lit(80)), F.lit("")), F.lit("index")))


def disallowed(robots: str, agent: str) -> list[str]:
    """Regular expressions of the Disallow rules that bind an agent: those of the groups that name it and of '*'."""
    groups: list[tuple[list[str], list[str]]] = []
    fresh = True
    for raw in robots.splitlines():
        key, _, value = raw.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if fresh or not groups or groups[-1][1]:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            fresh = False
        elif key == "disallow" and groups and value:
            groups[-1][1].append(value)
    own = [g for g in groups if any(a == "*" or (a and a in agent.lower()) for a in g[0])]
    rules = []
    for _, paths in own:
        for path in paths:
            end = "$" if path.endswith("$") else ""
            rules.append("^" + ".*".join(re.escape(p) for p in path.removesuffix("$").split("*")) + end)
    return rules


def allowed(path: Column, rules: list[str]) -> Column:
    """Whether no rule forbids a path."""
    out = F.lit(True)
    for rule in rules:
        out = out & ~path.rlike(rule)
    return out


def resolve(base: str):
    """A vectorised function that resolves relative urls against `base`."""

    @F.pandas_udf("string")
    def joined(url: pd.Series) -> pd.Series:
        return url.map(lambda u: urljoin(base, u) if isinstance(u, str) else None)

    return joined
