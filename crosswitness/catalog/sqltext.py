"""Small helpers over the comparison SQL."""

from __future__ import annotations

import re


def bigint_counts(sql: str) -> str:
    """Give every conditional count a 64-bit type, as Spark's has."""
    out, rest = "", sql
    while True:
        at = rest.find("count_if(")
        if at < 0:
            return out + rest
        depth, end = 0, at + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
            if depth == 0:
                break
        inner = bigint_counts(rest[at + len("count_if("):end - 1])
        out += rest[:at] + f"CAST(count(*) FILTER (WHERE {inner}) AS BIGINT)"
        rest = rest[end:]


def stored(sql: str) -> str:
    """Every shared part is computed once."""
    return re.sub(r"\b(\w+) AS \(\s*SELECT", r"\1 AS MATERIALIZED (SELECT", sql)
