"""Null-safe leaf predicates and the condition-tree compiler.

Every leaf returns TRUE or FALSE, never NULL, so trees can be combined and negated
without three-valued logic leaking out.  NULL means "no value"; the empty string is a
value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswitness.functions.columns import col_or_null


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def non_empty(c: Column) -> Column:
    return c.isNotNull()


def empty(c: Column) -> Column:
    return c.isNull()


def equal_to(c: Column, value) -> Column:
    return c.eqNullSafe(value)


def not_equal_to(c: Column, value) -> Column:
    return ~c.eqNullSafe(value)


def is_contained_by(c: Column, values) -> Column:
    return _known(c.isin(list(values)))


def is_not_contained_by(c: Column, values) -> Column:
    return c.isNotNull() & ~is_contained_by(c, values)


def is_contained_by_ci(c: Column, values) -> Column:
    return is_contained_by(F.upper(c), [v.upper() for v in values])


def is_not_contained_by_ci(c: Column, values) -> Column:
    return c.isNotNull() & ~is_contained_by_ci(c, values)


def longer_than(c: Column, n: int) -> Column:
    return _known(F.length(c) > n)


def less_than(c: Column, n) -> Column:
    return _known(c < n)


def matches_regex(c: Column, pattern: str) -> Column:
    return _known(c.rlike(pattern))


def not_matches_regex(c: Column, pattern: str) -> Column:
    return c.isNotNull() & ~matches_regex(c, pattern)


def date_greater_than(c: Column, other: Column) -> Column:
    """Both present and ``c`` is not strictly before ``other``."""
    return c.isNotNull() & other.isNotNull() & ~_known(c < other)


LEAVES = {
    "non_empty": non_empty,
    "exists": non_empty,
    "empty": empty,
    "not_exists": empty,
    "equal_to": equal_to,
    "not_equal_to": not_equal_to,
    "is_contained_by": is_contained_by,
    "is_not_contained_by": is_not_contained_by,
    "is_contained_by_case_insensitive": is_contained_by_ci,
    "is_not_contained_by_case_insensitive": is_not_contained_by_ci,
    "longer_than": longer_than,
    "less_than": less_than,
    "matches_regex": matches_regex,
    "not_matches_regex": not_matches_regex,
    "date_greater_than": date_greater_than,
}


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def compile_tree(tree: dict, df: DataFrame, literal_compat: bool = False) -> Column:
    """Turn ``{"all"|"any"|"not": ...}`` / ``{"op", "col", ...}`` into one Column.

    A leaf with ``other`` compares with another column; with ``literal_compat`` that
    column *name* is compared as a text constant instead.
    """
    if "all" in tree:
        return all_of([compile_tree(t, df, literal_compat) for t in tree["all"]])
    if "any" in tree:
        return any_of([compile_tree(t, df, literal_compat) for t in tree["any"]])
    if "not" in tree:
        return ~compile_tree(tree["not"], df, literal_compat)
    c = col_or_null(df, tree["col"])
    leaf = LEAVES[tree["op"]]
    if "other" in tree:
        frozen = literal_compat and tree.get("frozen", False)
        rhs = F.lit(tree["other"]) if frozen else col_or_null(df, tree["other"])
        return leaf(c, rhs)
    if "value" in tree:
        value = tree["value"]
        if isinstance(value, (int, float)) and tree["op"] in ("equal_to", "not_equal_to", "less_than"):
            return leaf(c.try_cast("double"), float(value))
        return leaf(c, value)
    return leaf(c)
