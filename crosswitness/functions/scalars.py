"""Scalar helpers over columns: dates, identifiers, code maps, normalisation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_date(c: Column) -> Column:
    """DATE of an ISO text that carries at least year, month and day; else NULL."""
    return F.when(F.length(c) >= 10, F.substring(c, 1, 10).try_cast("date"))


def day_gap(later: Column, earlier: Column) -> Column:
    """Calendar days from ``earlier`` to ``later`` (both ISO text)."""
    return F.datediff(full_date(later), full_date(earlier))


def iso_text(day: Column) -> Column:
    """ISO text of a date; years beyond 9999 come without Spark's leading plus."""
    return F.ltrim(day.cast("string"), F.lit("+"))


def shift_days(c: Column, days: int) -> Column:
    """ISO text moved by whole days."""
    return iso_text(F.date_add(full_date(c), days))


def from_offset(offset: Column, anchor: dt.date) -> Column:
    """ISO date of ``anchor`` plus a day offset; the empty string when unknown."""
    return F.coalesce(
        iso_text(F.date_add(F.lit(anchor), offset.try_cast("double").cast("int"))), F.lit("")
    )


def subject_id(study_id: str, raw: Column) -> Column:
    """``study-n`` for numeric subject numbers, else ``study-<text>``."""
    number = raw.try_cast("double").cast("bigint").cast("string")
    return F.concat_ws("-", F.lit(study_id), F.coalesce(number, F.trim(raw.cast("string"))))


def arm_code(label: Column) -> Column:
    """First eight characters of the label, upper-cased, blanks removed."""
    return F.replace(F.upper(F.left(F.coalesce(label, F.lit("")), F.lit(8))), F.lit(" "), F.lit(""))


def blank(c: Column) -> Column:
    """Trimmed text, NULL as the empty string."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def is_target_lesion(lesion: Column) -> Column:
    up = F.upper(lesion)
    return up.startswith("T") & ~up.startswith("NT")


def code_map(c: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Value looked up in a small fixed map."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in mapping.items():
        out = out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def tumour_state(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(low.contains("disappeared"), "ABSENT")
        .when(low.contains("cannot be seen"), "NOT EVALUABLE")
        .otherwise("PRESENT")
    )


def norm_response(c: Column) -> Column:
    """Trimmed, upper-cased response with yes/no and non-target spellings unified."""
    up = F.upper(F.trim(c))
    return (
        F.when(up.isin("NON-CR/NON-PD", "NON-CR NON-PD"), "NON-CR/NON-PD")
        .when(up.isin("N", "NO", "FALSE"), "NO")
        .when(up.isin("Y", "YES", "TRUE"), "YES")
        .otherwise(up)
    )


def norm_target(c: Column) -> Column:
    """As :func:`norm_response`, with the non-target-only category read as SD."""
    n = norm_response(c)
    return F.when(n == "NON-CR/NON-PD", "SD").otherwise(n)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object of the fields in sorted key order; NULL is ``null``, and numbers and texts stay apart."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


MICRO = 1_000_000


def micro(value: Column) -> Column:
    """A measurement as a whole number of millionths, so that sums and thresholds are exact; NaN is no value."""
    return F.round(value * MICRO).try_cast("bigint")


def exact_sum(value: Column) -> Column:
    """Sum of measurements that does not depend on the order of the rows: the double nearest to the decimal sum."""
    return F.sum(micro(value)) / F.lit(float(MICRO))
