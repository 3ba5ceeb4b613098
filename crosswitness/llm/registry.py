"""Queries of this subpackage and their SQL counterparts."""

from crosswitness.llm import byte_bpe, collocations, decontaminate, exact_dedup, katz, line_dedup, near_dedup, periodic_runs, quality, secret_scan, suffix_dedup, toxicity, url_filter

MODULES = (exact_dedup, decontaminate, quality, near_dedup, url_filter, suffix_dedup, toxicity, byte_bpe, secret_scan, line_dedup, periodic_runs, katz, collocations)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
