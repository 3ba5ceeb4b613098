"""Registered queries over the supplied tables, each with its SQL counterpart."""

from crosswitness.catalog import check_queries, detection_queries, flag_queries, injection_queries, job_queries, relational_queries, rule_queries

MODULES = (check_queries, rule_queries, flag_queries, relational_queries, job_queries, injection_queries, detection_queries)
