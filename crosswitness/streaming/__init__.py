"""Nothing here keeps state across batches: the checks are batch jobs.

Row-local predicates (:mod:`crosswitness.functions.leaves`, the rule table and the
fractional-visit check) are plain column expressions, so they also run unchanged on a
streaming DataFrame; ``tests/test_rules.py`` holds the proof.
"""
