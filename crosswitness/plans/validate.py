"""One call that validates a study: single-table rules, cross-table checks and the lookup, one flag table, log and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswitness.plans.audit import to_traces
from crosswitness.plans.checks import ARCHETYPES, DERIVATIONS, run_checks
from crosswitness.plans.flagsets import family, summary, union_flags
from crosswitness.plans.rules import single_table_rules
from crosswitness.sources.sinks import append_traces
from crosswitness.sources.study import Study

#: Flags that agree in these columns are one flag.
IDENTITY = ("subject", "visit", "layer", "archetype", "rule_id", "domain", "record_id", "severity")


@dataclass(frozen=True)
class Validation:
    """``flags`` without repeats; ``counts`` per rule family."""

    flags: DataFrame

    @property
    def counts(self) -> DataFrame:
        return summary(self.flags.withColumn("family", family(F.col("rule_id"))), "family")

    def log(self, path: str, run_id: str, run_time: str) -> DataFrame:
        """Append the flags to the trace log of ``path``; returns the traces refused as known."""
        return append_traces(to_traces(self.flags, run_time), path, run_id)


def validate(study: Study, ids: tuple[str, ...] = (*ARCHETYPES, *DERIVATIONS), lookup_grain: str = "record",
             include_disabled: bool = False, literal_compat: bool = False) -> Validation:
    """All enabled rules and the named checks over one study; nothing is computed before the result is used."""
    rules = single_table_rules(study, include_disabled=include_disabled, literal_compat=literal_compat)
    return Validation(union_flags(rules, run_checks(study, ids, lookup_grain)).dropDuplicates(list(IDENTITY)))
