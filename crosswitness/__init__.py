"""Cross-table contradiction detection for clinical-trial tables on Spark.

The public surface is small: load a :class:`~crosswitness.sources.study.Study`,
validate it with :func:`~crosswitness.plans.validate.validate` or run single checks with
:func:`~crosswitness.plans.checks.run_checks`, and feed the
resulting flags DataFrame to the comparison, audit and detection plans.
"""

from crosswitness.plans.checks import run_checks
from crosswitness.plans.validate import validate
from crosswitness.sources.study import Study, load_study

__all__ = ["Study", "load_study", "run_checks", "validate"]
