"""Headline benchmark: every cross-table and derivation check over the derived study.

``load`` derives the study from the source tables, measures group sizes and writes it;
``all_checks`` evaluates the 28 checks and writes the flags, one job per group of checks;
``all_checks_one_job`` evaluates them as one query.  The headline value is their sum, so it
covers the whole way from the source tables to the flags.  The single checks, the
inject-and-detect sweep over all archetypes and the robustness sweep are timed as well.
Prints one JSON line.
"""

import json
import os
import time

from crosswitness.catalog.testbed import build_study, table
from crosswitness.plans.checks import ARCHETYPES, DERIVATIONS, run_checks, write_flags
from crosswitness.plans.differential import all_verdicts, robustness
from crosswitness.session import get_session
from crosswitness.sources.staging import staging_root

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run(df) -> float:
    return timed(lambda: df.write.format("noop").mode("overwrite").save())


def main() -> None:
    spark = get_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    subjects = table(spark, SF_DIR, "customer").count()  # also starts the executors
    root = staging_root(spark)
    holder = {}

    def load() -> None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        built = build_study(spark, SF_DIR, root=f"{root}/bench")
        holder["study"] = built.staged(f"{root}/bench/study", buckets, "bench").measured()

    times = {"load": timed(load)}
    study = holder["study"]
    ids = (*ARCHETYPES, *DERIVATIONS)
    times["all_checks"] = timed(lambda: write_flags(study, f"{root}/bench/flags", ids))
    times["all_checks_one_job"] = run(run_checks(study, ids))
    for i in ids:
        times[i] = run(run_checks(study, [i]))
    times["inject_and_detect"] = run(all_verdicts(study))
    times["robustness"] = timed(lambda: robustness(study).collect())  # a row a perturbation
    total = round(times["load"] + times["all_checks"], 3)
    print(json.dumps({
        "metric": "28 cross-table and derivation checks, source tables to flags", "value": total, "unit": "sec",
        "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "subjects": subjects,
        "subjects_per_sec_end_to_end": round(subjects / total, 1),
        "subjects_per_sec_checks_only": round(subjects / times["all_checks"], 1),
    }))


if __name__ == "__main__":
    main()
