import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from crosswitness.session import get_session

    session = get_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # many tiny queries: compiling each costs more than running it
    return session


@pytest.fixture(scope="session")
def study(spark):
    from crosswitness.catalog.testbed import study as make

    return make(spark, SF)


@pytest.fixture()
def make_study(spark):
    """Study from {domain: (ddl, rows)}."""
    from crosswitness.sources.study import Study

    def build(**tables):
        return Study(spark, {d: spark.createDataFrame(rows, ddl) for d, (ddl, rows) in tables.items()})

    return build


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
