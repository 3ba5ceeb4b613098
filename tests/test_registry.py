"""The registered queries are complete and agree with their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("A01", "A02", "A03", "A07", "A17", "A19", "A20", "S4", "S5", "RULES", "U02", "EV12", "PRJ05", "P05", "AU02", "M03", "INJ-A07")


def test_every_sql_has_a_query_and_most_queries_have_sql():
    optional = {"pipeline", *(entry.llm.queries() if entry.llm else ())}
    q, o = ({k: v for k, v in x.items() if k not in optional} for x in (entry.queries(), entry.oracle_sql()))
    assert set(o) <= set(q) and len(q) >= 200
    assert sorted(set(q) - set(o)) == ["AU-SEAL", "EV05", "EV06", "EV07", "EV09", "EV10", "EV17", "EV17-CO", "SRC11"]


def _plain(df: pd.DataFrame) -> list:
    cell = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    assert _plain(entry.queries()[name](spark, SF).toPandas()) == _plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
