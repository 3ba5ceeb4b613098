"""The digest index over reopenings and repeated batches; hand labels of single runs of a token."""

import hashlib

from test_operators import DDL

from crosswitness.llm import exact_dedup, secret_scan


def texts(spark, n, start=0):
    return spark.createDataFrame([(i, f"text {i - start}") for i in range(start, start + n)], "doc_id long, text string")


def kept(spark, path, batch, name, buckets=None):
    return sum(r.kept for r in exact_dedup.DigestIndex(spark, path, buckets).ingest(batch, name).collect())


def test_reopened_with_another_bucket_count(spark, tmp_path):
    path = str(tmp_path / "index")
    assert kept(spark, path, texts(spark, 200), "one", 8) == 200
    spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path).name}")  # the files stay
    assert exact_dedup.DigestIndex(spark, path, 4).buckets == 8
    assert kept(spark, path, texts(spark, 200, 1000), "two", 4) == 0
    assert exact_dedup.DigestIndex(spark, path).table().count() == 200


def test_the_same_rows_again(spark, tmp_path):
    path = str(tmp_path / "index")
    assert kept(spark, path, texts(spark, 50), "one", 4) == 50
    assert kept(spark, path, texts(spark, 50), "two", 4) == 0  # same ids, same places, another batch
    assert kept(spark, path, texts(spark, 50), "one", 4) == 50  # a repeated run of the first batch
    assert exact_dedup.DigestIndex(spark, path).table().count() == 50


def test_a_label_is_about_one_run_of_a_token(spark):
    key = "AKIA" + hashlib.sha1(b"k").hexdigest()[:16].upper()
    docs = spark.createDataFrame([(1, '{"id":"user-0000000001","secret":"%s"}' % key, "en", "s", 1)], DDL)
    found = {r.value: r for r in secret_scan.findings(docs).collect()}
    label = spark.createDataFrame([(1, found[key].place, found[key].part, 1)], "doc_id long, place int, part int, label int")
    got = {r.value: r.label for r in secret_scan.scanned(spark, docs, label).collect()}
    assert got[key] == 1 and [v for k, v in got.items() if k != key] == [None]
