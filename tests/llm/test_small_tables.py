"""Empty tables, repeated rows and clashing columns of secret scans and language identification."""

import pytest
from pyspark.sql import functions as F

from graphsig.llm import language_id, secret_scan

DOCS = "doc_id long, text string, lang string"
KEY = "password = hunter22 and AKIA" + "Q7" * 9


@pytest.fixture(scope="module")
def ratios(spark):
    return secret_scan.train(secret_scan.labelled_samples(spark, 200))


def test_secret_scan_of_small_tables(spark, ratios):
    assert secret_scan.scan(spark.createDataFrame([], DOCS), ratios).count() == 0
    rows = [(1, KEY, "en"), (1, KEY, "en"), (2, None, None), (3, "", "en"), (None, KEY, "en")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("mine")).withColumn("start", F.lit(7))
    got = secret_scan.scan(docs, ratios).select("doc_id", "kept", "start", secret_scan.spell(F.col("__base")).alias("s")).collect()
    at = KEY.index("AKIA")
    want = f"assign:0:{len('password = hunter22')},access:{at}:{len(KEY)}"
    assert sorted(((r["doc_id"] or 0), r["s"]) for r in got) == [(0, want), (1, want), (1, want), (2, ""), (3, "")]
    assert {(r["kept"], r["start"]) for r in got} == {("mine", 7)}


def test_language_of_small_tables(spark):
    english, german = "the quick brown fox jumps over the lazy dog " * 5, "der schnelle braune fuchs springt über den faulen hund " * 5
    model = language_id.train(spark.createDataFrame([(english, "en"), (german, "de")], "text string, lang string"))
    assert language_id.identify(spark.createDataFrame([], DOCS), model).count() == 0
    rows = [(1, english, "de"), (1, english, None), (2, german, "en"), (3, None, "en"), (4, "12 34", "en"), (5, "", "en"), (None, german, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit("xx"))
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in language_id.identify(docs, model).collect())
    assert got == [(0, "de"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
