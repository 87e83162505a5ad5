import corpus_pipeline as P
from pyspark.sql import functions as F

from tests.llm.helpers import EXTRA, SCHEMA, awkward, empty
from tests.llm.test_ngram_join import brute
from vigil.llm import langid
from vigil.llm.common import Stored


def test_stage_names_and_columns(spark):
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_duplicates", "packing"]
    docs = awkward(spark)
    seen = docs
    for _, stage in P.STAGES[:-1]:
        seen = Stored(stage(spark, seen, ""), "test-stage").df
        assert seen.columns == docs.columns
    rows = seen.collect()
    kept = {r.doc_id for r in rows}
    assert not kept & {1, 2, 3, 13} and {4, 7, 11, 100} <= kept and not kept & {5, 8, 9}
    assert len([r for r in rows if r.doc_id is not None]) == len(kept - {None})
    linked = brute([(r.doc_id, r.text) for r in rows])
    assert all(k == v for k, v in linked.items())
    out = P.STAGES[-1][1](spark, seen, "").collect()
    assert {r.doc_id for r in out} == kept


def test_language_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    report = langid.identify(docs).where((F.col("lang_pred") == "und") | (F.col("score") < P.MIN_LANGUAGE_SCORE)).count()
    assert P.language(spark, docs, "").count() == docs.count() - report


def test_empty_table(spark):
    docs = empty(spark)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_rows_are_removed_not_ids(spark):
    one, two, near = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60)), " ".join(f"a{i}" for i in range(1, 60))
    rows = [(5, one), (5, two), (7, near), (None, one), (None, two), (None, "c d e f g h"), (None, "c d e f g h"), (9, None), (9, ""), (8, two), (5, two), (11, "x y z")]
    df = spark.createDataFrame([(i, t, "en", f"s{k}", 0, *EXTRA) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(4)
    out = P.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(5, one), (5, two), (None, "c d e f g h"), (9, None), (9, ""), (11, "x y z")], key=str)
