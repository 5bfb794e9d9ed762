import pytest

from strophe.llm import queries
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark, sf_dir, duck):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    sql = queries.oracle_sql().get(name)
    if sql:
        assert rows_of(got) == rows_of(duck.sql(sql).df())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, sf_dir).cache()
        if name != "packing":
            assert sorted(out.columns) == sorted(docs.columns) and 0 < out.count() <= left.count()
            left = out
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in left.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf_dir).agg({"length": "sum"}).first()[0] == out.agg({"length": "sum"}).first()[0]
