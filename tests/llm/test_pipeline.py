"""The pipeline on odd rows, and against its operators run one after the other."""

import corpus_pipeline
import pytest

from tallyloom.llm import simhash
from tallyloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    docs = table(spark, SF, "documents").limit(40)
    rows = [(None, "no id here", None, None, None), (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34", "en", "s", 5)]
    more = spark.createDataFrame(rows, docs.schema)
    return docs.unionByName(more).unionByName(docs.limit(3)).selectExpr("*", "1 as part", "'x' as score")


def test_stages_keep_columns_and_take_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert 0 < out.count() <= odd.count()
        assert stage(spark, odd.limit(0), SF).count() == 0
    _, last = corpus_pipeline.STAGES[-1]
    assert last(spark, odd, SF).where("piece = 0").count() == odd.count()


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    kept = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in got.collect()} == kept
    # No two near copies are left, and clean documents are.
    left = simhash.classes(docs)
    assert left.where("doc_id <> component_id").count() == 0
    clean = table(spark, SF, "documents").join(table(spark, SF, "labels").where("toxic = 0 and quality = 1"), "doc_id")
    names = {r["doc_id"]: r["component_id"] for r in simhash.classes(table(spark, SF, "documents")).collect()}
    firsts = [r["doc_id"] for r in clean.select("doc_id").collect() if names[r["doc_id"]] == r["doc_id"]]
    assert sum(i in kept for i in firsts) >= 0.8 * len(firsts)
