"""The stages of the pipeline and the queries of the subpackage on the smallest tables."""

import corpus_pipeline
import pytest
import __spark_entry__ as entry
from tallymill.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.checkpoint(stage(spark, docs, SF))
        assert docs.columns == columns, name
        if name != "source_mixing":
            assert docs.count() <= before, name
            assert docs.count() > 0.7 * before, name
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == before
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_take_an_empty_table(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.checkpoint(stage(spark, docs, SF))
        assert docs.count() == 0
