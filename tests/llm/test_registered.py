"""The registered queries: against DuckDB where they have SQL, else for whole rows; and the pipeline's stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from checks.compare import compare
from daytrail.llm import queries
from daytrail.llm.common import stored


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(name, spark, small, duck):
    assert compare(queries.QUERIES[name](spark, small), duck, queries.ORACLES[name]) == []


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), name)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] > 0
    assert docs.agg({"offset": "min"}).first()[0] == 0
