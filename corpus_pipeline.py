"""The pipeline: quality rules, near-duplicate removal, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir), where `docs` is what the stage before it returned, written and read
again. A stage handles odd rows as its operator states: rows without words fail the quality rules; no documents give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from daytrail.llm import mixing, near_dedup, packing, quality
from daytrail.llm.common import stored, table


#: Documents alike by 0.8 are linked; 90 bands of 8 miss such a pair with a probability of 7e-8. The 0.85 is op7's alone.
NEAR = near_dedup.Near(percent=80, bands=90)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules keep."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.distinct_documents(docs, NEAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes, a row for each document and pass over its source."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_stage), ("near_dedup", near_dedup_stage),
          ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage)]

#: Sketches and token ids are not SQL; the tests hold what `run` makes of the kept documents against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
