"""From raw documents to packed training sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next stage's ``docs``. All stages but the last return
the columns of ``documents``:

1. language ID drops documents without a determinable language;
2. the quality classifier drops documents that are probably toxic or poor;
3. the n-gram Jaccard join keeps one document of each group of similar texts;
4. packing returns the pieces of all remaining documents in token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.functions.ship import ship_package
from wattline.llm._common import saved, work_folder
from wattline.llm.langid import language_stage
from wattline.llm.ngram_join import near_duplicate_stage
from wattline.llm.ordinal import quality_stage
from wattline.llm.packing import packing_stage


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES = [
    ("language ID", _shipped(language_stage)),
    ("quality classifier", _shipped(quality_stage)),
    ("n-gram Jaccard join", _shipped(near_duplicate_stage)),
    ("packing", _shipped(packing_stage)),
]

#: Trained models and a tokenizer decide here; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = saved(spark, stage(spark, docs, sf_dir), f"{folder}/stage{i}")
    return docs
