"""Registered queries of the pipeline operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattline.functions.ship import ship_package

from .bpe import op8_bpe_encoding
from .langid import op10_language_id
from .ngram_join import op9_ngram_jaccard_join
from .ordinal import op3_quality_classifier
from .packing import op1_packing
from .ppm import op5_ppm_scores
from .rules import OP7_SQL, op7_quality_rules
from .urlfilter import op6_sql, op6_url_filter
from .vptree import op4_vantage_point_search
from .warc import OP2_SQL, op2_warc_index


def _with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (op1_packing, op2_warc_index, op3_quality_classifier, op4_vantage_point_search, op5_ppm_scores, op6_url_filter, op7_quality_rules, op8_bpe_encoding, op9_ngram_jaccard_join, op10_language_id)
    return {query.__name__: _with_package(query) for query in listed}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_index": OP2_SQL, "op6_url_filter": op6_sql(), "op7_quality_rules": OP7_SQL}
