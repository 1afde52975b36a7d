"""The pipeline and the registered queries on the smallest tables."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def registered():
    import __spark_entry__ as entry

    return entry.queries(), entry.oracle_sql()


def test_ten_operators_and_the_pipeline(registered):
    names = registered[0]
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_warc_index", "op6_url_filter", "op7_quality_rules"])
def test_query_equals_its_sql(spark, registered, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    frame = registered[0][name](spark, SF)
    columns = sorted(frame.columns)
    result = connection.execute(registered[1][name])
    given = [c[0] for c in result.description]
    expected = sorted((tuple(r[given.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == expected and sorted(given) == columns


def test_columns_of_the_contracts(spark, registered):
    wanted = {
        "op1_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op3_quality_classifier": {"doc_id", "expected_grade", "tail_probability", "kept"},
        "op4_vantage_point_search": {"query_id", "rank", "vec_id", "score"},
        "op5_ppm_scores": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op8_bpe_encoding": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op9_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"},
        "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    }
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, columns in wanted.items():
        frame = registered[0][name](spark, SF)
        assert columns <= set(frame.columns)
        if name not in ("op1_packing", "op4_vantage_point_search"):
            assert frame.count() == n


def test_default_search_has_full_recall_here(spark, registered):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    data, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
    found = registered[0]["op4_vantage_point_search"](spark, SF).toPandas()
    hits = []
    for q, part in found.groupby("query_id"):
        away = np.sqrt(((data - data[ids == q][0]) ** 2).sum(1))
        away[ids == q] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, away))[:10]]) & set(part["vec_id"])) / 10)
    assert np.mean(hits) >= 0.9


def test_stages_keep_columns_and_the_last_packs_the_rest(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.persist()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    whole = pipeline.run(spark, SF)
    assert whole.select("doc_id").distinct().count() == counts[-1]
    spans = whole.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert spans.where("n <> t").count() == 0


def test_stages_on_empty_and_awkward_documents(spark):
    import corpus_pipeline as pipeline

    from .frames import AWKWARD, documents

    for docs in (documents(spark, AWKWARD), documents(spark, AWKWARD).where("false")):
        for _, stage in pipeline.STAGES:
            stage(spark, docs, SF).collect()
