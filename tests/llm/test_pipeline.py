"""The pipeline: every stage on edge cases, its columns, and the registered names."""

import re

import __spark_entry__ as entry_points
import corpus_pipeline
from tests.conftest import SF_SMALL

NAMES = {"pipeline", *[f"op{n}_" for n in range(1, 14)]}


def test_registered():
    known = entry_points.queries()
    assert {re.match(r"op\d+_|pipeline", k)[0] for k in known if re.match(r"op\d+_|pipeline$", k)} == NAMES


def test_stages_on_edge_cases(spark, docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    given, seen = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, given, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        given = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in given.collect()})
    assert seen[0] >= {1, 2, 3, 10, 20, 30, 37} and not seen[0] & {4, 5, 6, 8, 9, 21}
    assert {1, 10, 20} <= seen[1] and not seen[1] & {2, 3}
    assert seen[2] >= {1, 10, 11, 15, 20}


def test_empty_documents(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.columns == ["doc_id", "source", "ids", "n_tokens", "decoded_sha256"]
    assert got.where("n_tokens <> size(ids)").isEmpty() and not got.isEmpty()
