"""Work that makes many rows of one is dealt over tasks by the number of rows, not by the splits of a file."""

import pytest
from pyspark.sql import functions as F

from tablegraph.config import GraphSpec
from tablegraph.operators import link, quads, responses, skos
from tablegraph.session import ROWS_PER_TASK, dealt

ROWS = 3 * ROWS_PER_TASK


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.fixture()
def one_split(spark):
    return spark.range(0, ROWS, 1, 1).select("id", F.concat(F.lit("name "), "id").alias("Term"))


def test_dealt_bounds_the_rows_of_a_task(one_split):
    out = dealt(one_split)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == ROWS and max(sizes) <= 1.2 * ROWS_PER_TASK
    assert out.exceptAll(one_split).isEmpty()


def test_dealt_keeps_small_tables_and_takes_any_column(spark):
    small = spark.range(0, 10, 1, 1)
    assert dealt(small).rdd.getNumPartitions() == 1
    maps = spark.range(0, 100, 1, 1).select(F.create_map(F.lit("a"), "id").alias("only`map"))
    assert dealt(maps, 10).count() == 100


def test_rows_are_dealt_before_they_become_statements(spark, one_split, capsys):
    mapping = one_split.select("Term", F.lit("http://x/1").alias("URI"), F.lit("object").alias("RDF Role"),
                               *[F.lit("").alias(c) for c in ("Match Type", "Provider Term", "Provider Description")])
    assert "REPARTITION_BY_NUM" in plan(skos.skos_quads(mapping, "http://g/graph/x", "2024-01-01T00:00:00"), capsys)
    none = spark.createDataFrame([], "Term string, URI string, `RDF Role` string")
    assert "REPARTITION_BY_NUM" in plan(quads.rows_to_quads(
        one_split, none, GraphSpec("http://g/graph/x", "id")), capsys)


def test_no_test_of_a_body_stands_before_the_shuffle(spark, one_split, capsys):
    body = F.concat(F.lit('{"result":{"uids":["'), "id", F.lit('","gone"],"'), "id", F.lit('":{"name":"n"}}}'))
    bodies = dealt(one_split).select(
        F.col("id").alias("term_id"), F.col("Term").alias("term"), F.lit("gene").alias("provider"), body.alias("body"))
    out = responses.summary_suggestions(bodies)
    below = plan(out, capsys).split("REPARTITION_BY_NUM")[1]
    assert "from_json" not in below and "get_json_object" not in below
    assert out.where("rank = 0 and label = 'n'").count() == out.count() == ROWS


def test_entities_are_dealt_before_they_meet_the_terms(spark, one_split, capsys):
    terms = spark.createDataFrame([(1, "name 7")], "term_id int, term string")
    entities = one_split.limit(2 * link.ENTITIES_PER_TASK).coalesce(1).select(
        F.concat(F.lit("u"), "id").alias("uri"), F.col("Term").alias("label"), F.lit("").alias("description"))
    out = link.search_vocabulary(terms, entities, 1)
    assert "REPARTITION_BY_NUM" in plan(out, capsys)
    assert [(r.uri, r.score) for r in out.collect()] == [("u7", 1.0)]
