"""The registered queries: complete, and equal to their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAMPLE = ["matching_table", "generate_ids", "prefill_best", "resolve_cascade", "skos_quads",
          "group_nodes", "publication_quads", "graph_statistics", "label_contains", "trig_blocks"]


def test_entry_and_names(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["g", "s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang"]
    assert not df.isEmpty()
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(entry_points.queries()) > 90


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    cursor = con.execute(entry_points.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted(str(r) for r in cursor.fetchall())
    df = entry_points.queries()[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(names)
    quoted = [f"`{n}`" for n in names]
    assert sorted(str(tuple(r)) for r in df.select(*quoted).collect()) == want
