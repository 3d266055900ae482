"""Graphs back to tables: read, view, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegraph.operators import table_view
from tablegraph.sinks import text as out
from tablegraph.sources.nquads import read_nquads


def load_quads(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed quads of line files."""
    return read_nquads(spark, path).filter("_corrupt IS NULL").drop("_corrupt")


def export_table(quads: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Write the linked table, the property mapping and the report under a folder as CSV."""
    out.write_csv(table_view.link_table(quads), f"{folder}/table", mode)
    out.write_csv(table_view.property_mapping_table(quads), f"{folder}/properties", mode)
    out.write_csv(table_view.metadata_report(quads), f"{folder}/report", mode)


def write_quads_table(quads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by graph role, so a read of the data graphs never opens the metadata files."""
    from pyspark.sql import functions as F

    role = F.when(table_view.is_metadata_graph(), "metadata").otherwise("data")
    quads.withColumn("g_role", role).write.mode(mode).partitionBy("g_role").parquet(path)
