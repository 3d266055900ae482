"""Prefix catalogues: ``namespace, prefix, ord``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "namespace string, prefix string, ord long"
_LINE = r"(?i)^\s*(?:@prefix|PREFIX)\s+([\w\-]+):\s+<([^>]+)>"


def prefixes_from_lines(lines: DataFrame) -> DataFrame:
    """Catalogue from ``(ord, value)`` text lines; a repeated pair keeps its first place."""
    return (
        lines.filter(F.col("value").rlike(_LINE))
        .groupBy(
            F.trim(F.regexp_extract("value", _LINE, 2)).alias("namespace"),
            F.regexp_extract("value", _LINE, 1).alias("prefix"),
        )
        .agg(F.min("ord").cast("long").alias("ord"))
    )


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue from a file of prefix lines; a missing file is an empty catalogue."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    return prefixes_from_lines(lines.withColumn("ord", F.monotonically_increasing_id()))


def merge_prefix_overrides(catalogue: DataFrame, extra: dict[str, list[str]]) -> DataFrame:
    """Catalogue plus configured prefixes; a pair that is already there keeps its order."""
    rows = [(ns, p, 1 << 62 | i) for ns, ps in extra.items() for i, p in enumerate(ps)]
    more = catalogue.sparkSession.createDataFrame(rows, SCHEMA)
    return (
        catalogue.unionByName(more).groupBy("namespace", "prefix").agg(F.min("ord").alias("ord"))
    )
