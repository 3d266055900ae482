"""Which columns are numeric, dates or ids; which column names belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraph.functions.text import column_words, py_strip
from tablegraph.functions.values import is_bool_like, is_date_like, is_numeric_like


# What values of a native column type are, whatever the value; None means: test each value.
_NUMBERS = {"byte", "short", "integer", "long", "float", "double", "decimal"}


def native_kind(data_type) -> str | None:
    name = data_type.typeName()
    if name in _NUMBERS:
        return "number"
    if name == "boolean":
        return "boolean"
    return "date" if name in ("date", "timestamp", "timestamp_ntz") else None


def _columns_where(df: DataFrame, kind: str, test) -> DataFrame:
    """``column`` rows whose every non-blank value passes, with at least one value.

    One scan: each column folds into a single boolean, null when it has no value. A column with
    a native type needs no look at its values beyond whether there is one.
    """
    folded = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        native = native_kind(field.dataType)
        if native is None:
            text = py_strip(c.cast("string"))
            folded.append(F.bool_and(F.when(text != "", test(text))).alias(field.name))
        else:
            some = F.bool_or(c.isNotNull()) if native == kind else F.lit(False)
            folded.append(some.alias(field.name))
    row = df.agg(*folded)
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("ok")) for c in df.columns]
    )
    return row.select(F.inline(pairs)).filter("ok").select("column")


def numeric_columns(df: DataFrame) -> DataFrame:
    def test(text: Column) -> Column:
        return is_numeric_like(text, True) & ~is_bool_like(text, True)

    return _columns_where(df, "number", test)


def date_columns(df: DataFrame) -> DataFrame:
    return _columns_where(df, "date", lambda text: is_date_like(text, True))


def id_columns(df: DataFrame) -> list[str]:
    """Columns whose upper-cased name contains ``ID``."""
    return [c for c in df.columns if "ID" in c.upper()]


def header_terms(spark: SparkSession, names: list[str]) -> DataFrame:
    """``position, term``: column names that are neither number- nor date-like."""
    rows = spark.createDataFrame(list(enumerate(names)), "position int, term string")
    return rows.filter(~is_numeric_like(F.col("term")) & ~is_date_like(F.col("term")))


def omit_columns(df: DataFrame, omitted: list[str]) -> list[str]:
    """Columns whose values still count."""
    return [c for c in df.columns if c not in omitted]


def skip_transformed(
    columns: list[str],
    splits: dict[str, list[str]],
    expanded: list[str],
    keep_split: bool,
    keep_expand: bool,
) -> list[str]:
    """Columns without the kept originals that were split or expanded into others."""
    out = []
    for c in columns:
        split_out = keep_split and any(n in columns for n in splits.get(c, []))
        if not split_out and not (keep_expand and c in expanded):
            out.append(c)
    return out


def suggest_column_groups(catalogue: DataFrame) -> DataFrame:
    """``group_key, display, column`` from a ``column`` catalogue.

    Words shared by two or more columns form groups; so do prefixes before the first ``_`` or
    ``.``, unless more than 70 % of their columns lie in one word group.
    """
    names = catalogue.select("column").distinct()
    words = names.select("column", F.explode(column_words(F.col("column"))).alias("display"))
    shared = words.groupBy("display").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    word_groups = words.join(shared.select("display"), "display").select(
        F.concat(F.lit("word_"), "display").alias("group_key"), "display", "column"
    )
    prefixes = names.select(
        "column", F.regexp_extract("column", r"^(.+?)[_.]", 1).alias("display")
    ).filter(F.length("display") > 1)
    big = prefixes.groupBy("display").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    prefix_groups = prefixes.join(big, "display").withColumn(
        "group_key", F.concat(F.lit("prefix_"), "display")
    )
    covered = (
        prefix_groups.join(
            word_groups.select(F.col("group_key").alias("w"), "column"), "column"
        )
        .groupBy("group_key", "n", "w")
        .agg(F.count(F.lit(1)).alias("both"))
        .filter(F.col("both") / F.col("n") > 0.7)
        .select("group_key")
    )
    kept = prefix_groups.join(covered, "group_key", "left_anti")
    return word_groups.unionByName(kept.select("group_key", "display", "column"))
