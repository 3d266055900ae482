"""Dates in any form that a free-form parser reads, parsed once per distinct value.

Values in the native layouts never leave the JVM. What is left over and might be a date (a digit or the name
of a month or weekday in it) is made distinct, goes once through the Arrow parser, and the values that
parse come back by an equi-join, which adaptive execution splits where one value fills a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph.functions.text import py_strip
from tablegraph.functions.values import (
    date_guards,
    guess_datatype,
    is_date_like,
    iso_datetime,
    iso_datetime_free,
    literal_text,
)
from tablegraph.operators.profile import native_kind

# A text without any of these, or longer, is no date in any form.
_HINT = r"(?i)\p{Nd}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|mon|tue|wed|thu|fri|sat|sun"
LONGEST = 100


def _left_over(text: Column, iso: Column) -> Column:
    return iso.isNull() & (F.length(text) <= LONGEST) & text.rlike(_HINT) & ~text.rlike(r"^[-+]?\p{Nd}+([.,]\p{Nd}+)?$")


def date_dictionary(texts: DataFrame) -> DataFrame:
    """``value, iso`` of the distinct stripped ``value`` texts that only the free-form parser reads."""
    left = texts.where(_left_over(F.col("value"), iso_datetime(F.col("value"), True)))
    # Grouped by value, so each is parsed once however often it occurs.
    distinct = left.groupBy("value").agg(F.count(F.lit(1)).alias("_n")).select("value")
    return distinct.select("value", iso_datetime_free(F.col("value")).alias("iso")).where("iso IS NOT NULL")


def with_iso_datetime(df: DataFrame, column: str, name: str = "iso") -> DataFrame:
    """Adds the ISO text of a date in any form, null for anything else.

    Parts that a text doesn't say come from 2000-01-01, never from the clock.
    """
    value = py_strip(F.col(f"`{column}`").cast("string"))
    known = date_dictionary(df.select(value.alias("value"))).select(
        F.col("value").alias("_date_text"), F.col("iso").alias("_date_iso"))
    met = df.withColumn("_date_value", value).join(known, F.col("_date_value") == F.col("_date_text"), "left")
    return met.withColumn(name, F.coalesce(iso_datetime(F.col("_date_value"), True), F.col("_date_iso"))).drop(
        "_date_value", "_date_text", "_date_iso")


def with_date_test(df: DataFrame, column: str, name: str = "date_like") -> DataFrame:
    """Adds whether the value is a date in any form and none of the codes that only look like one."""
    value = py_strip(F.col(f"`{column}`").cast("string"))
    dated = with_iso_datetime(df, column, "_iso_text")
    test = F.coalesce(date_guards(value) & F.col("_iso_text").isNotNull(), F.lit(False))
    return dated.withColumn(name, test).drop("_iso_text")


def with_typed_literal(df: DataFrame, column: str, column_name: Column, settings=None) -> DataFrame:
    """Adds ``datatype`` and ``literal`` of each value, dates in any form included."""
    value = py_strip(F.col(f"`{column}`").cast("string"))
    dated = with_iso_datetime(df, column, "_iso_text")
    iso = F.col("_iso_text")
    typed = dated.withColumn("datatype", guess_datatype(value, column_name, settings, iso, True))
    return typed.withColumn("literal", literal_text(value, F.col("datatype"), iso, True)).drop("_iso_text")


def free_date_columns(df: DataFrame) -> DataFrame:
    """``column`` rows of the columns whose every non-blank value is a date in any form.

    The distinct values of all text columns that are no date in a native layout share one dictionary.
    """
    kinds = {f.name: native_kind(f.dataType) for f in df.schema.fields}
    texts = [c for c, k in kinds.items() if k is None]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), py_strip(F.col(f"`{c}`").cast("string")).alias("value"))
                      for c in texts]).cast("array<struct<column:string,value:string>>")
    # Native dates and blanks go before anything is grouped; a column without a value is none of dates.
    cells = df.select(F.inline(pairs)).where("value <> ''").select(
        "column", "value", is_date_like(F.col("value"), True).alias("known"))
    seen = cells.groupBy("column", F.when(~F.col("known"), F.col("value")).alias("value")).agg(
        F.count(F.lit(1)).alias("_n")).select("column", "value")
    read = date_dictionary(seen.select("value").where("value IS NOT NULL").distinct()).select(
        F.col("value").alias("text"), date_guards(F.col("value")).alias("good"))
    judged = seen.join(read, F.col("value") == F.col("text"), "left").groupBy("column").agg(
        F.bool_and(F.col("value").isNull() | F.coalesce("good", F.lit(False))).alias("ok"))
    found = judged.where("ok").select("column")
    native = [c for c, k in kinds.items() if k == "date"]
    if native:
        some = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`_{i}`").alias("ok")) for i, c in enumerate(native)])
        row = df.agg(*[F.bool_or(F.col(f"`{c}`").isNotNull()).alias(f"_{i}") for i, c in enumerate(native)])
        found = found.unionByName(row.select(F.inline(some)).where("ok").select("column"))
    return found
