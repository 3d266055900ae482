"""Records of delimited text whose quoted fields may hold line breaks, from files of any size.

Lines are read in splits like any text. Their numbers come from the file and the start of the split that they
were read from: a window numbers the lines of a split, and the small table of splits adds up what came before.
Whether a line begins inside a quoted field is a function of the lines before it with two states; every
line either fixes the state, keeps it or turns it over, so the state at any line follows from the last
line that fixed it and the number of turns since, first inside the split and then over the splits. Only the
lines of records that span several meet in a group.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "block"]


def text_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``file, block, id, value``: lines with the split they came from; ``id`` orders those of a split."""
    value = F.col("value")
    if encoding.lower().replace("-", "") != "utf8":
        value = F.decode(value.cast("binary"), encoding)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), value.alias("value"))


def _closing(sep: str) -> tuple[str, str, str]:
    """Patterns: inside of a quoted field, fields that end in a separator, and the opening of one that stays."""
    s = re.escape(sep)
    inside = r'[^"]*+(?:""[^"]*+)*+'
    whole = rf'(?:[ \t]*+"{inside}"[^{s}]*+|(?![ \t]*+")[^{s}]*+){s}'
    return inside, rf"(?:{whole})*+", rf'[ \t]*+"{inside}$'


def ends_inside(value: Column, sep: str) -> Column:
    """Whether a line that begins outside quotes ends inside a quoted field."""
    _, fields, opening = _closing(sep)
    return value.contains('"') & value.rlike(f"^{fields}{opening}")


def stays_inside(value: Column, sep: str) -> Column:
    """Whether a line that begins inside a quoted field ends inside one."""
    inside, fields, opening = _closing(sep)
    return ~value.contains('"') | value.rlike(
        rf'^{inside}(?:$|"[^{re.escape(sep)}]*+{re.escape(sep)}{fields}{opening})')


def numbered_lines(lines: DataFrame) -> DataFrame:
    """The lines with ``number``, from 1 in each file."""
    order = Window.partitionBy(*SPLIT).orderBy("id")
    placed = lines.withColumn("place", F.row_number().over(order))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("lines"))
    splits = splits.select(*SPLIT, F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    return placed.join(splits, SPLIT).select(
        *SPLIT, "id", "value", (F.col("place") + F.col("before")).alias("number"))


def records(lines: DataFrame, sep: str, start_row: int = 1) -> DataFrame:
    """``file, number, value``: a row for each record from line ``start_row`` of its file on.

    Line breaks inside quoted fields stay as line feeds. A quote that is never closed takes the rest of
    its file, as it does for any reader of such text.
    """
    numbered = numbered_lines(lines).where(F.col("number") >= start_row)
    opens, stays = ends_inside(F.col("value"), sep), stays_inside(F.col("value"), sep)
    marked = numbered.withColumn("opens", opens.cast("int")).withColumn("stays", stays.cast("int"))
    fixed = F.when(F.col("opens") == F.col("stays"), F.col("opens"))
    turns = ((F.col("opens") == 1) & (F.col("stays") == 0)).cast("int")
    here = Window.partitionBy(*SPLIT).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("fixed", fixed).withColumn("turned", F.sum(turns).over(here))
    known = marked.withColumn("fix", F.last(F.when(F.col("fixed").isNotNull(), F.struct(
        F.col("fixed").alias("to"), F.col("turned").alias("at"))), ignorenulls=True).over(here))
    # A split as a whole fixes the state, keeps it or turns it over, as a line does.
    whole = known.groupBy(*SPLIT).agg(F.max_by(F.struct(
        F.col("fix.to").alias("to"), (F.col("turned") - F.coalesce("fix.at", F.lit(0))).alias("turns")),
        "number").alias("w")).select(*SPLIT, "w.to", "w.turns")
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    whole = whole.withColumn("turned", F.sum("turns").over(past))
    whole = whole.withColumn("fix", F.last(F.when(F.col("to").isNotNull(), F.struct(
        (F.col("to") + F.col("turns")).alias("to"), F.col("turned").alias("at"))), ignorenulls=True).over(past))
    after = (F.coalesce("fix.to", F.lit(0)) + F.col("turned") - F.coalesce("fix.at", F.lit(0))) % 2
    begins = F.coalesce(F.lag(after).over(Window.partitionBy("file").orderBy("block")), F.lit(0))
    whole = whole.select(*SPLIT, begins.alias("begins"))
    stated = known.join(whole, SPLIT).withColumn("after", (
        F.coalesce("fix.to", "begins") + F.col("turned") - F.coalesce("fix.at", F.lit(0))) % 2)
    stated = stated.withColumn("inside", F.coalesce(
        F.lag("after").over(Window.partitionBy(*SPLIT).orderBy("number")), "begins"))
    first = F.when(F.col("inside") == 0, F.col("number"))
    stated = stated.withColumn("first", F.last(first, ignorenulls=True).over(here))
    # Lines at the start of a split may belong to a record that began in an earlier one.
    opened = stated.groupBy(*SPLIT).agg(F.max("first").alias("latest"))
    opened = opened.select(*SPLIT, F.last("latest", ignorenulls=True).over(
        past.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    stated = stated.join(opened, SPLIT).select(
        "file", "number", "value", (F.col("inside") + F.col("after") == 0).alias("single"),
        F.coalesce("first", "carried").alias("first"))
    single = stated.where("single").select("file", "number", "value")
    spanning = stated.where("not single").groupBy("file", "first").agg(
        F.array_sort(F.collect_list(F.struct("number", "value"))).alias("parts"))
    return single.unionByName(spanning.select(
        "file", F.col("first").alias("number"),
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))
