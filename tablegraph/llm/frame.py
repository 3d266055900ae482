"""What the operators share: the inner frame of documents, buckets, and copies of whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablegraph.session import shared_folder

# Rows per Arrow batch: with texts of any length a batch is bounded by Spark's bytes per batch too.
ARROW_ROWS = "1000"
# Buckets per shuffle partition: a bucket is the unit that one Python call holds in memory.
BUCKETS_PER_PARTITION = 2

SIDE = "bucket int, kind int, shard int, id long, payload binary"
BLANKS = " \t\n\x0b\f\r"
COPY, REPLY, SPANS, TEXTS = 0, 1, 2, 3

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and skewed joins split by adaptive execution."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def width(spark: SparkSession) -> int:
    """The session's shuffle width, which the cluster sets by the size of its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bucketed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bucket, key, id, text, rest``: documents dealt evenly by id and text.

    ``key`` names a row by its id and text, so equal rows share it and results; every other column,
    whatever its name, travels in the struct ``rest``. The number of buckets follows the session's
    shuffle width, so a bucket stays as small as the cluster's partitions are meant to be.
    """
    spark = tuned(docs.sparkSession)
    buckets = width(spark) * BUCKETS_PER_PARTITION
    key = F.xxhash64(quoted(id_col).cast("long"), quoted(text_col))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    columns = [
        F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"),
        key.alias("key"),
        quoted(id_col).cast("long").alias("id"),
        quoted(text_col).alias("text"),
    ]
    if others:
        columns.append(F.struct(*[quoted(c).alias(c) for c in others]).alias("rest"))
    return docs.select(*columns)


def unpacked(frame: DataFrame, columns: list[str], id_col: str, text_col: str, extra=()) -> DataFrame:
    """The columns of the documents again, in their order, from ``id, text, rest``, and ``extra``.

    A column of the documents that has the name of an added one gives way to it.
    """

    def column(c: str) -> Column:
        if c == id_col:
            return F.col("id").alias(c)
        return F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c)

    return frame.select(*[column(c) for c in columns if c not in extra], *extra)


def with_rest(schema: str, frame: DataFrame) -> StructType:
    """The schema and, if the frame has other columns, their struct."""
    got = StructType.fromDDL(schema)
    return got.add(frame.schema["rest"]) if "rest" in frame.columns else got


def copies(frame: DataFrame) -> DataFrame:
    """``bucket, key, id, first``: rows whose whole text a smaller id has too, with the smallest.

    Digests are counted with map-side combine, and the join back is an equi-join on the digest that
    adaptive execution splits when one text fills a third of the table.
    """
    texts = frame.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select(
        "bucket", "key", "id", F.md5("text").alias("digest")
    )
    firsts = texts.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    firsts = firsts.where("first < last").select("digest", "first")
    return texts.join(firsts, "digest").where("id > first").select("bucket", "key", "id", "first")


def copy_side(found: DataFrame) -> DataFrame:
    """Copies as rows of the side table that meets the documents bucket by bucket."""
    return found.select(  # aliases: the side shares the documents' columns, and meets them again
        F.col("bucket").alias("bucket"), F.lit(COPY).alias("kind"), F.lit(0).alias("shard"), F.col("key").alias("id"),
        F.lit(None).cast("binary").alias("payload"),
    )


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the folder that the cluster shares, and read again.

    For rows that are needed twice and are dear to make: unlike a checkpoint it is compressed, and a reader
    of a few columns reads no others.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
