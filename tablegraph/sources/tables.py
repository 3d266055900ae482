"""Readers for delimited tables, and checks on their columns."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablegraph.config import NA_MARKERS
from tablegraph.sources import records

DELIMITERS = [",", ";", "\t", "|"]
ENCODINGS = ["utf-8", "iso-8859-1", "windows-1252"]


def _lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``value`` lines; the text reader hands bytes through, other encodings are decoded here."""
    lines = spark.read.text(path)
    if encoding.lower().replace("-", "") == "utf8":
        return lines
    return lines.select(F.decode(F.col("value").cast("binary"), encoding).alias("value"))


def infer_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """Delimiter that splits the first lines into the same number (> 1) of fields.

    Falls back to the most frequent candidate of the first line, then to a comma.
    """
    lines = [r[0] for r in _lines(spark, path, encoding).limit(5).collect()]
    lines = [x.lstrip("﻿") for x in lines if x.strip()]
    counts = {d: [x.count(d) for x in lines] for d in DELIMITERS}
    steady = [d for d in DELIMITERS if lines and min(counts[d]) == max(counts[d]) > 0]
    if steady:
        return max(steady, key=lambda d: counts[d][0])
    first = {d: counts[d][0] for d in DELIMITERS} if lines else {}
    best = max(DELIMITERS, key=lambda d: first.get(d, 0))
    return best if first.get(best, 0) > 0 else ","


def pick_separator(spark: SparkSession, path: str) -> str:
    """First candidate under which the header has more than one column."""
    head = spark.read.text(path).limit(1).collect()
    text = head[0][0] if head else ""
    return next((d for d in DELIMITERS if len(text.split(d)) > 1), ",")


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line holds bytes UTF-8 cannot decode, then Latin-1.

    Decided over all lines by one distributed scan; Latin-1 maps every byte, so the third
    candidate is never needed.
    """
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return ENCODINGS[0] if bad.isEmpty() else ENCODINGS[1]


def sanitize_names(names: list) -> list[str]:
    """Column names without line breaks, blanks around, empties or duplicates."""
    clean = []
    for i, name in enumerate(names):
        text = f"Unnamed_Col_{i}" if name is None else str(name)
        text = text.replace("\n", "_").replace("\r", "_").strip()
        clean.append(text or f"Empty_Col_Name_{i}")
    seen: Counter = Counter()
    out = []
    for name in clean:
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitize_names(df.columns))


def read_table(
    spark: SparkSession,
    path: str,
    start_row: int = 1,
    sep: str | None = None,
    encoding: str = "utf-8",
) -> DataFrame:
    """All-string table from delimited text; the NA markers become null.

    ``start_row`` counts the physical lines of each file, as its header line does; what stands before it
    is left out of every file. Files that start at line 1 and hold no line break inside quotes go to the
    splittable reader as they are; all others are put together by :mod:`tablegraph.sources.records`, which
    needs no file in one task either. The header of the first file by path is read on the driver.
    """
    sep = sep or infer_delimiter(spark, path, encoding)
    start_row = max(start_row, 1)
    lines = records.text_lines(spark, path, encoding)
    broken = not lines.where(records.ends_inside(F.col("value"), sep)).isEmpty()
    if start_row > 1 or broken:
        found = records.records(lines, sep, start_row)
        head = found.where(F.col("number") == start_row).orderBy("file").select("value").head(1)
    else:
        found = None
        head = lines.orderBy("file", "block", "id").select("value").head(1)
    names = _header(spark, head[0][0].lstrip("\ufeff") if head else "", sep)
    schema = ", ".join(f"`c{i}` string" for i in range(len(names))) or "`c0` string"
    options = {"sep": sep, "ignoreLeadingWhiteSpace": "true", "escape": '"'}
    if found is None:
        reader = spark.read.schema(schema).options(**options)
        df = reader.option("header", True).option("encoding", encoding).csv(path)
    else:
        body = found.where((F.col("number") > start_row) & (F.trim("value") != ""))
        df = body.select(F.from_csv("value", schema, options | {"multiLine": "true"}).alias("r")).select("r.*")
    out = sanitize_names(names)
    if not out:
        return df.limit(0)
    return df.toDF(*out).select(
        *[F.when(~F.col(f"`{c}`").isin(NA_MARKERS), F.col(f"`{c}`")).alias(c) for c in out]
    )


def _header(spark: SparkSession, line: str, sep: str) -> list:
    """Names in one header line as written; an empty name is null."""
    options = {"sep": sep, "ignoreLeadingWhiteSpace": "true", "escape": '"', "multiLine": "true"}
    one = spark.createDataFrame([(line,)], "line string")
    shape = one.select(F.schema_of_csv(F.lit(line), options)).head()[0] if line.strip() else ""
    # Types are inferred from the names; only their number counts.
    fields = ", ".join(f"`_c{i}` string" for i in range(len(StructType.fromDDL(_struct_body(shape)))))
    row = one.select(F.from_csv("line", fields, options).alias("r")).select("r.*").head() if fields else None
    return list(row) if row else []


def _struct_body(ddl: str) -> str:
    return ddl.removeprefix("STRUCT<").removesuffix(">")


def normalize_mixed(df: DataFrame) -> DataFrame:
    """Every column as nullable string; binary columns decoded as UTF-8, else Latin-1."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "binary":
            utf8 = F.try_validate_utf8(c)
            c = F.when(utf8.isNotNull(), c.cast("string")).otherwise(F.decode(c, "ISO-8859-1"))
        out.append(c.cast("string").alias(field.name))
    return df.select(*out)


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes, usable as a cache key."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def validate_mapping(df: DataFrame) -> DataFrame:
    """Matching table with a ``URI`` column, stripped names and all optional columns present."""
    df = df.toDF(*[c.strip() for c in df.columns])
    if "URI" not in df.columns and "Mapped ID" in df.columns:
        df = df.withColumnRenamed("Mapped ID", "URI")
    missing = [c for c in ("Term", "URI", "RDF Role") if c not in df.columns]
    if missing:
        raise ValueError(f"mapping table lacks column(s): {', '.join(missing)}")
    for name in ("Match Type", "Source Provider", "Provider Term", "Provider Description",
                 "Confirmed Display String"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    return df


def validate_matching(df: DataFrame) -> DataFrame:
    """As :func:`validate_mapping`, but ``Match Type`` is required and nulls become empty."""
    if "Match Type" not in [c.strip() for c in df.columns]:
        raise ValueError("mapping table lacks column(s): Match Type")
    return validate_mapping(df).fillna("")
