"""Line-oriented graph text in: one quad per line, so files split freely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraph.vocab import RDF, XSD

_IRI = r"<([^<>\"{}|^`\\\x00-\x20]*)>"
_NODE = rf"(?:{_IRI}|(_:[^\s<>\"]+))"
# Possessive runs: the pattern keeps no state for a character, so a literal may have any length.
_LITERAL = r"\"([^\"\\]*+(?:\\.[^\"\\]*+)*+)\"(?:\^\^" + _IRI + r"|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
# Groups: 1-2 subject, 3 predicate, 4-5 object node, 6-8 literal with datatype or language,
# 9-10 graph.
_LINE = rf"^\s*{_NODE}\s*{_IRI}\s*(?:{_NODE}|{_LITERAL})\s*(?:{_NODE})?\s*\.\s*(?:#.*)?$"

# The single-letter escapes of quoted strings.
_ESCAPES = {"\\t": "\t", "\\b": "\b", "\\n": "\n", "\\r": "\r", "\\f": "\f", '\\"': '"', "\\'": "'"}


def unescape(c: Column) -> Column:
    """Undo string escapes; ``\\uXXXX`` and ``\\UXXXXXXXX`` included."""
    pieces = F.regexp_extract_all(
        c, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1)
    )

    def plain(p: Column) -> Column:
        table = F.create_map(*[F.lit(x) for kv in _ESCAPES.items() for x in kv])
        code = F.conv(F.substr(p, F.lit(3)), 16, 10).cast("int")
        # Code point to text through its four-byte big-endian form.
        decoded = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (
            F.when(p.rlike(r"^\\[uU]."), decoded)
            .when(p.startswith("\\"), F.coalesce(F.try_element_at(table, p), F.substr(p, F.lit(2))))
            .otherwise(p)
        )

    return F.when(c.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(c)


def parse_lines(lines: DataFrame) -> DataFrame:
    """``value`` lines to quads; a line that is no quad keeps its text in ``_corrupt``."""
    v = F.col("value")
    lines = lines.filter(~v.rlike(r"^\s*(#.*)?$"))
    # One run of the pattern per line: its groups come out joined, by the one character that no line
    # holds, and are then split.
    groups = "\n".join(f"${i}" for i in range(1, 11))
    parsed = lines.select(
        v, F.when(v.rlike(_LINE), F.split(F.regexp_replace(v, _LINE, groups), "\n")).alias("g")
    )

    def part(i: int) -> Column:
        return F.nullif(F.get("g", F.lit(i - 1)), F.lit(""))

    ok = F.col("g").isNotNull()
    # Without an object node the object is a literal, possibly an empty one.
    is_literal = part(4).isNull() & part(5).isNull()
    language = F.lower(part(8))
    datatype = (
        F.when(part(7).isNotNull(), part(7))
        .when(language.isNotNull(), RDF + "langString")
        .otherwise(XSD + "string")
    )
    literal = unescape(F.get("g", F.lit(5)))
    return parsed.select(
        F.coalesce(unescape(part(9)), part(10)).alias("g"),
        F.coalesce(unescape(part(1)), part(2)).alias("s"),
        F.when(ok, F.when(part(2).isNotNull(), "bnode").otherwise("iri")).alias("s_kind"),
        unescape(part(3)).alias("p"),
        F.when(
            ok, F.when(is_literal, literal).otherwise(F.coalesce(unescape(part(4)), part(5)))
        ).alias("o"),
        F.when(
            ok,
            F.when(is_literal, "lit").when(part(5).isNotNull(), "bnode").otherwise("iri"),
        ).alias("o_kind"),
        F.when(ok & is_literal, datatype).alias("o_datatype"),
        F.when(ok & is_literal, language).alias("o_lang"),
        F.when(~ok, v).alias("_corrupt"),
    )


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))
