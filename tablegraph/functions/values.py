"""Per-value type tests and RDF literals as Column functions."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.config import BOOLEAN_WORDS, TRUE_WORDS, Settings
from tablegraph.functions.text import SPACE, py_strip

# A number the way Python's float() reads it: digits may be grouped by single underscores.
_DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"
_FLOAT = (
    rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
)

_CLOCK = r"[T\s]\s*(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)\s*(Z|[+-]\d{2}:?\d{2})?$"
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
# Day layouts and the year-month-day form each is rewritten to, tried in this order.
_LAYOUTS = [
    (r"^(1[3-9]|2\d|3\d)[-/.](\d{1,2})[-/.](\d{4})$", "$3-$2-$1"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", "$3-$1-$2"),
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "$1-$2-$3"),
    (rf"(?i)^(\d{{1,2}})\.?[ -]{_MONTH}\.?,?[ -](\d{{4}})$", "$3-$2-$1"),
    (rf"(?i)^{_MONTH}\.? (\d{{1,2}}),? (\d{{4}})$", "$3-$1-$2"),
]
_PLAIN_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?)?$"
_MAYBE_DATE = (
    r"(?i)^(?:\d{1,4}[-/. ]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"(?=.{3,56}$)(?:(?<=\d{4}.)|.*\d{4})"
)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_numeric_like(c: Column, stripped: bool = False) -> Column:
    """Reads as a number, with ``.`` or ``,`` as decimal mark (the rightmost when both occur).

    ``stripped``, here and below, says that white space is already gone.
    """
    t = c if stripped else py_strip(c)
    no_commas = F.replace(t, F.lit(","), F.lit(""))
    comma_decimal = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    comma_last = t.contains(".") & t.rlike(r",[^.]*$")
    cleaned = F.when(comma_last, comma_decimal).otherwise(no_commas)
    with_comma = py_strip(cleaned).rlike(_FLOAT)
    return _false_if_null(F.when(t.contains(","), with_comma).otherwise(t.rlike(_FLOAT)))


def is_bool_like(c: Column, stripped: bool = False) -> Column:
    return _false_if_null(F.lower(c if stripped else py_strip(c)).isin("true", "false"))


def iso_datetime(c: Column, stripped: bool = False) -> Column:
    """ISO text of a date or date-time in one of the supported layouts, else null.

    Layouts: year-month-day and day/month/year by ``-``, ``/`` or ``.`` (month first unless it
    exceeds 12), ``3 October 1998``, ``October 3, 1998``; each with an optional time and offset.
    """
    t = c if stripped else py_strip(c)
    # Every step refers to the one before it once, which keeps the expression small.
    day = F.regexp_replace(t, _CLOCK, "")
    for pattern, layout in _LAYOUTS:
        day = F.regexp_replace(day, pattern, layout)
    for number, name in enumerate(_MONTHS, 1):
        day = F.regexp_replace(day, rf"(?i)-{name}[a-z]*-", f"-{number}-")
    clock = F.coalesce(F.nullif(F.regexp_extract(t, _CLOCK, 1), F.lit("")), F.lit("00:00"))
    # Only a calendar-valid value counts; 2023-02-30 or 25:00 stay text.
    moment = F.concat(day, F.lit(" "), F.replace(clock, F.lit(","), F.lit(".")))
    text = F.date_format(moment.try_cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.regexp_replace(F.regexp_extract(t, _CLOCK, 2), "^Z$", "+00:00")
    zone = F.regexp_replace(zone, r"^(.\d{2}):?(\d{2})$", "$1:$2")
    iso = F.concat(F.regexp_replace(text, r"\.000000$", ""), zone)
    # The layout most machine-written dates have needs one cast and no rewriting.
    shown = F.translate(t, " ", "T")
    plain = (
        F.when(t.try_cast("timestamp_ntz").isNull(), F.lit(None).cast("string"))
        .when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00")))
        .when(F.length(t) == 19, shown)
        .otherwise(F.regexp_replace(F.rpad(shown, 26, "0"), r"\.000000$", ""))
    )
    return F.when(t.rlike(_PLAIN_DATE), plain).when(t.rlike(_MAYBE_DATE), iso)


# The five patterns of texts that are no dates.
def date_guards(t: Column) -> Column:
    """False for texts that are never taken for a date: short, digits only, versions, codes, name + year."""
    return (
        (F.length(t) >= 5)
        & ~t.rlike(r"^\p{Nd}+$")
        & ~t.rlike(r"^\p{Nd}+(\.\p{Nd}+)+$")
        & ~t.rlike(r"^\p{Nd}+[,.]\p{Nd}+$")
        & ~t.rlike(r"^[A-Z0-9_-]{2,6}$")
        & ~t.rlike(f"^[A-Za-z]+{SPACE}+" + r"\p{Nd}{4}$")
    )


def is_date_like(c: Column, stripped: bool = False) -> Column:
    """Date test over the layouts of :func:`iso_datetime`; all work stays in the JVM."""
    t = c if stripped else py_strip(c)
    return _false_if_null(date_guards(t) & iso_datetime(t, True).isNotNull())


# Two-digit years from here on are of the last century.
PIVOT = 75


def iso_datetime_free(c: Column) -> Column:
    """Free-form date parsing, Arrow-batched; missing parts come from a fixed day, not the clock.

    Accepts far more than :func:`iso_datetime`. Call it on distinct values.
    """

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        from dateutil.parser import parse, parserinfo

        class Fixed(parserinfo):
            """Two-digit years by a fixed pivot; by default it moves with the clock."""

            def convertyear(self, year, century_specified=False):
                if year >= 100 or century_specified:
                    return year
                return year + (2000 if year < PIVOT else 1900)

        base, info = datetime.datetime(2000, 1, 1), Fixed()

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return parse(text, info, fuzzy=False, default=base).isoformat()
            except (ValueError, OverflowError, TypeError):
                return None

        return values.map(one)

    return convert(c)


def is_date_like_free(c: Column) -> Column:
    t = py_strip(c)
    return _false_if_null(date_guards(t) & iso_datetime_free(t).isNotNull())


def is_object_term(c: Column, stripped: bool = False) -> Column:
    """Cell text worth linking: non-blank, under 250 characters, no number, date or boolean."""
    t = c if stripped else py_strip(c)
    return _false_if_null(
        (t != "")
        & (F.length(t) < 250)
        & ~is_numeric_like(t, True)
        & ~is_bool_like(t, True)
        & ~is_date_like(t, True)
    )


def guess_datatype(
    c: Column,
    column_name: Column,
    settings: Settings | None = None,
    iso: Column | None = None,
    stripped: bool = False,
) -> Column:
    """XSD datatype of one value; the column name only matters for years.

    ``iso`` takes an already computed :func:`iso_datetime` of the value.
    """
    cfg = settings or Settings()
    t = c if stripped else py_strip(c)
    name = F.lower(F.coalesce(column_name, F.lit("")))
    year_column = F.lit(False)
    for word in cfg.year_words:
        year_column = year_column | name.contains(word)
    return (
        F.when(t.isNull() | (t == ""), V.XSD + "string")
        .when(F.lower(t).isin(cfg.boolean_words), V.XSD + "boolean")
        .when(year_column & t.rlike(r"^\p{Nd}{4}(\.0+)?$"), V.XSD + "gYear")
        .when(t.rlike(r"^-?\p{Nd}+$"), V.XSD + "integer")
        .when(t.rlike(r"^-?\p{Nd}+[.,]\p{Nd}+$"), V.XSD + "decimal")
        .when((iso_datetime(t, True) if iso is None else iso).isNotNull(), V.XSD + "dateTime")
        .otherwise(V.XSD + "string")
    )


def literal_text(
    c: Column, datatype: Column, iso: Column | None = None, stripped: bool = False
) -> Column:
    """Lexical form of a value under its datatype."""
    t = c if stripped else py_strip(c)
    return (
        F.when(
            datatype == V.XSD + "boolean",
            F.when(F.lower(t).isin(TRUE_WORDS), "true").otherwise("false"),
        )
        .when(datatype == V.XSD + "gYear", F.regexp_extract(t, r"^(\p{Nd}{4})", 1))
        .when(datatype == V.XSD + "dateTime", iso_datetime(t, True) if iso is None else iso)
        .when(datatype == V.XSD + "decimal", F.replace(t, F.lit(","), F.lit(".")))
        .otherwise(t)
    )


_COMPARATOR = f"^(<=|>=|<|>){SPACE}*" + r"(\p{Nd}+[.,]?\p{Nd}*)$"


def comparator_parts(c: Column, settings: Settings | None = None) -> Column:
    """``<= 2,5`` to a struct of operator, number and datatype; null for anything else."""
    number = F.replace(F.regexp_extract(c, _COMPARATOR, 2), F.lit(","), F.lit("."))
    return F.when(
        c.rlike(_COMPARATOR),
        F.struct(
            F.regexp_extract(c, _COMPARATOR, 1).alias("comparator"),
            number.alias("value"),
            guess_datatype(
                number, F.lit(None).cast("string"), settings, F.lit(None).cast("string"), True
            ).alias("datatype"),
        ),
    )
