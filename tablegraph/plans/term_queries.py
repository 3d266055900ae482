"""Profiling, reshaping, matching tables and near-duplicates over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegraph.functions import similarity as S
from tablegraph.functions import text as T
from tablegraph.functions import values as X
from tablegraph.operators import dates, profile, reshape, similar, terms
from tablegraph.plans.registry import query
from tablegraph.session import dealt

# Rows of a table whose distinct cells one task counts.
TYPED_ROWS = 250_000

PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
          "o_orderpriority"]
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            "l_shipdate"]


def _cells(table: str, columns: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {table}" for c in columns
    )


def _is_number(v: str) -> str:
    return f"(TRY_CAST(replace({v}, ',', '') AS DOUBLE) IS NOT NULL)"


def _is_date(v: str) -> str:
    return f"regexp_full_match({v}, '\\d{{4}}-\\d{{2}}-\\d{{2}}( \\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?)?')"


@query(f"""
SELECT col AS "Term", col AS "Source Column", '' AS "URI", 'predicate' AS "RDF Role",
       '' AS "Match Type"
FROM (VALUES {', '.join(f"('{c}')" for c in ORDERS)}) AS h(col)
UNION ALL
SELECT DISTINCT trim(v), col, '', 'object', '' FROM ({_cells('orders', ORDERS)})
WHERE trim(v) <> '' AND length(trim(v)) < 250 AND NOT {_is_number('trim(v)')}
  AND NOT {_is_date('trim(v)')} AND lower(trim(v)) NOT IN ('true', 'false')
  AND lower(trim(v)) NOT IN ({', '.join(f"'{c}'" for c in ORDERS)})
""")
def matching_table(t):
    return terms.sort_matching_table(terms.matching_table(t.orders))


@query(f"""
SELECT DISTINCT trim(v) AS "Term" FROM ({_cells('customer', CUSTOMER[1:])} UNION ALL
  {_cells('supplier', ['s_name'])} UNION ALL {_cells('part', PART[1:4])})
WHERE trim(v) <> '' AND NOT {_is_number('trim(v)')}
""")
def unique_terms(t):
    parts = [(t.customer, CUSTOMER[1:]), (t.supplier, ["s_name"]), (t.part, PART[1:4])]
    found = [terms.distinct_terms(df, cols) for df, cols in parts]
    merged = found[0].unionByName(found[1]).unionByName(found[2])
    return terms.unique_terms(merged.withColumnRenamed("term", "Term"))


def _all_of(table: str, columns: list[str], test) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\" WHERE (SELECT bool_and({test(f'CAST({c} AS VARCHAR)')}) "
        f"FROM {table} WHERE CAST({c} AS VARCHAR) <> '')"
        for c in columns
    )


def _as_text(t):
    """Line items as read from a delimited file: every column text, every value to be tested."""
    df = t.spread("lineitem")
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query(_all_of("lineitem", LINEITEM, _is_number))
def numeric_columns(t):
    return profile.numeric_columns(_as_text(t))


@query(_all_of("lineitem", LINEITEM, _is_date))
def date_columns(t):
    return profile.date_columns(_as_text(t))


@query(_all_of("orders", ["o_orderdate"], _is_date) + " UNION ALL SELECT 'x' WHERE false")
def native_date_columns(t):
    return profile.date_columns(t.orders)


@query("""
SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level,
       split_part(o_orderpriority, '-', 2) AS priority FROM orders
""")
def split_priority(t):
    df = t.orders.select("o_orderkey", "o_orderpriority")
    return reshape.split_column(df, "o_orderpriority", "-", ["level", "priority"], False)


@query("""
SELECT CAST(i AS INTEGER) AS position, 'text_' || i AS name
FROM (SELECT max(len(string_split(text, ' '))) AS n FROM conversations),
     generate_series(1, n) AS g(i)
""")
def suggest_split_names(t):
    return reshape.suggest_split_names(t.conversations, "text", " ")


CODES = ["RED", "blue", "bolt", "Gear", "plate"]


@query("SELECT p_partkey, " + ", ".join(
    f"list_contains(list_transform(string_split(p_name, ' '), lambda x: lower(x)), "
    f"'{c.lower()}') AS has_{c}" for c in CODES) + " FROM part")
def expand_name_codes(t):
    df = t.part.select("p_partkey", "p_name")
    return reshape.expand_codes(df, "p_name", " ", CODES, "has_", "True", "False", False)


@query("""
SELECT DISTINCT trim(c) AS code FROM (SELECT unnest(string_split(text, ',')) AS c FROM conversations)
WHERE trim(c, ' \t\n\r') <> ''
""".replace("trim(c)", "trim(c, ' \t\n\r')"))
def detect_codes(t):
    return reshape.detect_codes(t.conversations, "text", ",")


@query("""
SELECT c_custkey, 'id_' || lpad(CAST(row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS VARCHAR),
       CAST(length(CAST((SELECT count(*) FROM customer) AS VARCHAR)) AS INTEGER), '0') AS row_id
FROM customer
""")
def generate_ids(t):
    df = t.customer.select("c_custkey", "c_mktsegment")
    out = reshape.generate_ids(df, ["c_mktsegment", "c_custkey"], "row_id")
    return out.select("c_custkey", "row_id")


@query(f"""
SELECT o_orderkey, col AS "column", v AS value FROM ({_cells('orders', ORDERS[1:], 'o_orderkey, ')})
WHERE v IS NOT NULL
""")
def unpivot_rows(t):
    return reshape.unpivot_rows(t.orders, ["o_orderkey"])


def _datatype(v: str, col: str) -> str:
    return f"""CASE WHEN lower({v}) IN ('true','false','ja','nein','yes','no') THEN 'boolean'
      WHEN (contains(lower({col}), 'jahr') OR contains(lower({col}), 'year'))
           AND regexp_full_match({v}, '\\d{{4}}(\\.0+)?') THEN 'gYear'
      WHEN regexp_full_match({v}, '-?\\d+') THEN 'integer'
      WHEN regexp_full_match({v}, '-?\\d+[.,]\\d+') THEN 'decimal'
      WHEN {_is_date(v)} THEN 'dateTime' ELSE 'string' END"""


def _literal(v: str, dt: str) -> str:
    return f"""CASE {dt} WHEN 'boolean' THEN CASE WHEN lower({v}) IN ('true','ja','yes')
        THEN 'true' ELSE 'false' END
      WHEN 'gYear' THEN substr({v}, 1, 4) WHEN 'decimal' THEN replace({v}, ',', '.')
      WHEN 'dateTime' THEN replace({v}, ' ', 'T') ELSE {v} END"""


@query(f"""
WITH cells AS ({_cells('lineitem', LINEITEM, 'l_orderkey AS k, ')} UNION ALL
  SELECT o_orderkey, 'order_year', CAST(year(o_orderdate) AS VARCHAR) || '.0' FROM orders UNION ALL
  SELECT o_orderkey, 'paid', CASE o_orderstatus WHEN 'F' THEN 'ja' WHEN 'P' THEN 'Nein' ELSE 'x' END
  FROM orders),
typed AS (SELECT *, {_datatype('v', 'col')} AS dt FROM cells),
texts AS (SELECT *, {_literal('v', 'dt')} AS txt FROM typed)
SELECT col AS "column", 'http://www.w3.org/2001/XMLSchema#' || dt AS datatype, count(*) AS cells,
       min(txt) AS lowest, max(txt) AS highest FROM texts GROUP BY ALL
""")
def typed_literals(t):
    cells = reshape.unpivot_rows(dealt(t.lineitem, TYPED_ROWS), [])
    paid = F.when(F.col("o_orderstatus") == "F", "ja").when(F.col("o_orderstatus") == "P", "Nein")
    more = dealt(t.orders, TYPED_ROWS).select(
        F.concat(F.year("o_orderdate").cast("string"), F.lit(".0")).alias("order_year"),
        paid.otherwise("x").alias("paid"),
    )
    return literals_by_type(cells.unionByName(reshape.unpivot_rows(more, [])))


def literals_by_type(cells):
    """Cells by column and datatype; the tests run once per value of a column, equal cells are counted first."""
    cells = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cells"))
    value, iso = F.col("value"), F.col("iso")
    cells = cells.withColumn("value", T.py_strip(value))
    cells = cells.withColumn("iso", X.iso_datetime(value, True))
    cells = cells.withColumn(
        "datatype", X.guess_datatype(value, F.col("column"), iso=iso, stripped=True)
    )
    cells = cells.withColumn("text", X.literal_text(value, F.col("datatype"), iso, True))
    return cells.groupBy("column", "datatype").agg(
        F.sum("cells").alias("cells"), F.min("text").alias("lowest"),
        F.max("text").alias("highest"),
    )


# Forms of a moment that no native layout has: Spark's pattern, DuckDB's, and what is left of the moment.
_FREE_FORMS = [
    ("dd MMM yy", "%d %b %y", "date_trunc('day', m)"),
    ("MM/dd/yy", "%m/%d/%y", "date_trunc('day', m)"),
    ("yyyy-MM", "%Y-%m", "date_trunc('month', m)"),
    ("EEEE", "%A", "TIMESTAMP '2000-01-01' + to_days(((dayofweek(m) + 1) % 7)::INTEGER)"),
    ("yyyyMMdd'T'HHmmss", "%Y%m%dT%H%M%S", "m"),
    ("HH:mm:ss", "%H:%M:%S", "TIMESTAMP '2000-01-01' + (m - date_trunc('day', m))"),
    ("EEEE, MMMM d, yyyy", "%A, %B %-d, %Y", "date_trunc('day', m)"),
    ("hh:mm a MMM d yyyy", "%I:%M %p %b %-d %Y", "date_trunc('minute', m)"),
    ("'day' D 'of' yyyy", "day %-j of %Y", "NULL::TIMESTAMP"),
]
_FREE_SQL = f"""WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes((o_orderkey % 1440)::INTEGER) AS m FROM orders),
f AS (SELECT o_orderkey, CASE o_orderkey % {len(_FREE_FORMS)} """ + " ".join(
    f"WHEN {i} THEN strftime(m, '{duck}')" for i, (_, duck, _) in enumerate(_FREE_FORMS)
) + f""" END AS written, CASE o_orderkey % {len(_FREE_FORMS)} """ + " ".join(
    f"WHEN {i} THEN {left}" for i, (_, _, left) in enumerate(_FREE_FORMS)) + """ END AS moment FROM o)"""


def _free_texts(t):
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    moment = F.col("o_orderdate").cast("timestamp_ntz") + minutes
    written = F.lit(None).cast("string")
    for i, (layout, _, _) in enumerate(_FREE_FORMS):
        written = F.when(F.col("o_orderkey") % len(_FREE_FORMS) == i, F.date_format(moment, layout)).otherwise(written)
    return t.orders.select("o_orderkey", written.alias("written"))


@query(_FREE_SQL + """
SELECT o_orderkey, written, strftime(moment, '%Y-%m-%dT%H:%M:%S') AS iso, moment IS NOT NULL AS date_like,
  'http://www.w3.org/2001/XMLSchema#' || CASE WHEN moment IS NULL THEN 'string' ELSE 'dateTime' END AS datatype,
  coalesce(strftime(moment, '%Y-%m-%dT%H:%M:%S'), written) AS literal
FROM f
""")
def free_form_dates(t):
    """Eight forms beyond the native layouts, and one that is no date."""
    texts = dates.with_date_test(dates.with_iso_datetime(_free_texts(t), "written"), "written")
    return dates.with_typed_literal(texts, "written", F.lit("day")).select(
        "o_orderkey", "written", "iso", "date_like", "datatype", "literal")


@query(_FREE_SQL + """
SELECT 'form_' || (o_orderkey % 9) AS "column" FROM f GROUP BY 1 HAVING bool_and(moment IS NOT NULL)
UNION ALL SELECT 'o_orderdate'
""")
def free_form_date_columns(t):
    """A column for each form; all but the last hold nothing but dates."""
    texts = _free_texts(t).join(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey")
    columns = [F.when(F.col("o_orderkey") % len(_FREE_FORMS) == i, F.col("written")).alias(f"form_{i}")
               for i in range(len(_FREE_FORMS))]
    return dates.free_date_columns(texts.select(*columns, "o_orderdate", F.lit(" ").alias("blank")))


_LAYOUTS = {
    "1-URGENT": ("yyyy/M/d HH:mm", "%Y/%-m/%-d %H:%M"),
    "2-HIGH": ("MM/dd/yyyy", "%m/%d/%Y"),
    "3-MEDIUM": ("d MMMM yyyy", "%-d %B %Y"),
    "4-NOT SPECIFIED": ("MMM d, yyyy", "%b %-d, %Y"),
    "5-LOW": ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
}


@query("""
SELECT o_orderkey, CASE o_orderpriority """ + " ".join(
    f"WHEN '{k}' THEN strftime(o_orderdate, '{duck}')" for k, (_, duck) in _LAYOUTS.items()
) + """ END AS written, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
  || CASE o_orderpriority WHEN '5-LOW' THEN '+00:00' ELSE '' END AS iso FROM orders
""")
def date_layouts(t):
    written = F.lit(None).cast("string")
    for key, (layout, _) in _LAYOUTS.items():
        text = F.date_format("o_orderdate", layout)
        written = F.when(F.col("o_orderpriority") == key, text).otherwise(written)
    df = t.orders.select("o_orderkey", written.alias("written"))
    return df.withColumn("iso", X.iso_datetime(F.col("written")))


@query(f"""
WITH cells AS (SELECT DISTINCT v FROM ({_cells('events', ['ts', 'event_type', 'value', 'props'])}))
SELECT count(*) AS distinct_values, count_if({_is_number('v')}) AS numeric_like,
  count_if({_is_date('v')}) AS date_like,
  count_if(NOT {_is_number('v')} AND NOT {_is_date('v')} AND length(v) < 250) AS object_terms
FROM cells
""")
def value_tests(t):
    df = t.events.select("ts", "event_type", "value", "props")
    cells = reshape.unpivot_rows(df, []).select("value").distinct()
    v = F.col("value")
    return cells.agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.count_if(X.is_numeric_like(v)).alias("numeric_like"),
        F.count_if(X.is_date_like(v)).alias("date_like"),
        F.count_if(X.is_object_term(v)).alias("object_terms"),
    )


@query("""
SELECT p_partkey, '<= ' || replace(CAST(p_retailprice AS VARCHAR), '.', ',') AS written,
  '<=' AS comparator, CAST(p_retailprice AS VARCHAR) AS number,
  'http://www.w3.org/2001/XMLSchema#decimal' AS datatype FROM part
""")
def comparator_parts(t):
    price = F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))
    df = t.part.select("p_partkey", F.concat(F.lit("<= "), price).alias("written"))
    df = df.withColumn("c", X.comparator_parts(F.col("written")))
    return df.select("p_partkey", "written", F.col("c.comparator"), F.col("c.value").alias("number"),
                     F.col("c.datatype"))


@query("""
WITH x AS (SELECT p_partkey, p_name AS a, lower(p_type) || ' ' || p_brand AS b FROM part),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(a), '[^\\p{L}\\p{N}_]+'), lambda k: length(k) >= 3) AS ta,
  list_filter(regexp_split_to_array(lower(b), '[^\\p{L}\\p{N}_]+'), lambda k: length(k) >= 3) AS tb FROM x)
SELECT p_partkey, round(1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)), 6) AS lev,
  round(1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)), 6) AS sim,
  round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS jaccard FROM w
""")
def text_similarities(t):
    a, b = F.col("p_name"), F.concat(F.lower("p_type"), F.lit(" "), "p_brand")
    return t.part.select(
        "p_partkey", F.round(S.lev_score(a, b), 6).alias("lev"),
        F.round(S.lev_sim(a, b), 6).alias("sim"),
        F.round(S.token_jaccard(a, b), 6).alias("jaccard"),
    )


# Rows of the longest-common-subsequence table of texts a and b, folded over their characters.
_LCS = """list_last(list_reduce(
  list_prepend(list_transform(range(0, length(b) + 1), lambda i: 0),
               list_transform(range(1, length(a) + 1), lambda i: [CAST(i AS INTEGER)])),
  lambda old, step: list_reduce(
    list_prepend([0], list_transform(range(1, length(b) + 1), lambda j: [CAST(j AS INTEGER)])),
    lambda new, cell: list_append(new, CASE WHEN substr(a, step[1], 1) = substr(b, cell[1], 1)
      THEN old[cell[1]] + 1 ELSE greatest(old[cell[1] + 1], new[cell[1]]) END))))"""


@query(f"""
WITH x AS (SELECT DISTINCT lower(p_name) AS a, lower(p_type) || ' ' || lower(p_brand) AS b FROM part)
SELECT a, b, round(2.0 * {_LCS} / (length(a) + length(b)), 6) AS ratio FROM x
""")
def indel_ratios(t):
    pairs = t.part.select(
        F.lower("p_name").alias("a"),
        F.concat(F.lower("p_type"), F.lit(" "), F.lower("p_brand")).alias("b"),
    ).distinct()
    return pairs.withColumn("ratio", F.round(S.indel_ratio(F.col("a"), F.col("b")), 6))


THRESHOLD = 0.95
_NAMES = "SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS term FROM part"
_PAIRS = f"""
names AS MATERIALIZED ({_NAMES}),
near AS MATERIALIZED (SELECT x.term AS ta, y.term AS tb, lower(x.term) AS a, lower(y.term) AS b
  FROM names x JOIN names y ON x.term < y.term
   AND levenshtein(x.term, y.term) <= {1 - THRESHOLD} * (length(x.term) + length(y.term)) + 0.001),
pairs AS MATERIALIZED (SELECT ta, tb, 2.0 * {_LCS} / (length(a) + length(b)) AS ratio FROM near)
"""


def _names(t):
    return t.part.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("term")).distinct()


@query(f"WITH {_PAIRS} SELECT ta AS a, tb AS b, round(ratio, 6) AS ratio FROM pairs "
       f"WHERE ratio >= {THRESHOLD}")
def similar_pairs(t):
    return similar.similar_pairs(_names(t), THRESHOLD).withColumn("ratio", F.round("ratio", 6))


_GROUPS = f"""
WITH RECURSIVE {_PAIRS},
edges AS MATERIALIZED (SELECT ta, tb FROM pairs WHERE ratio >= {THRESHOLD}),
earlier AS MATERIALIZED (SELECT n.term, row_number() OVER (ORDER BY n.term) AS i,
   coalesce(list(e.ta) FILTER (e.ta IS NOT NULL), []) AS near
 FROM names n LEFT JOIN edges e ON e.tb = n.term GROUP BY n.term),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS leaders UNION ALL
 SELECT e.i, CASE WHEN list_has_any(w.leaders, e.near) THEN w.leaders
   ELSE list_append(w.leaders, e.term) END
 FROM walk w JOIN earlier e ON e.i = w.i + 1),
leaders AS MATERIALIZED (SELECT unnest(leaders) AS leader FROM walk
  WHERE i = (SELECT max(i) FROM earlier)),
follow AS (SELECT e.tb AS member, min(l.leader) AS leader FROM edges e
  JOIN leaders l ON l.leader = e.ta WHERE e.tb NOT IN (SELECT leader FROM leaders) GROUP BY e.tb),
grouped AS (SELECT leader, member FROM follow UNION ALL
  SELECT leader, leader FROM leaders WHERE leader IN (SELECT leader FROM follow))
"""


@query(_GROUPS + "SELECT leader, member FROM grouped")
def consolidation_groups(t):
    return similar.consolidate_groups(similar.similar_pairs(_names(t), THRESHOLD))


@query(_GROUPS + """
SELECT DISTINCT coalesce(g.leader, n.term) AS "Term", 'name' AS "Source Column", 'object' AS "RDF Role"
FROM names n LEFT JOIN grouped g ON g.member = n.term
""")
def apply_consolidation(t):
    names = _names(t)
    groups = similar.consolidate_groups(similar.similar_pairs(names, THRESHOLD))
    table = names.select(F.col("term").alias("Term"), F.lit("name").alias("Source Column"),
                         F.lit("object").alias("RDF Role"))
    none = groups.select("leader", F.col("leader").alias("choice")).filter("false")
    return terms.apply_consolidation(table, groups, none)


_MAPPING = """mapping AS (SELECT s_suppkey AS term_id, s_name AS "Term",
  CASE WHEN s_nationkey < 10 THEN 'http://known.example.org/' || s_suppkey
       WHEN s_nationkey < 15 THEN 'No Match' ELSE '' END AS "URI", 'object' AS "RDF Role",
  CASE WHEN s_acctbal > 5000 THEN 'skos:closeMatch' ELSE '' END AS "Match Type",
  '' AS "Source Provider", '' AS "Confirmed Display String", '' AS "Provider Term",
  '' AS "Provider Description" FROM supplier)"""


def supplier_mapping(t):
    n = F.col("s_nationkey")
    known = F.concat(F.lit("http://known.example.org/"), F.col("s_suppkey").cast("string"))
    empty = [F.lit("").alias(c) for c in ("Source Provider", "Confirmed Display String",
                                          "Provider Term", "Provider Description")]
    return t.supplier.select(
        F.col("s_suppkey").alias("term_id"), F.col("s_name").alias("Term"),
        F.when(n < 10, known).when(n < 15, "No Match").otherwise("").alias("URI"),
        F.lit("object").alias("RDF Role"),
        F.when(F.col("s_acctbal") > 5000, "skos:closeMatch").otherwise("").alias("Match Type"),
        *empty,
    )


@query(f"""WITH {_MAPPING} SELECT term_id, "Term" FROM mapping
WHERE "URI" IN ('', 'No Match') OR "Match Type" = ''""")
def unreconciled(t):
    return terms.unreconciled(supplier_mapping(t), skos=True).select("term_id", "Term")


@query("""
SELECT c_custkey AS term_id, c_name AS term FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
""")
def pending_terms(t):
    every = t.customer.select(F.col("c_custkey").alias("term_id"), F.col("c_name").alias("term"))
    done = t.orders.select(F.col("o_custkey").alias("term_id"), F.col("o_orderstatus").alias("provider"))
    return terms.pending_terms(every, done, "P")


@query(f"""WITH {_MAPPING}
SELECT "Term", "URI", "RDF Role", "Match Type", "Source Provider", "Confirmed Display String"
FROM mapping UNION ALL
SELECT DISTINCT c_name, 'No Match', 'predicate', 'No Match', '', '--- No Match ---' FROM customer
WHERE c_name NOT IN (SELECT "Term" FROM mapping)""")
def complete_missing_terms(t):
    names = t.customer.select(F.col("c_name").alias("Term"))
    names = names.unionByName(t.supplier.select(F.col("s_name").alias("Term")))
    full = terms.complete_missing_terms(supplier_mapping(t), names)
    return full.select("Term", "URI", "RDF Role", "Match Type", "Source Provider",
                       "Confirmed Display String")


@query(f"""WITH {_MAPPING}, picks AS (SELECT l_suppkey AS term_id,
    max(l_quantity) AS q, max(l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT m.term_id, m."Term", CASE WHEN q >= 50 THEN 'No Match' ELSE 'http://x/' || p END AS "URI",
  CASE WHEN q >= 50 THEN '' WHEN "Match Type" = '' THEN 'skos:exactMatch' ELSE "Match Type" END AS "Match Type",
  CASE WHEN q >= 50 THEN '' ELSE 'src' END AS "Source Provider",
  CASE WHEN q >= 50 THEN '--- No Match ---' ELSE 'part ' || p END AS "Confirmed Display String"
FROM mapping m JOIN picks USING (term_id)""")
def apply_decisions(t):
    picks = t.lineitem.groupBy(F.col("l_suppkey").alias("term_id")).agg(
        F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"))
    p = F.col("p").cast("string")
    none = F.lit(None).cast("string")
    decisions = picks.select(
        "term_id", F.when(F.col("q") >= 50, "No Match").otherwise(F.concat(F.lit("http://x/"), p)).alias("uri"),
        F.lit("src").alias("source"), F.concat(F.lit("part "), p).alias("display"),
        F.lit("").alias("label"), F.lit("").alias("description"), none.alias("match_type"))
    mapping = supplier_mapping(t).join(picks, "term_id", "left_semi")
    out = terms.apply_decisions(mapping, decisions)
    return out.select("term_id", "Term", "URI", "Match Type", "Source Provider",
                      "Confirmed Display String")


@query(f"""WITH {_MAPPING} SELECT "Term", CASE WHEN "URI" = 'No Match' THEN '' ELSE "URI" END AS "URI",
 "RDF Role", "Match Type", "Source Provider", "Provider Term", "Provider Description" FROM mapping""")
def download_table(t):
    return terms.download_table(supplier_mapping(t))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name OFFSET 40 LIMIT 20")
def page_of_terms(t):
    return terms.page(t.customer.select("c_custkey", "c_name"), ["c_name"], 3, 20)


@query("""
WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity,
    row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity) AS place, count(*) OVER () AS n
  FROM lineitem)
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM r
WHERE (place - 1) // 70 = least(500, (n + 69) // 70) - 1
""")
def page_inside(t):
    """A page deep inside the line items."""
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return terms.page(rows, ["l_partkey"], 500, 70)


@query("""
WITH v AS (SELECT DISTINCT o_custkey AS subject, o_orderpriority AS priority FROM orders),
s AS (SELECT DISTINCT o_custkey AS subject, o_orderstatus AS status FROM orders),
pv AS (SELECT subject, list(priority ORDER BY priority) AS ps FROM v GROUP BY subject),
sv AS (SELECT subject, list(status ORDER BY status) AS ss FROM s GROUP BY subject)
SELECT CAST(subject AS VARCHAR) AS subject, CAST(i AS BIGINT) AS pos, ps[least(i, len(ps))] AS priority,
       ss[least(i, len(ss))] AS status
FROM (SELECT *, unnest(generate_series(1, greatest(len(ps), len(ss)))) AS i FROM pv JOIN sv USING (subject))
""")
def expand_multi_values(t):
    df = t.orders.select(F.col("o_custkey").cast("string").alias("subject"),
                         F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    values = reshape.unpivot_rows(df, ["subject"]).withColumnRenamed("column", "label").distinct()
    return reshape.expand_multi_values(reshape.value_positions(values), ["priority", "status"])


@query("""
SELECT page_id, url, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS absolute,
 CASE WHEN contains(url, '#') THEN regexp_extract(url, '#([^#]*)$', 1)
      ELSE regexp_extract(url, '/([^/]*)$', 1) END AS local,
 CASE WHEN contains(url, '#') THEN regexp_extract(url, '^(.*#)', 1)
      ELSE nullif(regexp_extract(url, '^(.*/)[^/]+$', 1), '') END AS namespace,
 coalesce(nullif(regexp_extract(url, '#(.+)$', 1), ''),
   nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^?#]+', 0), '://.*/([^/]+)/*$', 1), ''),
   regexp_extract(url, '://([^/?#]+)', 1)) AS label
FROM pages
""")
def iri_parts(t):
    u = F.col("url")
    return t.pages.select(
        "page_id", "url", T.is_absolute_iri(u).alias("absolute"), T.local_name(u).alias("local"),
        T.namespace_of(u).alias("namespace"), T.iri_label(u).alias("label"))


@query("""
SELECT conv_id, turn, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  text, 'Ö', 'Oe'), 'Ä', 'Ae'), 'Ü', 'Ue'), 'ö', 'oe'), 'ä', 'ae'), 'ü', 'ue'), 'ß', 'ss'),
  '[^a-zA-Z0-9-]+', '_', 'g').regexp_replace('_+', '_', 'g'), '_'), '') AS cleaned FROM conversations
""")
def clean_for_iri(t):
    return t.conversations.select("conv_id", "turn", T.clean_for_iri(F.col("text")).alias("cleaned"))


@query("""
SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s<>"'']+')) AS iri FROM documents
UNION ALL SELECT page_id, unnest(regexp_extract_all(url, 'https?://[^\\s<>"'']+')) FROM pages
""")
def extract_iris(t):
    docs = t.documents.select("doc_id", F.explode(T.extract_iris(F.col("text"))).alias("iri"))
    pages = t.pages.select(F.col("page_id").alias("doc_id"),
                           F.explode(T.extract_iris(F.col("url"))).alias("iri"))
    return docs.unionByName(pages)


@query("""
SELECT c_custkey, 'A' || upper(md5(c_name)) AS entity,
 'https://l/c?i=http%3A%2F%2Fx%2Fobo%2FGO_' || c_custkey || '&a=GO' AS link,
 'https://doi.org/10.1%2F' || replace(c_name, '#', '%23') AS doi, c_name AS given_first,
 'https://www.ncbi.nlm.nih.gov/' || CASE WHEN c_nationkey < 9 THEN 'gene' ELSE lower(c_mktsegment) END
   || '/' || c_custkey AS page
FROM customer
""")
def names_and_links(t):
    key = F.col("c_custkey").cast("string")
    iri = F.concat(F.lit("http://x/obo/GO_"), key)
    db = F.when(F.col("c_nationkey") < 9, "gene").otherwise(F.lower("c_mktsegment"))
    person = T.person_name(F.concat(F.lit("Smith, "), F.col("c_name")))
    return t.customer.select(
        "c_custkey", T.entity_id(F.col("c_name"), "A").alias("entity"),
        T.ui_link(F.lit("https://l/c?i={encoded_iri}&a={acronym}"), T.obo_acronym(iri), iri).alias("link"),
        T.doi_iri(F.concat(F.lit("10.1/"), "c_name"), True).alias("doi"),
        person["given"].alias("given_first"), T.repository_iri(db, key).alias("page"))


@query("""
SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ') AS text
FROM conversations
""")
def rebuild_abstract(t):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    placed = t.conversations.select("conv_id", "turn", F.posexplode(words).alias("pos", "word"))
    index = placed.groupBy("conv_id", "turn", "word").agg(F.collect_list("pos").alias("places"))
    inverted = index.groupBy("conv_id", "turn").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("inverted"))
    return inverted.select("conv_id", "turn", T.rebuild_abstract(F.col("inverted")).alias("text"))
