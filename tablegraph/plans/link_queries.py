"""Linking, ranking, resolving and response bodies over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.operators import link, patterns, rank, resolve, responses
from tablegraph.operators.quads import explode_facts, fact
from tablegraph.plans.registry import query
from tablegraph.plans.term_queries import _MAPPING, supplier_mapping
from tablegraph.session import dealt

_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda k: length(k) >= 3)"


def _part_entities(t):
    key = F.col("p_partkey").cast("string")
    return t.part.select(
        F.concat(F.lit("urn:part:"), key).alias("uri"),
        F.concat_ws(" ", "p_name", "p_brand").alias("label"),
        F.lower("p_type").alias("description"), F.array(F.col("p_type")).alias("synonyms"))


@query("""
WITH w AS (SELECT DISTINCT 'doc:' || doc_id AS uri,
  unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda k: length(k) >= 3)) AS token
  FROM documents)
SELECT token, count(*) AS entities FROM w GROUP BY token
""")
def token_index(t):
    uri = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    index = link.build_token_index(t.spread("documents").select(uri.alias("uri"), F.col("text").alias("name")))
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("entities"))


@query(f"""
WITH terms AS (SELECT DISTINCT p_name AS term, {_TOKENS.format('p_name')} AS tt FROM part),
ent AS (SELECT 'urn:part:' || p_partkey AS uri, p_name || ' ' || p_brand AS label, p_type AS syn,
  list_distinct(list_concat({_TOKENS.format("p_name || ' ' || p_brand")}, {_TOKENS.format('p_type')})) AS et
  FROM part),
pairs AS (SELECT term, uri, label, greatest(
   1 - levenshtein(term, lower(label)) / greatest(length(term), length(label)),
   1 - levenshtein(term, lower(syn)) / greatest(length(term), length(syn))) AS sim
  FROM terms JOIN ent ON list_has_any(tt, et)),
scored AS (SELECT term, uri, label, CASE WHEN contains(lower(label), term) THEN least(1.0, sim + 0.08)
  ELSE sim END AS raw FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY raw DESC, uri) AS rank FROM scored)
SELECT term, CAST(rank AS INTEGER) AS rank, uri, label, round(raw, 6) AS score FROM ranked WHERE rank <= 5
""")
def vocabulary_search(t):
    terms = t.part.select(F.col("p_name").alias("term_id"), F.col("p_name").alias("term")).distinct()
    out = link.search_vocabulary(terms, _part_entities(t), 5)
    return out.select("term", "rank", "uri", "label", "score")


@query("""
WITH terms AS (SELECT DISTINCT translate(p_name, 'aeiou', 'eioua') AS term FROM part),
ent AS (SELECT 'urn:part:' || p_partkey AS uri, p_name || ' ' || p_brand AS label, p_type AS syn FROM part),
scored AS (SELECT term, uri, label, greatest(
   1 - levenshtein(term, lower(label)) / greatest(length(term), length(label)),
   1 - levenshtein(term, lower(syn)) / greatest(length(term), length(syn))) AS raw FROM terms, ent),
ranked AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY raw DESC, uri) AS rank FROM scored)
SELECT term, CAST(rank AS INTEGER) AS rank, uri, label, round(raw, 6) AS score FROM ranked WHERE rank <= 7
""")
def misspelt_search(t):
    """Terms of which no token is left: their vowels are exchanged."""
    term = F.translate("p_name", "aeiou", "eioua")
    terms = t.part.select(term.alias("term_id"), term.alias("term")).distinct()
    out = link.search_vocabulary(terms, _part_entities(t), 7)
    return out.select("term", "rank", "uri", "label", "score")


_SUGGESTIONS = """sugg AS (SELECT l.l_partkey AS term_id, p.p_name AS term, l.l_returnflag AS provider,
  l.l_linenumber AS rank, 'http://v/' || l.l_suppkey AS uri, q.p_name AS label, q.p_type AS description,
  CASE WHEN l.l_discount > 0.01 THEN l.l_discount END AS score, q.p_brand AS source_provider
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN part q ON q.p_partkey = l.l_suppkey)"""
_LEV = "(1 - levenshtein(lower(term), lower(label)) / greatest(length(term), length(label)))"


def _suggestions(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("term"))
    q = t.part.select(
        F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("label"),
        F.col("p_type").alias("description"), F.col("p_brand").alias("source_provider"))
    rows = t.lineitem.join(p, "l_partkey").join(q, "l_suppkey")
    return rows.select(
        F.col("l_partkey").alias("term_id"), "term", F.col("l_returnflag").alias("provider"),
        F.col("l_linenumber").alias("rank"),
        F.concat(F.lit("http://v/"), F.col("l_suppkey").cast("string")).alias("uri"), "label",
        "description", F.when(F.col("l_discount") > 0.01, F.col("l_discount")).alias("score"),
        "source_provider", F.lit(None).cast("string").alias("ontology"))


_RANK_SQL = f"""WITH {_SUGGESTIONS}, r AS (SELECT *, {_LEV} AS lev FROM sugg),
o AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY %s DESC,
  CASE provider WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, provider, rank, uri) AS place FROM r)
SELECT term_id, CAST(place AS INTEGER) AS place, provider, uri, label, round(lev, 6) AS lev
FROM o WHERE place <= 3"""


def _ranked(t, strategy):
    out = rank.rank_suggestions(_suggestions(t), 3, strategy, ["N", "A", "R"])
    return out.select("term_id", "place", "provider", "uri", "label",
                      F.round("levenshtein_score", 6).alias("lev"))


@query(_RANK_SQL % "coalesce(score, -1)")
def rank_suggestions(t):
    return _ranked(t, "api")


@query(_RANK_SQL % "lev")
def rank_by_edit_similarity(t):
    return _ranked(t, "levenshtein")


@query(f"""WITH {_SUGGESTIONS}, m AS (SELECT p_partkey AS term_id, p_name AS "Term",
  CASE WHEN p_size > 40 THEN 'http://known/' || p_partkey ELSE '' END AS uri0 FROM part),
r AS (SELECT *, {_LEV} AS lev FROM sugg),
o AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY lev DESC, provider, rank, uri) AS place FROM r),
b AS (SELECT * FROM o WHERE place = 1 AND lev >= 0.7)
SELECT m.term_id, m."Term",
 CASE WHEN uri0 <> '' THEN uri0 WHEN uri IS NULL THEN 'No Match' ELSE uri END AS "URI",
 CASE WHEN uri0 <> '' OR uri IS NULL THEN '' ELSE source_provider END AS "Source Provider",
 CASE WHEN uri0 <> '' THEN '' WHEN uri IS NULL THEN '--- No Match ---' ELSE label || ' [' || source_provider ||
   '] [Lev: ' || printf('%.2f', lev) || '] (' || description || ') <' || uri || '>' END AS "Confirmed Display String",
 CASE WHEN uri0 = '' AND uri IS NULL THEN '' ELSE 'skos:exactMatch' END AS "Match Type"
FROM m LEFT JOIN b ON b.term_id = m.term_id""")
def prefill_best(t):
    empty = [F.lit("").alias(c) for c in (
        "Match Type", "Source Provider", "Confirmed Display String", "Provider Term",
        "Provider Description")]
    known = F.concat(F.lit("http://known/"), F.col("p_partkey").cast("string"))
    mapping = t.part.select(
        F.col("p_partkey").alias("term_id"), F.col("p_name").alias("Term"),
        F.when(F.col("p_size") > 40, known).otherwise("").alias("URI"), *empty)
    out = rank.prefill_best(mapping, _suggestions(t), 0.7, skos=True)
    return out.select("term_id", "Term", "URI", "Source Provider", "Confirmed Display String",
                      "Match Type")


@query(f"WITH {_SUGGESTIONS} SELECT provider, count(DISTINCT term_id) AS terms FROM sugg GROUP BY provider")
def provider_hit_counts(t):
    return rank.provider_hit_counts(_suggestions(t))


@query(f"WITH {_SUGGESTIONS}, {_MAPPING} SELECT term_id, \"Term\" FROM mapping "
       "WHERE term_id IN (SELECT term_id FROM sugg WHERE provider = 'R')")
def with_suggestions(t):
    out = rank.with_suggestions(supplier_mapping(t), _suggestions(t), "R")
    return out.select("term_id", "Term")


@query(f"WITH {_SUGGESTIONS} SELECT provider, count(*) AS kept FROM sugg WHERE provider <> 'SemLookP' "
       "AND (provider <> 'R' OR upper(source_provider) IN ('BRAND#1', 'BRAND#2')) GROUP BY provider")
def filter_ontologies(t):
    named = _suggestions(t).withColumn(
        "provider", F.when(F.col("provider") == "R", "OLS (EBI)").otherwise(F.col("provider")))
    kept = rank.filter_ontologies(named, {"OLS (EBI)": ["brand#1", "Brand#2"], "A": ["x"]})
    name = F.when(F.col("provider") == "OLS (EBI)", "R").otherwise(F.col("provider"))
    return kept.groupBy(name.alias("provider")).agg(F.count(F.lit(1)).alias("kept"))


@query("""
WITH c AS (SELECT a.vec_id AS term_id, b.vec_id AS cand, a.embedding::DOUBLE[] AS u, b.embedding::DOUBLE[] AS v,
  c.embedding::DOUBLE[] AS w, 'item ' || a.vec_id AS term, 'item ' || b.vec_id AS label
 FROM embeddings a JOIN generate_series(1, 5) AS g(k) ON true JOIN embeddings b ON b.vec_id = a.vec_id + k
 JOIN embeddings c ON c.vec_id = b.vec_id + 1),
s AS (SELECT term_id, cand, 0.5 * list_cosine_similarity(u, w) + 0.2 * list_cosine_similarity(u, v)
  + 0.3 * (1 - levenshtein(term, label) / greatest(length(term), length(label))) AS h FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY h DESC) AS place FROM s)
SELECT term_id, CAST(place AS INTEGER) AS place, cand, round(h, 6) AS hybrid FROM r WHERE place <= 3
""")
def hybrid_ranking(t):
    e = t.embeddings.select("vec_id", "embedding")
    name = F.concat(F.lit("item "), F.col("term_id").cast("string"))
    near = e.select(F.col("vec_id").alias("term_id"), F.col("embedding").alias("term_vector"),
                    F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    near = near.withColumn("cand", F.col("term_id") + F.col("k"))
    own = e.select(F.col("vec_id").alias("cand"), F.col("embedding").alias("label_vector"))
    after = e.select((F.col("vec_id") - 1).alias("cand"), F.col("embedding").alias("text_vector"))
    rows = near.join(own, "cand").join(after, "cand").select(
        "term_id", name.alias("term"), F.lit("vectors").alias("provider"), F.col("k").alias("rank"),
        F.col("cand").cast("string").alias("uri"),
        F.concat(F.lit("item "), F.col("cand").cast("string")).alias("label"), "cand",
        F.lit(None).cast("double").alias("score"), "term_vector", "label_vector", "text_vector")
    out = rank.rank_suggestions(rows, 3, "hybrid")
    return out.select("term_id", "place", "cand", F.round("hybrid_score", 6).alias("hybrid"))


_RESOLVED = """iris AS (SELECT c_custkey AS row_id, CASE c_mktsegment WHEN 'BUILDING' THEN c_name
   WHEN 'MACHINERY' THEN 'https://www.wikidata.org/wiki/Q' || c_custkey
   ELSE 'http://id/' || c_custkey END AS iri FROM customer),
hits AS (SELECT 'http://id/' || o_custkey AS iri, 'portal' AS service, max(o_orderpriority) AS label, 'ORD' AS acronym,
   'http://ui/' || o_custkey AS ui_link, 1 AS ord FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey
 UNION ALL SELECT 'http://id/' || o_custkey, 'ols', min(o_orderpriority), 'ANY',
   CASE WHEN min(o_orderpriority) = '1-URGENT' THEN 'http://ols/' || o_custkey ELSE '' END, 2
   FROM orders GROUP BY o_custkey),
best AS (SELECT *, row_number() OVER (PARTITION BY iri ORDER BY ord) AS n FROM hits WHERE ui_link <> ''),
resolved AS (SELECT i.row_id, i.iri,
 CASE WHEN NOT starts_with(i.iri, 'http') THEN NULL WHEN contains(i.iri, 'wikidata') THEN 'Wikidata Entity' ELSE b.label END AS label,
 CASE WHEN NOT starts_with(i.iri, 'http') THEN NULL WHEN contains(i.iri, 'wikidata') THEN 'WIKIDATA' ELSE b.acronym END AS acronym,
 CASE WHEN NOT starts_with(i.iri, 'http') THEN NULL WHEN contains(i.iri, 'wikidata') THEN i.iri ELSE b.ui_link END AS ui_link,
 CASE WHEN NOT starts_with(i.iri, 'http') THEN 'Error' WHEN contains(i.iri, 'wikidata') THEN 'WIKIDATA'
   WHEN b.iri IS NULL THEN 'None' ELSE upper(b.service) END AS source,
 CASE WHEN NOT starts_with(i.iri, 'http') THEN 'Invalid IRI provided.'
   WHEN NOT contains(i.iri, 'wikidata') AND b.iri IS NULL THEN 'IRI not found in any source.' END AS message
 FROM iris i LEFT JOIN best b ON b.iri = i.iri AND b.n = 1)"""


def _resolved(t):
    key = F.col("c_custkey").cast("string")
    seg = F.col("c_mktsegment")
    iris = t.customer.select(
        F.col("c_custkey").alias("row_id"),
        F.when(seg == "BUILDING", F.col("c_name"))
        .when(seg == "MACHINERY", F.concat(F.lit("https://www.wikidata.org/wiki/Q"), key))
        .otherwise(F.concat(F.lit("http://id/"), key)).alias("iri"))
    c = F.col("o_custkey").cast("string")
    iri = F.concat(F.lit("http://id/"), c).alias("iri")
    portal = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(
        F.max("o_orderpriority").alias("label"))
    portal = portal.select(F.lit("portal").alias("service"), iri, "label", F.lit("ORD").alias("acronym"),
                           F.concat(F.lit("http://ui/"), c).alias("ui_link"))
    ols = t.orders.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("label"))
    found = F.when(F.col("label") == "1-URGENT", F.concat(F.lit("http://ols/"), c)).otherwise("")
    ols = ols.select(F.lit("ols").alias("service"), iri, "label", F.lit("ANY").alias("acronym"),
                     found.alias("ui_link"))
    lookups = portal.unionByName(ols)
    return resolve.resolve_cascade(iris, lookups, ["portal", "ols", "other"], ignore=["OTHER"])


@query(f"WITH {_RESOLVED} SELECT * FROM resolved")
def resolve_cascade(t):
    return _resolved(t)


@query(f"""WITH {_RESOLVED}, found AS (SELECT * FROM resolved WHERE source <> 'None')
SELECT i.row_id, i.iri, s.label, s.acronym, s.ui_link, coalesce(s.source, 'Error') AS source,
 CASE WHEN s.source IS NULL THEN 'Processing failed' ELSE s.message END AS message
FROM iris i LEFT JOIN found s ON s.iri = i.iri""")
def restore_input_order(t):
    done = _resolved(t)
    return resolve.restore_input_order(done.select("row_id", "iri"), done.filter("source <> 'None'"))


@query(f"""WITH {_RESOLVED}
SELECT o_orderkey, 'http://id/' || o_custkey AS "URI", coalesce(r.label, o_orderstatus) AS label,
 coalesce(r.acronym, '') AS acronym, coalesce(r.ui_link, '') AS ui_link, coalesce(r.source, '') AS source,
 coalesce(r.message, '') AS message
FROM orders LEFT JOIN resolved r ON r.iri = 'http://id/' || o_custkey""")
def enrich_mapping(t):
    iri = F.concat(F.lit("http://id/"), F.col("o_custkey").cast("string"))
    mapping = t.orders.select("o_orderkey", iri.alias("URI"), F.col("o_orderstatus").alias("label"))
    return resolve.enrich_mapping(mapping, _resolved(t))


# --- response bodies packed from part, unpacked again ----------------------------------------


def _bodies(t, body, provider="P"):
    # Reading a body is heavy per row.
    return dealt(t.part).select(
        F.col("p_partkey").alias("term_id"), F.col("p_name").alias("term"),
        F.lit(provider).alias("provider") if isinstance(provider, str) else provider, body.alias("body"))


def _shown(df):
    return df.select("term_id", "rank", "uri", "label", "description", "source_provider")


def _key():
    return F.col("p_partkey").cast("string")


@query("""
SELECT p_partkey AS term_id, 0 AS rank, 'http://p/' || p_partkey AS uri, p_name AS label,
 p_type AS description, p_brand AS source_provider FROM part
UNION ALL SELECT p_partkey, 1, 'http://b/' || p_brand, 'N/A', p_type, 'Unknown' FROM part
""")
def portal_suggestions(t):
    first = F.to_json(F.struct(
        F.concat(F.lit("http://p/"), _key()).alias("@id"), F.col("p_name").alias("prefLabel"),
        F.array(F.concat(F.lit(" "), "p_type", F.lit(" ")), F.col("p_name")).alias("definition"),
        F.struct(F.concat(F.lit("https://o.example.org/ontologies/"), F.translate("p_brand", "#", "#"))
                 .alias("ontology")).alias("links")))
    # A '#' would start a fragment in the link, so it is written percent-encoded and shown back.
    first = F.replace(first, F.lit("ontologies/Brand#"), F.lit("ontologies/Brand%23"))
    second = F.to_json(F.struct(F.concat(F.lit("http://b/"), "p_brand").alias("@id"),
                                F.col("p_type").alias("definition")))
    body = F.concat(F.lit('{"collection":['), first, F.lit(","), second, F.lit(',{"prefLabel":"x"}]}'))
    out = responses.portal_suggestions(_bodies(t, body))
    return _shown(out.withColumn("source_provider", F.replace(
        F.col("source_provider"), F.lit("%23"), F.lit("#"))))


@query("""
SELECT p_partkey AS term_id, 0 AS rank, 'http://p/' || p_partkey AS uri, p_name AS label,
 p_type AS description, p_brand AS source_provider FROM part
""")
def ols_suggestions(t):
    doc = F.struct(F.concat(F.lit("http://p/"), _key()).alias("iri"), F.col("p_name").alias("label"),
                   F.array("p_type").alias("description"), F.col("p_brand").alias("ontology_prefix"))
    body = F.to_json(F.struct(F.struct(F.array(doc).alias("docs")).alias("response")))
    return _shown(responses.ols_suggestions(_bodies(t, body)))


@query("""
SELECT p_partkey AS term_id, 0 AS rank, CASE WHEN p_size > 25 THEN 'http://c/' || p_partkey
  ELSE 'http://www.wikidata.org/entity/Q' || p_partkey END AS uri, p_name AS label, '' AS description,
  'Wikidata' AS source_provider FROM part
""")
def entity_search_suggestions(t):
    item = F.struct(
        F.concat(F.lit("Q"), _key()).alias("id"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("http://c/"), _key())).alias("concepturi"),
        F.col("p_name").alias("label"))
    body = F.to_json(F.struct(F.array(item).alias("search")))
    return _shown(responses.entity_search_suggestions(_bodies(t, body)))


@query("""
SELECT p_partkey AS term_id, 0 AS rank, 'http://sws.geonames.org/' || p_partkey || '/' AS uri,
 p_name AS label, CASE WHEN p_size > 25 THEN p_type || ', ' ELSE '' END || p_brand AS description,
 'GeoNames' AS source_provider FROM part WHERE p_partkey <> 0 AND p_size > 5
""")
def place_suggestions(t):
    item = F.struct(
        F.col("p_partkey").alias("geonameId"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("fcodeName"),
        F.col("p_brand").alias("countryName"))
    error = F.when(F.col("p_size") <= 5, F.struct(F.lit("limit").alias("message")))
    body = F.to_json(F.struct(F.array(item).alias("geonames"), error.alias("status")))
    return _shown(responses.place_suggestions(_bodies(t, body)))


@query("""
WITH x AS (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'taxonomy' WHEN 'MEDIUM' THEN 'pubmed'
  WHEN 'STANDARD' THEN 'bioproject' WHEN 'SMALL' THEN 'gene' ELSE 'protein' END AS db FROM part)
SELECT p_partkey AS term_id, 0 AS rank, CASE db
   WHEN 'taxonomy' THEN 'https://www.ncbi.nlm.nih.gov/Taxonomy/Browser/wwwtax.cgi?id=' || p_partkey
   WHEN 'pubmed' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || p_partkey || '/'
   WHEN 'bioproject' THEN 'https://www.ncbi.nlm.nih.gov/bioproject/PRJ' || p_size
   ELSE 'https://www.ncbi.nlm.nih.gov/' || db || '/' || p_partkey END AS uri,
 CASE WHEN db IN ('pubmed', 'protein') THEN p_brand || ' paper' WHEN db = 'taxonomy' THEN 'Unknown taxonomy ' || p_partkey
   ELSE p_name END AS label,
 CASE db WHEN 'taxonomy' THEN 'genus' WHEN 'pubmed' THEN p_name || ' (2020)' WHEN 'gene' THEN 'sum'
   ELSE '' END AS description, 'NCBI ' || db AS source_provider FROM x
""")
def summary_suggestions(t):
    kind = F.col("p_type")
    db = (F.when(kind == "ECONOMY", "taxonomy").when(kind == "MEDIUM", "pubmed")
          .when(kind == "STANDARD", "bioproject").when(kind == "SMALL", "gene").otherwise("protein"))
    item = F.to_json(F.struct(
        F.col("p_name").alias("name"), F.lit("genus").alias("rank"), F.lit("sum").alias("summary"),
        F.concat("p_brand", F.lit(" paper")).alias("title"),
        F.array(F.struct(F.col("p_name").alias("name"))).alias("authors"), F.lit("2020").alias("pubdate"),
        F.concat(F.lit("PRJ"), F.col("p_size").cast("string")).alias("project_acc")))
    body = F.concat(F.lit('{"result":{"uids":["'), _key(), F.lit('","gone"],"'), _key(), F.lit('":'),
                    item, F.lit("}}"))
    return _shown(responses.summary_suggestions(_bodies(t, body, db.alias("provider"))))


@query("""
SELECT p_partkey AS term_id, 0 AS rank, 'http://p/' || p_partkey AS uri, p_name AS label,
 CASE WHEN p_size > 25 THEN p_type ELSE p_brand END AS description, 'AGROVOC' AS source_provider FROM part
""")
def binding_suggestions(t):
    def value(c):
        return F.when(c.isNotNull(), F.struct(c.alias("value")))

    row = F.struct(
        value(F.concat(F.lit("http://p/"), _key())).alias("conceptURI"),
        value(F.col("p_name")).alias("prefLabel"),
        value(F.when(F.col("p_size") > 25, F.col("p_type"))).alias("definitionSample"),
        value(F.col("p_brand")).alias("scopeNoteSample"))
    body = F.to_json(F.struct(F.struct(F.array(row).alias("bindings")).alias("results")))
    return _shown(responses.binding_suggestions(
        _bodies(t, body), "conceptURI", "prefLabel", ("definitionSample", "scopeNoteSample"), "AGROVOC"))


@query("""
SELECT CASE WHEN p_size > 25 THEN 'ols' ELSE 'ontobee' END AS service, 'http://x/obo/GO_' || p_partkey AS iri,
 CASE WHEN p_size > 25 THEN p_name END AS label, CASE WHEN p_size > 25 THEN p_type ELSE 'GO' END AS acronym,
 'https://ui/' || CASE WHEN p_size > 25 THEN p_type ELSE 'GO' END || '?iri=http%3A%2F%2Fx%2Fobo%2FGO_' || p_partkey AS ui_link
FROM part WHERE p_size > 25 OR p_size < 10
""")
def iri_lookups(t):
    iri = F.concat(F.lit("http://x/obo/GO_"), _key())
    doc = F.struct(iri.alias("iri"), F.col("p_name").alias("label"), F.lower("p_type").alias("ontology_name"))
    docs = F.to_json(F.struct(F.struct(F.array(doc).alias("docs")).alias("response")))
    big = F.col("p_size") > 25
    yes = F.when(F.col("p_size") < 10, '{"boolean": true}').otherwise('{"boolean": false}')
    bodies = t.part.select(F.when(big, "ols").otherwise("ontobee").alias("service"), iri.alias("iri"),
                           F.when(big, docs).otherwise(yes).alias("body"))
    link_to = "https://ui/{acronym}?iri={encoded_iri}"
    return responses.iri_lookups(bodies, {"ols": link_to, "ontobee": link_to})


@query("SELECT DISTINCT upper(c_name) AS acronym FROM customer UNION SELECT upper(s_name) FROM supplier")
def ontology_list(t):
    flat = t.customer.select(F.to_json(F.array(F.struct(F.col("c_name").alias("acronym")))).alias("body"))
    inner = F.struct(F.array(F.struct(F.concat(F.lit(" "), "s_name").alias("ontologyId"))).alias("ontologies"))
    deep = t.supplier.select(F.to_json(F.struct(inner.alias("_embedded"))).alias("body"))
    return responses.ontology_list(flat.unionByName(deep))


# --- patterns over quads made from part ------------------------------------------------------


def part_vocabulary(t):
    """Labelled, typed and described part concepts as quads."""
    s = F.concat(F.lit("http://p/"), F.col("p_partkey").cast("string"))
    label = F.concat_ws(" ", "p_name", "p_brand")
    kind = F.when(F.col("p_size") > 25, F.lit(V.QUDT + "Unit")).otherwise(V.SKOS + "Concept")
    return explode_facts(t.part, F.lit("http://g/parts"), [
        fact(s, V.RDF_TYPE, kind, "iri"),
        fact(s, V.RDFS_LABEL, label, lang="en"),
        fact(s, V.PREF_LABEL, F.when(F.col("p_size") <= 25, label), lang="en"),
        fact(s, V.ALT_LABEL, F.upper("p_type"), lang="en"),
        fact(s, V.SKOS + "altLabel", F.concat(F.lit("alt "), "p_name")),
        fact(s, V.RDFS_COMMENT, F.when(F.col("p_size") > 40, F.col("p_type")), lang="de"),
        fact(s, V.SKOS + "scopeNote", F.col("p_brand"), lang="en"),
        fact(s, V.DC + "title", F.col("p_name"), lang="de"),
    ])


def _words(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("term")).distinct()


_WORDS = "words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)"
_HITS = """hits AS (SELECT term, 'http://p/' || p_partkey AS uri, p_name || ' ' || p_brand AS label,
  CASE WHEN p_size > 40 THEN p_type END AS description FROM part JOIN words ON contains(lower(p_name || ' ' || p_brand), term) {}),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY uri, label, description NULLS FIRST) AS rank FROM hits)
SELECT term, uri, label, description, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 7"""


@query(f"WITH {_WORDS}, {_HITS.format('')}")
def label_contains(t):
    return patterns.label_contains(_words(t), part_vocabulary(t), 7)


@query(f"WITH {_WORDS}, {_HITS.format('WHERE p_size > 25')}")
def typed_label_contains(t):
    return patterns.typed_label_contains(_words(t), part_vocabulary(t), limit=7)


@query(f"""WITH {_WORDS}, types AS (SELECT DISTINCT lower(p_type) AS term FROM part),
asked AS (SELECT term FROM words UNION SELECT term FROM types),
hits AS (SELECT term, 'http://p/' || p_partkey AS uri, p_name || ' ' || p_brand AS label, p_brand AS description
 FROM part JOIN asked ON contains(lower(p_name || ' ' || p_brand), term) OR lower(p_type) = term
   OR contains(lower(p_type), term)
 WHERE p_size <= 25),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY uri) AS rank FROM hits)
SELECT term, uri, label, description, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 7""")
def concept_search(t):
    kinds = t.part.select(F.lower("p_type").alias("term")).distinct()
    asked = _words(t).unionByName(kinds).distinct()
    return patterns.concept_search(asked, part_vocabulary(t), limit=7)


@query("""
SELECT 'http://p/' || p_partkey AS uri, p_name || ' ' || p_brand AS label,
 CASE WHEN p_size > 40 THEN p_type ELSE '' END AS description FROM part
""")
def extract_entities(t):
    return link.extract_entities(part_vocabulary(t))


@query("""
SELECT 'http://p/' || p_partkey AS uri, upper(p_type) AS name FROM part
UNION SELECT 'http://p/' || p_partkey, 'alt ' || p_name FROM part
""")
def entity_synonyms(t):
    return link.entity_synonyms(part_vocabulary(t))


@query("""
WITH s AS (SELECT 'a' AS src, 0 AS res, c_mktsegment AS term_id, c_name AS uri, c_acctbal AS score FROM customer
 UNION ALL SELECT 'b', 1, CASE WHEN s_nationkey < 12 THEN 'BUILDING' ELSE 'FURNITURE' END, s_name, s_acctbal FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY src, term_id ORDER BY score DESC, uri) AS rank FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY score DESC, res, rank) AS place FROM r)
SELECT term_id, uri, CAST(place AS INTEGER) AS rank, score FROM m WHERE place <= 8
""")
def merge_resources_topk(t):
    def ranked(df):
        order = Window.partitionBy("term_id").orderBy(F.desc("score"), "uri")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 8)

    a = t.customer.select(F.col("c_mktsegment").alias("term_id"), F.col("c_name").alias("uri"),
                          F.col("c_acctbal").alias("score"))
    term = F.when(F.col("s_nationkey") < 12, "BUILDING").otherwise("FURNITURE")
    b = t.supplier.select(term.alias("term_id"), F.col("s_name").alias("uri"),
                          F.col("s_acctbal").alias("score"))
    return link.merge_resources_topk([ranked(a), ranked(b)], 8).select("term_id", "uri", "rank", "score")
