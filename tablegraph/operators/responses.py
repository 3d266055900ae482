"""Saved response bodies to suggestion rows, by body shape.

Input: ``term_id, term, provider, body``. Output: ``term_id, term, provider, rank, uri, label,
description, score, source_provider, ontology``. ``rank`` is the place in the body, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph.functions.text import first_filled, obo_acronym, py_strip, repository_iri, ui_link

OUTPUT = [
    "term_id", "term", "provider", "rank", "uri", "label", "description", "score",
    "source_provider", "ontology",
]


def _first_text(json_value: Column) -> Column:
    """First entry of a list, a plain string as it is, else empty."""
    listed = F.get(F.from_json(json_value, "array<string>"), F.lit(0))
    is_list = json_value.startswith("[")
    return F.coalesce(F.when(is_list, listed).otherwise(json_value), F.lit(""))


def _items(bodies: DataFrame, path: str) -> DataFrame:
    """One row per element of the list at a JSON path, the element kept as JSON text."""
    listed = F.from_json(F.get_json_object("body", path), "array<string>")
    rows = bodies.select("term_id", "term", "provider", F.posexplode_outer(listed).alias("rank", "item"))
    # A plain explosion would test the parsed list in a filter next to the files, before any shuffle.
    return rows.filter(F.col("rank").isNotNull())


def _field(name: str) -> Column:
    return F.get_json_object("item", f"$['{name}']")


def _finish(rows: DataFrame, uri, label, description, source, ontology=None) -> DataFrame:
    out = rows.select(
        "term_id", "term", "provider", "rank",
        uri.alias("uri"), label.alias("label"), description.alias("description"),
        F.lit(None).cast("double").alias("score"), source.alias("source_provider"),
        (ontology if ontology is not None else F.lit(None).cast("string")).alias("ontology"),
    )
    return out.filter(F.coalesce(F.col("uri"), F.lit("")) != "")


def portal_suggestions(bodies: DataFrame) -> DataFrame:
    """Ontology portals: ``collection[]`` with ``@id, prefLabel, definition, links.ontology``."""
    rows = _items(bodies, "$.collection")
    link = F.get_json_object("item", "$.links.ontology")
    path = F.regexp_extract(link, r"^(?:[a-z]+://[^/?#]+)?([^?#]*)", 1)
    acronym = F.when(
        F.coalesce(link, F.lit("")) != "", F.substring_index(path, "/", -1)
    ).otherwise("Unknown")
    return _finish(
        rows, _field("@id"), F.coalesce(_field("prefLabel"), F.lit("N/A")),
        py_strip(_first_text(_field("definition"))), acronym, acronym,
    )


def ols_suggestions(bodies: DataFrame, fallback: str = "Unknown") -> DataFrame:
    """``response.docs[]`` with ``iri, label, description, ontology_prefix``."""
    rows = _items(bodies, "$.response.docs")
    prefix = F.coalesce(_field("ontology_prefix"), F.lit(fallback))
    return _finish(
        rows, _field("iri"), F.coalesce(_field("label"), F.lit("N/A")),
        py_strip(_first_text(_field("description"))), prefix, prefix,
    )


def named_ols_suggestions(bodies: DataFrame, fallback: str = "SemLookP") -> DataFrame:
    """As :func:`ols_suggestions`; the source is the prefix, else the ontology name."""
    rows = _items(bodies, "$.response.docs")
    source = F.coalesce(
        first_filled(_field("ontology_prefix"), _field("ontology_name")), F.lit(fallback)
    )
    listed = _field("description")
    text = F.when(listed.startswith("["), _first_text(listed)).otherwise("")
    return _finish(
        rows, _field("iri"), F.coalesce(_field("label"), F.lit("N/A")), py_strip(text),
        source, source,
    )


def entity_search_suggestions(bodies: DataFrame, source: str = "Wikidata") -> DataFrame:
    """``search[]`` with ``concepturi`` (else built from ``id``), ``label, description``."""
    rows = _items(bodies, "$.search")
    built = F.concat(F.lit("http://www.wikidata.org/entity/"), F.nullif(_field("id"), F.lit("")))
    return _finish(
        rows, F.coalesce(F.nullif(_field("concepturi"), F.lit("")), built),
        F.coalesce(_field("label"), F.lit("N/A")),
        F.coalesce(_field("description"), F.lit("")), F.lit(source),
    )


def place_suggestions(bodies: DataFrame, source: str = "GeoNames") -> DataFrame:
    """``geonames[]``; a body with a ``status`` object is an error and gives nothing."""
    status = F.get_json_object("body", "$.status")
    good = bodies.filter(~F.coalesce(status.startswith("{"), F.lit(False)))
    rows = _items(good, "$.geonames")
    place = F.nullif(F.nullif(_field("geonameId"), F.lit("")), F.lit("0"))
    parts = F.array(*[F.nullif(_field(f), F.lit(""))
                      for f in ("fcodeName", "adminName1", "countryName")])
    out = _finish(
        rows,
        F.concat(F.lit("http://sws.geonames.org/"), place, F.lit("/")),
        F.coalesce(_field("toponymName"), _field("name")),
        F.array_join(parts, ", "), F.lit(source),
    )
    return out.filter(F.coalesce(F.col("label"), F.lit("")) != "")


# Label and description fields per record database, in order of preference.
_SUMMARY_FIELDS = {
    "taxonomy": (["scientificname"], ["rank"]),
    "bioproject": (["name", "project_title"], ["project_description"]),
    "gene": (["name"], ["description", "summary"]),
    "protein": (["title"], ["organism"]),
    "nuccore": (["title"], ["organism"]),
    "biosample": (["accession"], ["description"]),
    "sra": (["title"], ["description"]),
    "pubmed": (["title"], []),
}


def summary_suggestions(bodies: DataFrame) -> DataFrame:
    """Record summaries: ``result{uids[], <uid>{…}}``; the provider column names the database."""
    result = F.from_json(F.get_json_object("body", "$.result"), "map<string,string>")
    base = bodies.select("term_id", "term", "provider", result.alias("result"))
    listed = F.from_json(F.try_element_at("result", F.lit("uids")), "array<string>")
    # Records are looked up inside the list, so that no test of the body is pushed next to the files.
    found = F.transform(listed, lambda uid: F.struct(
        uid.alias("uid"), F.try_element_at("result", uid).alias("item")))
    rows = base.select("term_id", "term", "provider", F.posexplode_outer(found).alias("rank", "_found"))
    rows = rows.select("term_id", "term", "provider", "rank", "_found.uid", "_found.item")
    rows = rows.filter(F.col("item").isNotNull())
    db = F.col("provider")
    unknown = F.concat(F.lit("Unknown "), db, F.lit(" "), "uid")

    def choose(which: int, default: Column) -> Column:
        out = default
        for name, fields in _SUMMARY_FIELDS.items():
            if fields[which]:
                value = F.coalesce(*[_field(f) for f in fields[which]], default)
                out = F.when(db == name, value).otherwise(out)
        return out

    author = F.coalesce(F.get_json_object("item", "$.authors[0].name"), F.lit(""))
    date = F.nullif(_field("pubdate"), F.lit(""))
    paper = F.concat(author, F.coalesce(F.concat(F.lit(" ("), date, F.lit(")")), F.lit("")))
    description = F.when(db == "pubmed", paper).otherwise(choose(1, F.lit("")))
    record = (
        F.when(db == "bioproject", F.coalesce(F.nullif(_field("project_acc"), F.lit("")), "uid"))
        .when(db == "biosample", F.coalesce(_field("accession"), F.col("uid")))
        .otherwise(F.col("uid"))
    )
    return _finish(
        rows, repository_iri(db, record), choose(0, unknown), description,
        F.concat(F.lit("NCBI "), db),
    )


def binding_suggestions(
    bodies: DataFrame,
    uri: str = "uri",
    label: str = "label",
    descriptions: tuple[str, ...] = ("description",),
    source: str = "Custom SPARQL",
) -> DataFrame:
    """Query results ``results.bindings[]``; IRI and label variables are required."""
    listed = F.from_json(
        F.get_json_object("body", "$.results.bindings"),
        "array<map<string,struct<value:string>>>",
    )
    rows = bodies.select("term_id", "term", "provider", F.posexplode_outer(listed).alias("rank", "b"))
    rows = rows.filter(F.col("rank").isNotNull())

    def value(name: str) -> Column:
        return F.nullif(F.try_element_at("b", F.lit(name))["value"], F.lit(""))

    text = F.coalesce(*[value(d) for d in descriptions], F.lit(""))
    out = _finish(rows, value(uri), value(label), text, F.lit(source))
    return out.filter(F.col("label").isNotNull())


def iri_lookups(bodies: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Lookup bodies ``service, iri, body`` to ``service, iri, label, acronym, ui_link``.

    A body answers for its own IRI only: the portal entry with that ``@id``, the document with
    that ``iri``, or a true ``boolean``. Each service names its link template.
    """
    table = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    base = bodies.withColumn("template", F.try_element_at(table, F.col("service")))

    def first_match(path: str, key: str) -> Column:
        listed = F.from_json(F.get_json_object("body", path), "array<string>")
        return F.get(
            F.filter(listed, lambda x: F.get_json_object(x, f"$['{key}']") == F.col("iri")),
            F.lit(0),
        )

    base = base.select(
        "service", "iri", "template",
        first_match("$.collection", "@id").alias("entry"),
        first_match("$.response.docs", "iri").alias("doc"),
        (F.get_json_object("body", "$.boolean") == "true").alias("yes"),
    )
    link = F.rtrim(F.get_json_object("entry", "$.links.ontology"))
    portal = F.upper(F.substring_index(F.regexp_replace(link, "/+$", ""), "/", -1))
    rows = base.select(
        "service", "iri", "template",
        F.when(F.col("entry").isNotNull(), F.get_json_object("entry", "$.prefLabel"))
        .when(F.col("doc").isNotNull(), F.get_json_object("doc", "$.label"))
        .alias("label"),
        F.when(F.col("entry").isNotNull(), F.coalesce(portal, F.lit("")))
        .when(
            F.col("doc").isNotNull(),
            F.coalesce(F.upper(F.get_json_object("doc", "$.ontology_name")), F.lit("")),
        )
        .when(F.col("yes"), obo_acronym(F.col("iri")))
        .alias("acronym"),
    ).filter(F.col("acronym").isNotNull())
    return rows.select(
        "service", "iri", "label", "acronym",
        ui_link(F.col("template"), F.col("acronym"), F.col("iri")).alias("ui_link"),
    )


def ontology_list(bodies: DataFrame) -> DataFrame:
    """``acronym``: sorted upper-case names from a list body or an embedded list body."""
    flat = F.from_json("body", "array<struct<acronym:string>>")
    embedded = F.from_json(
        F.get_json_object("body", "$._embedded.ontologies"), "array<struct<ontologyId:string>>"
    )
    names = F.when(F.ltrim("body").startswith("["), F.transform(flat, lambda x: x["acronym"]))
    names = names.otherwise(F.transform(embedded, lambda x: x["ontologyId"]))
    rows = bodies.select(F.explode(names).alias("acronym"))
    return (
        rows.select(F.upper(py_strip(F.col("acronym"))).alias("acronym"))
        .filter(F.col("acronym") != "").distinct().orderBy("acronym")
    )
