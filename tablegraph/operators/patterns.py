"""Label searches over the quads table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegraph import vocab as V
from tablegraph.session import parallel_tasks


def _top_per_term(rows: DataFrame, limit: int) -> DataFrame:
    window = Window.partitionBy("term").orderBy(
        "uri", "label", F.col("description").asc_nulls_first()
    )
    ranked = rows.withColumn("rank", F.row_number().over(window))
    return ranked.filter(F.col("rank") <= limit)


def _grams(c: Column, size: int) -> Column:
    """Distinct substrings of a length; empty for a shorter text."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))),
                      lambda i: i <= F.length(c) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(size))))


def contains_join(terms: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Label rows with each distinct ``term`` they contain, any case; no cross join.

    A text that contains a term contains all its grams, so each term asks under its rarest one
    (three characters, fewer for shorter terms) and only those labels are checked in full.
    """
    texts = labels.select(F.lower(F.col(column)).alias("_text")).distinct()
    asked = terms.select("term", F.lower("term").alias("_term")).distinct()
    asked = asked.filter(F.col("_term") != "")
    size = F.least(F.length("_term"), F.lit(3))
    own = F.when(size == 1, _grams(F.col("_term"), 1)).when(
        size == 2, _grams(F.col("_term"), 2)
    ).otherwise(_grams(F.col("_term"), 3))
    options = asked.select("term", "_term", F.explode(own).alias("_gram"))
    needed = options.select("_gram").distinct()
    every = F.concat(*[_grams(F.col("_text"), n) for n in (1, 2, 3)])
    index = texts.select("_text", F.explode(every).alias("_gram")).join(needed, "_gram", "left_semi")
    counts = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # A gram no label has makes the term unfindable; the inner join then leaves it out.
    found = options.join(counts, "_gram", "left").groupBy("term", "_term").agg(
        F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), F.col("_gram"))).alias("_gram")
    )
    hits = found.join(index, "_gram").filter(F.col("_text").contains(F.col("_term")))
    hits = hits.select("term", "_text")
    return labels.join(hits, F.lower(F.col(column)) == F.col("_text")).drop("_text")


# Characters that make a search term a pattern instead of plain text.
_META = r"[\\^$.|?*+()\[\]{}]"


# Letters that a pattern without regard to case meets although lower-casing keeps them apart.
_ODD_CASE = "[\u017f\u0131\u0130\u212a]"


def required_run(pattern: Column) -> Column:
    """The longest stretch of plain characters, in lower case, that every match of a pattern holds.

    Null where none can be told: alternatives, flags, and classes that begin with a bracket are not looked
    into. Classes, groups, escapes and characters that may be absent only end a stretch.
    """
    cut = F.regexp_replace(pattern, r"\\[^A-Za-z0-9]", "\0")
    cut = F.regexp_replace(cut, r"\\(?:[pPxuNk]\{[^}]*\}|[pP].|x..|u....|k<[^>]*>|.)", "\0")
    cut = F.regexp_replace(cut, r"\[[^\[\]]*\]", "\0")
    for _ in range(4):  # nested groups from the inside; what is nested deeper stays and is refused
        cut = F.regexp_replace(cut, r"\([^()]*\)", "\0")
    left = cut
    cut = F.regexp_replace(cut, r"(?s).(?:[?*]|\{[^}]*\})[?+]?", "\0")
    cut = F.regexp_replace(cut, r"(?s)(.)\+[?+]?", "$1\0")
    runs = F.split(F.regexp_replace(cut, r"[.^$]", "\0"), "\0")
    runs = F.filter(runs, lambda r: r.rlike(r"^[\x20-\x7E]+$"))
    best = F.get(F.array_sort(F.transform(
        runs, lambda r: F.struct((-F.length(r)).alias("n"), F.lower(r).alias("run")))), F.lit(0))["run"]
    sure = ~left.rlike(r"[|()\[\]]") & ~pattern.rlike(r"\(\?[a-zA-Z-]|\[\^?\]|\\[QEc0-9]")
    return F.when(sure, best)


def pattern_join(terms: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """As :func:`contains_join`, but a term may be a pattern.

    A pattern asks the grams for the plain characters that any match of it holds, and is tested on the labels
    that have them. Patterns without such characters, and the few labels with letters whose case folds
    oddly, meet in a join dealt over the shuffle width by a salt, so no side is broadcast whole.
    """
    plain = contains_join(terms.filter(~F.col("term").rlike(_META)), labels, column)
    patterns = terms.filter(F.col("term").rlike(_META)).select("term").distinct()
    patterns = patterns.withColumn("_run", required_run(F.col("term")))
    test = F.rlike(F.col(column), F.concat(F.lit("(?iu)"), F.col("term")))
    names = [F.col(f"`{c}`") for c in labels.columns]
    odd = F.coalesce(F.col(column).rlike(_ODD_CASE), F.lit(False))
    runs = patterns.where("_run IS NOT NULL")
    asked = runs.select(F.col("_run").alias("term")).distinct()
    held = contains_join(asked, labels.where(~odd), column).withColumnRenamed("term", "_held")
    by_run = held.join(runs, F.col("_held") == F.col("_run")).where(test).select("term", *names)
    width = parallel_tasks(labels)

    def salted(some: DataFrame, rows: DataFrame) -> DataFrame:
        left = some.select("term", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_salt"))
        right = rows.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(width)).cast("int"))
        return right.join(left, "_salt").where(test).select("term", *names)

    rest = salted(patterns.where("_run IS NULL"), labels).unionByName(salted(runs, labels.where(odd)))
    found = by_run.unionByName(rest)
    return plain.unionByName(found, allowMissingColumns=True)


def label_contains(terms: DataFrame, quads: DataFrame, limit: int = 10) -> DataFrame:
    """``term, uri, label, description, rank``: labels that contain the term, any case."""
    labels = quads.filter(F.col("p").isin(V.PREF_LABEL, V.RDFS_LABEL))
    labels = labels.select(F.col("s").alias("uri"), F.col("o").alias("label")).distinct()
    texts = quads.filter(F.col("p").isin(V.SKOS + "definition", V.RDFS_COMMENT))
    texts = texts.select(F.col("s").alias("uri"), F.col("o").alias("description")).distinct()
    hits = contains_join(terms, labels, "label")
    return _top_per_term(hits.join(texts, "uri", "left"), limit)


def typed_label_contains(
    terms: DataFrame,
    quads: DataFrame,
    classes: tuple[str, ...] = (V.QUDT + "Unit", V.QUDT + "QuantityKind"),
    lang: str = "en",
    limit: int = 10,
) -> DataFrame:
    """As :func:`label_contains` for instances of the given classes and labels of one language."""
    typed = quads.filter((F.col("p") == V.RDF_TYPE) & F.col("o").isin(list(classes)))
    typed = typed.select(F.col("s").alias("uri")).distinct()
    labels = quads.filter((F.col("p") == V.RDFS_LABEL) & (F.col("o_lang") == lang))
    labels = labels.select(F.col("s").alias("uri"), F.col("o").alias("label")).distinct()
    texts = quads.filter(F.col("p") == V.RDFS_COMMENT)
    texts = texts.select(F.col("s").alias("uri"), F.col("o").alias("description")).distinct()
    hits = contains_join(terms, labels.join(typed, "uri"), "label")
    return _top_per_term(hits.join(texts, "uri", "left"), limit)


def concept_search(
    terms: DataFrame, quads: DataFrame, lang: str = "en", limit: int = 10
) -> DataFrame:
    """``term, uri, label, description, rank`` of concepts found by any of their labels.

    The term is a case-insensitive pattern over preferred and alternative labels in the language;
    shown are the preferred label and one definition, else one scope note.
    """
    def in_lang(predicate: str, name: str) -> DataFrame:
        tag = F.lower(F.coalesce(F.col("o_lang"), F.lit("")))
        match = (tag == lang) | tag.startswith(lang + "-")
        rows = quads.filter((F.col("p") == predicate) & match)
        return rows.select(F.col("s").alias("uri"), F.col("o").alias(name)).distinct()

    concepts = quads.filter((F.col("p") == V.RDF_TYPE) & (F.col("o") == V.SKOS + "Concept"))
    concepts = concepts.select(F.col("s").alias("uri")).distinct()
    pref = in_lang(V.PREF_LABEL, "label")
    names = in_lang(V.PREF_LABEL, "name").unionByName(in_lang(V.ALT_LABEL, "name"))
    names = names.join(concepts, "uri", "left_semi").distinct()
    found = pattern_join(terms, names, "name").select("term", "uri").distinct()
    definition = in_lang(V.SKOS + "definition", "definition")
    definition = definition.groupBy("uri").agg(F.min("definition").alias("definition"))
    note = in_lang(V.SKOS + "scopeNote", "note")
    note = note.groupBy("uri").agg(F.min("note").alias("note"))
    rows = found.join(pref, "uri").join(definition, "uri", "left").join(note, "uri", "left")
    rows = rows.select("term", "uri", "label", F.coalesce("definition", "note").alias("description"))
    return _top_per_term(rows, limit)
