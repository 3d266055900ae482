"""Language identification by fusing evidence: text, declared language, address and host.

Text likelihoods are naive Bayes over hashed byte trigrams of letters, counted over all documents of
known language. A text's likelihood counts as much as ``WEIGHT`` trigrams at most, so that a long text
leaves the other evidence a say. Text labels then vote in grouped aggregates: for each declared
language how often each language declares it, and for each host the mix of languages, smoothed towards
its address suffix and that towards the whole; a row's own vote is left out of its host's.
The posterior is proportional to text likelihood, declaration likelihood and host prior.

The model has ``languages x 2 ** CODE_BITS`` counts whatever the data; only it reaches the driver.
Votes are integers, so reruns agree. Joins are on host and declared language with one row for each on
the other side, which adaptive execution splits for a hot host.

Null or empty texts have no trigrams and rest on the other evidence; a null declaration is a kind of
its own, as are null hosts and suffixes. Ties go to the first language of the list. Rows keep their
other columns; an added column replaces one of its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tablegraph.llm.frame import quoted, tuned
from tablegraph.session import checkpoint

LANGUAGES = ("de", "en", "es", "fr")
CODE_BITS = 14
WEIGHT = 60
SMOOTH = 8.0

# Letters in lower case, anything else of ASCII as a blank, bytes of longer characters as they are.
FOLD = np.array(
    [32 if b < 128 and not chr(b).isalpha() else ord(chr(b).lower()) if b < 128 else b
     for b in range(256)], np.uint32)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all texts in one stream, and the text of each."""
    data = [x.encode() for x in texts.fill_null("").to_pylist()]
    sizes = np.array([len(x) for x in data], np.int64)
    stream = FOLD[np.frombuffer(b"".join(data), np.uint8)]
    of = np.repeat(np.arange(len(data)), sizes)
    if len(stream) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = stream[:-2], stream[1:-1], stream[2:]
    whole = (of[:-2] == of[2:]) & ~((a == 32) & (b == 32)) & ~((b == 32) & (c == 32))
    code = ((a << np.uint32(16)) | (b << np.uint32(8)) | c) * np.uint32(2654435761)
    return (code >> np.uint32(32 - CODE_BITS))[whole].astype(np.int64), of[:-2][whole]


def trained(known: DataFrame, languages=LANGUAGES, text_col: str = "text",
            lang_col: str = "lang") -> np.ndarray:
    """Log probability of each code in each language, from all rows of known language."""
    size = 1 << CODE_BITS
    rows = known.select(
        quoted(lang_col).alias("lang"), quoted(text_col).alias("text")).where(F.col("lang").isin(*languages))

    def count(batches):
        held = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            place = {x: i for i, x in enumerate(languages)}
            langs = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            codes, of = trigrams(batch.column(1))
            held += np.bincount(langs[of] * size + codes, minlength=held.size).reshape(held.shape)
        lang, code = np.nonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(code, pa.int32()), pa.array(held[lang, code], pa.int64())],
            names=["lang", "code", "n"])

    counted = rows.mapInArrow(count, "lang int, code int, n long")
    table = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = np.full((len(languages), size), 0.5)
    got = table.toArrow()  # at most languages x 2 ** CODE_BITS rows
    counts[got["lang"].to_numpy(), got["code"].to_numpy()] += got["n"].to_numpy()
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def scored(df: DataFrame, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows without their text, with ``_scores``: the text's log likelihood for each language."""
    kept = [f for f in df.schema.fields if f.name != text_col]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    kind = ArrayType(DoubleType())

    def run(batches):
        table = shared.value
        for batch in batches:
            codes, of = trigrams(batch.column(batch.schema.get_field_index(text_col)))
            n = np.bincount(of, minlength=batch.num_rows)
            weight = np.minimum(n, WEIGHT) / np.maximum(n, 1)
            sums = np.stack([
                np.bincount(of, row[codes], minlength=batch.num_rows) * weight for row in table], axis=1)
            offsets = np.arange(0, sums.size + 1, len(table), dtype=np.int32)
            scores = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.round(sums, 6).reshape(-1)))
            columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, scores], names=[*names, "_scores"])

    return df.mapInArrow(run, StructType([*kept, StructField("_scores", kind)]))


def best(scores: Column) -> Column:
    """Place of the largest score, the first on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def fused(rows: DataFrame, languages=LANGUAGES) -> DataFrame:
    """``row, lang, prob, text_lang`` from ``row, _scores, declared, suffix, host``."""
    size = len(languages)
    given = rows.select(
        "row", "_scores", best(F.col("_scores")).alias("vote"),
        *[F.coalesce(c, F.lit("\0")).alias(c) for c in ("declared", "suffix", "host")])

    def votes(*by: str) -> DataFrame:
        return given.groupBy(*by).agg(F.array(*[
            F.count_if(F.col("vote") == i) for i in range(size)]).alias("n"))

    def smoothed(n: str, prior: str) -> Column:
        total = F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x)
        return F.zip_with(n, prior, lambda x, p: (x + SMOOTH * p) / (total + SMOOTH))

    # Few rows: all, then one for each suffix, then one for each host.
    hosts = votes("suffix", "host").withColumnRenamed("n", "host_n")
    whole = votes().withColumn("all_p", F.transform("n", lambda x: (x + 1.0) / (
        F.aggregate("n", F.lit(0).cast("long"), lambda s, y: s + y) + size))).select(
        "all_p", F.col("n").alias("all_n"))
    suffixes = votes("suffix").join(F.broadcast(whole)).select(
        F.col("suffix").alias("s"), smoothed("n", "all_p").alias("suffix_p"))
    hosts = hosts.join(suffixes, F.col("suffix") == F.col("s")).drop("s").select(
        F.col("suffix").alias("s"), F.col("host").alias("h"), "host_n", "suffix_p")
    said = votes("declared").join(F.broadcast(whole)).select(
        F.col("declared").alias("d"),
        F.zip_with("n", "all_n", lambda x, t: (x + 1.0) / (t + 1.0 + size)).alias("said_p"))
    met = given.join(hosts, (F.col("host") == F.col("h")) & (F.col("suffix") == F.col("s"))).join(
        said, F.col("declared") == F.col("d"))
    others = F.transform("host_n", lambda n, i: F.when(i == F.col("vote"), n - 1).otherwise(n))
    met = met.withColumn("others", others).withColumn("prior", smoothed("others", "suffix_p"))
    whole_score = F.zip_with(
        F.zip_with("_scores", "said_p", lambda s, p: s + F.log(p)), "prior", lambda s, p: s + F.log(p))
    met = met.withColumn("fused", whole_score)
    names = F.array(*[F.lit(x) for x in languages])
    spread = F.aggregate(
        F.transform("fused", lambda s: F.exp(s - F.array_max("fused"))), F.lit(0.0), lambda s, x: s + x)
    return met.select(
        "row", F.get(names, best(F.col("fused"))).alias("lang"),
        F.round(1 / spread, 4).alias("prob"), F.get(names, F.col("vote")).alias("text_lang"))


def identified(rows: DataFrame, known: DataFrame, languages=LANGUAGES) -> DataFrame:
    """The rows without their text, with ``lang, prob, text_lang``.

    ``rows`` has ``text, declared, suffix, host``; ``known`` has ``text, lang``.
    """
    tuned(rows.sparkSession)
    model = trained(known, languages)
    evidence = ["text", "declared", "suffix", "host"]
    others = [c for c in rows.columns if c not in (*evidence, "lang", "prob", "text_lang")]
    narrow = rows.select(
        F.struct(*[quoted(c).alias(c) for c in others]).alias("row"), *[quoted(c) for c in evidence])
    done = fused(checkpoint(scored(narrow, model)), languages)
    return done.select(*[F.col("row").getField(c).alias(c) for c in others], "lang", "prob", "text_lang")


def page_evidence(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """The pages with ``text, declared, suffix, host`` instead of their markup and address.

    The suffix is the host's last label with a two-letter first folder, as ``com/fr``.
    """
    html, url = quoted(html_col), quoted(url_col)
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    host = F.lower(F.regexp_extract(url, r"://([^/?#:]+)", 1))
    folder = F.lower(F.regexp_extract(url, r"://[^/?#]+/([A-Za-z]{2})(?=[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    others = [c for c in pages.columns if c not in (html_col, url_col)]
    return pages.select(
        *[quoted(c) for c in others], body.alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"),
        F.concat(F.regexp_extract(host, r"([^.]*)$", 1), F.lit("/"), folder).alias("suffix"),
        F.nullif(host, F.lit("")).alias("host"))
