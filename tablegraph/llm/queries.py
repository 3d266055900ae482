"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tablegraph.llm import bpe, chat, collocations, divergence, jaccard, language, media, mixing, phrases, pii, quality, suffixes, urls
from tablegraph.llm.frame import tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a session and a folder of tables under its own name."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tuned(spark), folder)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


# The words of a text and, for DuckDB, their list.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(rf"""
WITH w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
),
firsts AS (SELECT win, min(doc_id) AS f FROM win GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (win)
  WHERE f < doc_id
),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op4_repeated_phrases(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    return phrases.drop_repeated(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@query(r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w
        WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g
   AND x.doc_id < y.doc_id GROUP BY 1, 2
),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)
),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT a AS id, a AS seen FROM both_ways UNION
  SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a
),
comp AS (SELECT id, min(seen) AS c FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.id = w.doc_id
""")
def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    return jaccard.classes(docs).withColumnRenamed("id", "doc_id")


@query()
def op10_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    return suffixes.drop_passages(docs).select(
        "doc_id", "n_words", "n_removed", "removed", F.sha2("text", 256).alias("text_sha256")
    )


@query()
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.judged(docs, labels, with_text=False).drop("lang")


@query()
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = documents(spark, folder, "doc_id", "text")
    return bpe.round_trip(docs, path).select(
        "doc_id", F.floor(F.octet_length("ids_bytes") / 4).alias("n_tokens"),
        F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text", "source")
    return mixing.mixed(docs, carry=["doc_id"])


@query(r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
    4 + len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS cost,
    23 + length(replace(role, '\', '\\')) + len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]'))
      + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]')) AS chars
  FROM given
),
t AS (
  SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY place) - cost AS a,
    sum(cost) OVER (PARTITION BY conv_id ORDER BY place) AS b FROM placed
),
-- A window: the new turns of a block of 256 that lie in one stretch of 512 tokens, or cross an edge.
opened AS (
  SELECT conv_id, place // 256 AS block,
    CASE WHEN a // 512 = (b - 1) // 512 THEN 2 * (a // 512) ELSE 2 * (a // 512) + 1 END AS win,
    min(a) AS first, min(place) AS fresh_from, max(place) AS fresh_to, sum(chars) AS chars
  FROM t GROUP BY ALL
),
-- The first system turn up to the end of the block leads, unless it is part of the window anyway.
seen AS (
  SELECT w.conv_id, w.block, w.win, min(s.place) AS place FROM opened w
  JOIN t s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.role = 'system' AND s.place // 256 <= w.block
  GROUP BY ALL
),
windows AS (
  SELECT w.*, coalesce((SELECT sum(c.chars) FROM t c WHERE c.conv_id IS NOT DISTINCT FROM w.conv_id
      AND c.b <= w.first AND c.a >= w.first - 128), 0) AS context_chars, s.place AS system_place
  FROM opened w LEFT JOIN seen s
    ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.block = w.block AND s.win = w.win
),
formatted AS (
  SELECT w.conv_id, sum(w.chars + w.context_chars + CASE
    WHEN s.place IS NULL OR s.place BETWEEN w.fresh_from AND w.fresh_to THEN 0
    WHEN s.b <= w.first AND s.a >= w.first - 128 THEN 0 ELSE s.chars END)::BIGINT AS formatted_chars
  FROM windows w LEFT JOIN t s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.place = w.system_place
  GROUP BY w.conv_id
)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars
FROM t JOIN formatted f ON f.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id
""")
def op3_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    given = spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    given = given.unionByName(spark.createDataFrame(
        [(-7, 0, "user", probe), (-7, 1, "assistant", probe)],
        "conv_id long, turn long, role string, text string"))
    made = chat.windows(given)
    # Read back from the windows: repeated turns off, the rest in order.
    back = made.withColumn("turns", chat.parsed(F.col("text"))).select(
        "conv_id", F.struct(
            "block", "window",
            F.expr("slice(turns, repeated + 1, size(turns))").alias("turns"),
            chat.targets(F.col("text"), F.col("loss")).alias("targets"),
            F.length("text").cast("long").alias("chars")).alias("w"),
    )
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    turns = F.flatten(F.transform("ws", lambda w: w["turns"]))
    loss = F.array_join(F.transform("ws", lambda w: w["targets"]), "")
    return whole.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(
            turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate(F.transform("ws", lambda w: w["chars"]), F.lit(0).cast("long"), lambda s, x: s + x
                    ).alias("formatted_chars"),
    )


URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query(r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] END AS s
  FROM pages
),
q AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(s, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(s, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(s, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(ref|fbclid|gclid|utm_[a-z]+)='))) AS args, s
  FROM p
),
k AS (
  SELECT *, CASE WHEN s IS NOT NULL THEN
    regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
    || regexp_replace(path, '/+$', '')
    || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS key FROM q
),
listed AS (SELECT DISTINCT key FROM k WHERE page_id % 50 = 0 AND key IS NOT NULL),
r AS (
  SELECT *, ('.' || host) AS h FROM k
),
v AS (
  SELECT page_id, host, path, key, CASE
    WHEN h LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN h LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN h LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN h LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN h LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM r
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM v LEFT JOIN listed ON v.key = listed.key
""")
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list is the fixed query set: the URLs of pages whose id is divisible by 50."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    listed = pages.where("page_id % 50 = 0").select("url")
    return urls.judged(pages, listed, URL_RULES).drop("url")


@query()
def op6_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    kept = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    read = media.fingerprinted(media.stored(kept).drop("text"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("times"), F.hex(F.xxhash64("times", "codes"))).alias("feature"),
    )


@query()
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """All pages and all documents; a document declares its ``lang`` and its source is its host."""
    docs = documents(spark, folder, "doc_id", "text", "lang", "source")
    pages = language.page_evidence(spark.read.parquet(f"{folder}/pages.parquet").select(
        "page_id", "html", "url"))
    rows = docs.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"),
        F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"),
    ).unionByName(pages.withColumn("doc_id", F.lit(None).cast("long")))
    return language.identified(rows, docs.select("text", "lang"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
),
w AS (SELECT lang, source, id, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
),
p AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
  FROM full_c JOIN v USING (lang)
),
tot AS (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY lang, term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM tot JOIN v USING (lang)
),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
rows_of AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM rows_of)
WHERE part = 'pair' OR rank <= 50
""")
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audited(documents(spark, folder, "text", "lang", "source"))


@query(rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 5) AS r(m))
),
f AS (SELECT lang, phrase, m, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
parts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
),
cuts AS (
  SELECT p.lang, p.phrase, p.a, p.k, x.a AS l, y.a AS r, (2000000::HUGEINT * p.a) // (x.a + y.a) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.x JOIN f y ON y.lang = p.lang AND y.phrase = p.y
),
least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inner_phrases AS (
  SELECT lang, a, array_to_string(ws[i:j], ' ') AS phrase
  FROM (SELECT *, unnest(range(i + 1, m + 1)) AS j FROM (SELECT *, unnest(range(1, m)) AS i FROM c WHERE m > 2))
  WHERE j - i + 1 < m
),
gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_phrases b ON b.lang = c.lang AND b.phrase = c.phrase
  WHERE 100::HUGEINT * b.a >= 80::HUGEINT * c.a
),
ranked AS (
  SELECT lang, phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least ANTI JOIN gone USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mined(documents(spark, folder, "doc_id", "text", "lang"))


@query()
def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    field = pii.trained(pii.labelled(spark, docs))
    return pii.found(docs, field).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("rule_spans", 256).alias("base_sha256"), "spans",
        F.col("rule_spans").alias("base_spans"))


QUERIES["pipeline"] = corpus_pipeline.run
