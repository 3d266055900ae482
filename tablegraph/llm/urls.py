"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter.

The listed URLs are made canonical and hashed into a filter of 512-bit blocks, one bit in each of a
block's eight words, built by grouped bit-or. Pages meet their block in a broadcast join (the number
of blocks has a fixed upper bound, whatever the length of the list) and are passed as possible hits
if all eight bits are set; only these go on to the exact join on the canonical URL, which removes false
positives. With a list beyond the bound more pages pass the filter; the verdicts stay the same.

Canonical: scheme, ``www.`` or ``m.`` and a default port go, host in lower case; no fragment, no
slashes at the end; parameters sorted, tracking ones removed. A null URL or one without ``://`` has an
empty host and path, fits no rule and is never listed. Ids and repeats don't matter: every row gets
its verdict. Columns of any name pass through; an added column replaces one of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph.llm.frame import let, quoted, tuned

WORDS = 8
KEYS_PER_BLOCK = 16
MOST_BLOCKS = 1 << 16
TRACKING = r"^(ref|fbclid|gclid|utm_[a-z]+)="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    found = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for all spellings of an address; null where there is no host part."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(""))
    name = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    whole = F.concat(name, F.regexp_replace(path(url), r"/+$", ""), tail)
    return F.when(after_scheme(url).isNotNull(), whole)


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of ``(host, path, verdict)`` and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def bits(key: Column) -> list[Column]:
    """The bit that a key sets in each word of its block."""
    spread = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    places = [F.shiftrightunsigned(spread, 6 * j).bitwiseAND(63).cast("int") for j in range(WORDS)]
    return [F.call_function("shiftleft", one, place) for place in places]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0..w7`` of the keys in ``listed``: at most ``blocks`` rows."""
    rows = listed.select(
        F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"),
        *[b.alias(f"w{j}") for j, b in enumerate(bits(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)])


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]],
           url_col: str = "url") -> DataFrame:
    """The pages with ``host, path, rule, verdict``; ``listed`` has the blocked URLs in ``url``."""
    tuned(pages.sparkSession)
    added = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c not in added]
    names = listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct()
    blocks = min(MOST_BLOCKS, 1 << max(0, names.count() // KEYS_PER_BLOCK).bit_length())
    url = quoted(url_col)
    rows = pages.select(
        F.struct(*[quoted(c).alias(c) for c in kept]).alias("row"), canonical(url).alias("key"),
        host(url).alias("host"), path(url).alias("path"),
    )
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    # The number of blocks is bounded by MOST_BLOCKS: 72 bytes each.
    found = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(
        F.broadcast(bloom_blocks(names, blocks)), "block", "left")
    passed = F.lit(True)
    for j, b in enumerate(bits(F.col("key"))):
        passed = passed & (F.col(f"w{j}").bitwiseAND(b) != 0)
    passed = F.col("said").isNull() & F.col("key").isNotNull() & F.coalesce(passed, F.lit(False))
    out = [*[F.col("row").getField(c).alias(c) for c in kept], "host", "path", "rule"]
    clear = found.where(~passed).select(*out, F.coalesce("said", F.lit("allow")).alias("verdict"))
    exact = names.select("key", F.lit("block").alias("hit"))
    possible = found.where(passed).join(exact, "key", "left").select(
        *out, F.coalesce("hit", F.lit("allow")).alias("verdict"))
    return clear.unionByName(possible)
