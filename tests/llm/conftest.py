import random

import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, "
           "bucket string, key string, rest string, size string, taken string, shards string, "
           "kept string, n_words string, media string, ids string")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages, ties, repeated rows."""
    rng = random.Random(5)
    base = words(rng, 300, 5000)
    passage = words(rng, 70, 5000)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:290] + words(rng, 10)))]
    rows += [(4, None), (5, ""), (6, " \t\n\x0b\x0c\r "), (7, "one"), (8, "ONE"), (9, "a b c d")]
    rows += [(10 + i, " ".join(words(rng, 80) + passage + words(rng, 90))) for i in range(6)]
    rows += [(20, " ".join(words(rng, 30000))), (21, "the the " * 200), (22, "% # " * 60 + "x " * 60)]
    rows += [(23, "line one\n" * 30), (24, "É Σ \x1c <|endoftext|> 'S \x85 字字\x00 " * 12)]
    rows += [(None, " ".join(base)), (None, None), (7, "one"), (7, " ".join(passage))]
    rows += [(30 + i, " ".join(base[: 250 + i] + words(rng, 20))) for i in range(8)]
    langs, sources = ("en", "de", None, "xx"), ("b", "a", None, "é")
    return [(i, t, langs[k % 4], sources[k % 4], len(t) if t else None, *["x"] * 10)
            for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
