"""Pages against a sorted list."""

import random

from tablegraph.operators import terms
from tablegraph.operators.pages import Pages


def test_pages(spark):
    rng = random.Random(6)
    # A third of all rows share a key; some keys are null, some rows are equal.
    rows = [(7 if i % 3 == 0 else rng.choice([None, *range(40)]), f"r{rng.randrange(300):03d}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, `_page_range x` string")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    pages = Pages(df, ["k"], 7)
    assert len(pages.sizes) > 1 and pages.total == 1000
    for number, size in ((1, 10), (37, 27), (38, 27), (99, 27), (0, 999), (2, 999), (5, 5000)):
        at = min(max(number, 1), -(-1000 // size))
        assert [tuple(r) for r in pages.page(number, size).collect()] == want[(at - 1) * size : at * size]
    # A page reads the ranges that hold it, no others.
    for number in (1, 500, 1000):
        assert len(pages.places((number - 1), 1)) == 1
    assert terms.page(df, ["k"], 1, 0).count() == 0
    assert terms.page(df.limit(0), ["k"], 3, 10).count() == 0
