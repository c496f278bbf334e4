"""Suffix orders against plain sorting."""

import random

import pytest

from tesserae.operators import suffixes


def texts():
    r = random.Random(5)
    out = ["banana", "banana", "ananas", "a" * 150, "a" * 149 + "b", "", None, "x", "naïve naïve 東京都東京都", "ab" * 80]
    base = "".join(r.choice("abc ") for _ in range(400))
    return [*out, base, base[:390] + "zz" + base[392:], base]


@pytest.mark.parametrize("width", [1, 3, 16])
def test_suffix_order_equals_sorting(spark, width):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts())]
    want = sorted((t[k:].encode(), i, k) for i, t in rows if t for k in range(len(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["place"], r["doc_id"], r["offset"]) for r in suffixes.suffix_order(df, width).collect())
    assert got == [(n, i, k) for n, (_, i, k) in enumerate(want)]


def test_no_suffixes(spark):
    assert suffixes.suffix_order(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).count() == 0
