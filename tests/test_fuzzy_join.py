"""The fuzzy join against all pairs, at several thresholds, and its keys against names that share a run of letters."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.fuzzy import similarity
from quillon.operators import matching


def names():
    r = random.Random(6)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 24))).strip() or "a" for _ in range(60)]
    out = set(base)
    for b in base:
        for _ in range(3):
            x = list(b)
            for _ in range(r.randint(1, max(1, len(x) // 4))):
                at, kind = r.randrange(len(x)), r.random()
                if kind < 0.3:
                    x[at] = r.choice("abcxyzé")
                elif kind < 0.5:
                    x.insert(at, r.choice("abq"))
                elif kind < 0.7 and len(x) > 1:
                    del x[at]
                elif at + 1 < len(x):
                    x[at], x[at + 1] = x[at + 1], x[at]
            out.add("".join(x))
    return sorted(x for x in out if x) + ["abcde", "abxde", "aab", "baa", "ca", "abc"]


@pytest.mark.parametrize("least", [0.5, 0.7, 0.8, 0.9, 1.0])
def test_equal_to_all_pairs(spark, least):
    rows = spark.createDataFrame([(n,) for n in [*names(), None, ""]], "n string")
    a, b = rows.select(F.col("n").alias("a")), rows.filter("n IS NOT NULL AND length(n) % 3 <> 1").select(F.col("n").alias("b"))
    got = {(r.a, r.b): round(r.score, 9) for r in matching.fuzzy_companies(a, "a", b, "b", least).collect()}
    every = a.filter("a <> ''").distinct().join(b.filter("b <> ''").distinct(), F.lit(True)).withColumn("s", similarity(F.col("a"), F.col("b")))
    want = {(r.a, r.b): round(r.s, 9) for r in every.filter(F.col("s") >= least).collect()}
    assert got == want and len(want) > 60


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        matching.fuzzy_companies(spark.createDataFrame([("a",)], "a string"), "a", spark.createDataFrame([("a",)], "b string"), "b", 0)


def test_a_common_run_of_letters_pairs_few():
    """Names that all end alike share no key by that."""
    r = random.Random(2)
    made = ["".join(r.choice("bcdfghjklmnpqrtuvwxz") for _ in range(12)) + " services" for _ in range(400)]
    counts: dict[str, int] = {}
    for t in made:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    rank = {c: i for i, c in enumerate(sorted(counts, key=counts.get))}
    import pandas as pd

    (keyed,) = list(matching._letter_keys(rank, 0.9, False)(iter([pd.DataFrame({"t": made[:256]})])))
    sizes = keyed.groupby("key").size()
    assert (sizes * (sizes - 1) // 2).sum() < 256 * 255 // 2 // 10
