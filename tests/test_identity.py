"""Identity over several keys against a plain loop, and with one key that all rows share."""

import random
import time

from pyspark.sql import functions as F

from quillon.operators import matching


def test_against_a_plain_loop(spark):
    r = random.Random(4)
    rows = [(r.randrange(70), r.choice([None, "a", "b", "c", "d"]), r.choice([None, "x", "y", "z"])) for _ in range(90)]
    targets = [(i, r.choice([None, "a", "b", "e"]), r.choice([None, "x", "y", "w"])) for i in range(12)]
    found = matching.by_identity(spark.createDataFrame(rows, "id long, a string, b string"), spark.createDataFrame(targets, "target long, a string, b string"), ["a", "b"], "id", "target")
    want = {}
    for i, *keys in rows:
        hits = [(nth, t[0]) for nth, key in enumerate(keys) for t in targets if key is not None and t[nth + 1] == key]
        if hits:
            want[i] = min([want[i], *hits] if i in want else hits)
    assert {r.id: (r.nth_key, r.target) for r in found.collect()} == want and found.columns == ["id", "target", "nth_key"]
    assert {w[0] for w in want.values()} == {0, 1}


def test_a_key_of_all_rows_is_not_squared(spark):
    """30,000 rows and as many targets of one host: 900,000,000 pairs, of which none is made."""
    n, started = 30_000, time.monotonic()
    rows = spark.range(n).select(F.col("id"), F.lit(None).cast("string").alias("a"), F.lit("host").alias("b"))
    found = matching.by_identity(rows, rows.withColumnRenamed("id", "target"), ["a", "b"], "id", "target")
    assert found.agg(F.count("id").alias("n"), F.max("target").alias("t"), F.min("nth_key").alias("k")).first() == (n, 0, 1)
    assert time.monotonic() - started < 60
