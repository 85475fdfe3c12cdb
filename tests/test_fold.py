"""Folded openings whose ranks are equal to nine decimals, against SQL."""

import duckdb

from quillon.functions import score
from quillon.plans import listing_queries

#: Sums that lie at half a unit of the ninth decimal, within the last bits.
HALVES = (0.37944740849999997, 0.37944740850000336, 0.2595915135, 0.5698603074999999, 0.32542896649999997, 0.43741049049999997, 0.2594474085, 0.125, 0.0, 1.0)


def test_rounding_agrees_with_sql(spark):
    values = [*HALVES, *(-x for x in HALVES)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").coalesce(1)
    got = [r.y for r in rows.select("i", score.rounded(rows.x, 9).alias("y")).orderBy("i").collect()]
    want = duckdb.execute("SELECT round(x, 9) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()
    assert got == [w[0] for w in want]


def test_openings_of_equal_rank_stand_by_id(spark, monkeypatch):
    """The second and third are equal to nine decimals, so the lesser id comes first whichever sum is the greater."""
    made = [("co-1", "a", None, i, x) for i, x in ((9, 0.9), (4, 0.37944740850000336), (3, 0.37944740849999997), (1, 0.1))]
    monkeypatch.setattr(listing_queries, "_scored", lambda spark, sf: spark.createDataFrame(made, "company_key string, title string, location string, posting_id long, composite double"))
    (row,) = listing_queries.er5_fold_openings(spark, "").collect()
    assert (row.posting_id, row.n_other, row.other_openings) == (9, 3, "3,4,1")
    by_sql = duckdb.execute("SELECT string_agg(i, ',' ORDER BY round(x, 9) DESC, i) FROM (SELECT unnest([9, 4, 3, 1]) AS i, unnest([0.9, 0.37944740850000336, 0.37944740849999997, 0.1]::DOUBLE[]) AS x)")
    assert by_sql.fetchone()[0] == "9,3,4,1"
