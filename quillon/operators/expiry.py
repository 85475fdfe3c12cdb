"""Expiry of what sources no longer list, derived from the history of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def eligibility(runs: DataFrame) -> DataFrame:
    """Adds ``eligible``: eligible, suspicious_zero (nothing after something) or not_successful.

    ``runs``: source, run, outcome, fetched. What came before is the last trusted run.
    """
    w = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    trusted = F.when((F.col("outcome") == "success"), F.when(F.col("fetched") > 0, F.col("fetched")))
    before = F.last(trusted, ignorenulls=True).over(w)
    state = F.when(F.col("outcome") != "success", "not_successful").when((F.col("fetched") == 0) & (before > 0), "suspicious_zero").otherwise("eligible")
    return runs.withColumn("eligible", state)


def misses(sightings: DataFrame, runs: DataFrame) -> DataFrame:
    """Per (source, external_id): eligible runs of the source since it was last seen.

    ``sightings``: source, external_id, run. Runs get a running number per source, so that the
    count is a difference of two numbers, not a join of every sighting with every run.
    """
    number = F.sum(F.when(F.col("eligible") == "eligible", 1).otherwise(0)).over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = runs.select("source", "run", number.alias("nth"))
    latest = numbered.groupBy("source").agg(F.max("nth").alias("last_nth"))
    seen = sightings.groupBy("source", "external_id").agg(F.max("run").alias("run"))
    joined = seen.join(numbered, ["source", "run"]).join(latest, "source")
    return joined.select("source", "external_id", F.col("run").alias("last_run"), (F.col("last_nth") - F.col("nth")).cast("long").alias("misses"))


def scoped_misses(sightings: DataFrame, runs: DataFrame, completed: DataFrame) -> DataFrame:
    """Like ``misses``, with scopes: an eligible run counts for all; one that did not succeed counts for the sightings
    whose last scope it completed, and never for those without a scope.

    ``sightings``: source, external_id, run, scope; ``runs``: with ``eligible``; ``completed``: source, run, scope.
    """
    last = sightings.groupBy("source", "external_id").agg(F.max(F.struct("run", "scope")).alias("s")).select("source", "external_id", F.col("s.run").alias("last_run"), "s.scope")
    whole = misses(sightings.select("source", "external_id", "run"), runs).select("source", "external_id", "misses")
    partly = runs.filter("eligible = 'not_successful'").select("source", "run").join(completed.distinct(), ["source", "run"])
    of_scope = last.join(partly, ["source", "scope"]).filter(F.col("run") > F.col("last_run")).groupBy("source", "external_id").agg(F.count_distinct("run").alias("_more"))
    joined = last.join(whole, ["source", "external_id"]).join(of_scope, ["source", "external_id"], "left")
    return joined.select("source", "external_id", "scope", (F.col("misses") + F.coalesce("_more", F.lit(0))).alias("misses"))


def sweep(postings: DataFrame, counted: DataFrame, now, threshold: int = 3) -> DataFrame:
    """posting_id, expiry_reason: a passed deadline, or every sighting missed ``threshold`` times."""
    gone = counted.groupBy("posting_id").agg((F.min("misses") >= threshold).alias("vanished"))
    joined = postings.filter("expired_at IS NULL").join(gone, "posting_id", "left")
    reason = F.when(F.col("deadline") < now, "deadline_passed").when(F.col("vanished"), "vanished_from_sources")
    return joined.select("posting_id", reason.alias("expiry_reason")).filter("expiry_reason IS NOT NULL")


def closed(postings: DataFrame, closures: DataFrame, counted: DataFrame) -> DataFrame:
    """Live postings that one source calls closed and no other source still lists."""
    said = closures.join(counted.select("source", "external_id", "posting_id"), ["source", "external_id"]).select("posting_id", "source")
    listed = counted.filter("misses = 0").select("posting_id", F.col("source").alias("other"))
    still = said.join(listed, "posting_id").filter("other <> source").select("posting_id").distinct()
    live = postings.filter("expired_at IS NULL").select("posting_id")
    return said.select("posting_id").distinct().join(live, "posting_id", "left_semi").join(still, "posting_id", "left_anti")


def retired(verdicts: DataFrame, last: int = 3) -> DataFrame:
    """(source, scope) whose last ``last`` verdicts are all gone."""
    if last < 2:
        raise ValueError("at least two verdicts are needed")
    nth = F.row_number().over(W.partitionBy("source", "scope").orderBy(F.desc("at"), F.desc("id")))
    recent = verdicts.withColumn("_n", nth).filter(F.col("_n") <= last)
    return recent.groupBy("source", "scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gone")).alias("n_gone")).filter((F.col("n") == last) & (F.col("n_gone") == last)).select("source", "scope")


def source_health(runs: DataFrame) -> DataFrame:
    """Per source: last run and outcome, last success, runs without success since."""
    order = F.struct("at", "id")
    one = runs.groupBy("source").agg(
        F.max("at").alias("last_run"), F.max_by("outcome", order).alias("last_outcome"), F.max(F.when(F.col("outcome") == "success", F.col("at"))).alias("last_success")
    )
    since = runs.join(one.select("source", "last_success"), "source").filter((F.col("outcome") != "success") & (F.col("last_success").isNull() | (F.col("at") > F.col("last_success"))))
    return one.join(since.groupBy("source").agg(F.count(F.lit(1)).alias("failures")), "source", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
