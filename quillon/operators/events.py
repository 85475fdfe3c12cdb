"""Folding append-only event logs into current state and cohort metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.score import days

STATUSES = ("applied", "oa", "interview", "offer", "rejected")
RANK = {"applied": 1, "oa": 2, "interview": 3, "offer": 4, "rejected": 4}
ORDER = ("at", "id")
RANGES = 256


def at_literal(now: datetime) -> Column:
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def rank(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), status)


def may_advance(old: Column, new: Column) -> Column:
    """Never to the same; to the end only from before it; else strictly up."""
    return (old != new) & F.when(rank(new) == 4, rank(old) < 4).otherwise(rank(new) > rank(old))


def may_auto_apply(status: Column, confidence: Column, threshold: float | None) -> Column:
    if threshold is None:
        return F.lit(False)
    return (rank(status) < 4) & (confidence >= threshold)


def applications(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per application: its creation, what came after, and its current status.

    The earliest event is the creation, whatever its status. Each fact is a minimum or maximum
    over the events, combined before the shuffle; no application's history is collected.
    """
    event = F.struct(*ORDER, "status")
    of = {"response": STATUSES[1:], "oa": ("oa", "interview", "offer"), "interview": ("interview", "offer"), "offer": ("offer",), "rejected": ("rejected",)}
    held = {k: F.when(F.col("status").isin(*v), event) for k, v in of.items()}
    first = events.groupBy(*keys).agg(F.min(event).alias("created"), F.max(event).alias("last"), *[F.max(h).alias(f"_{k}") for k, h in held.items()])
    # After the creation there is one of them exactly if the latest of them is not the creation itself.
    after = lambda k: F.coalesce(F.col(f"_{k}") > F.col("created"), F.lit(False))
    creation = first.select(*keys, F.col("created.at").alias("_at"), F.col("created.id").alias("_id"))
    later = events.filter(F.col("status") != "applied").join(creation, keys).filter(F.struct("at", "id") > F.struct("_at", "_id"))
    response = later.groupBy(*keys).agg(F.min("at").alias("response_at"))
    one = first.join(response, keys, "left")
    return one.select(
        *keys,
        F.col("created.at").alias("applied_at"),
        F.col("last.status").alias("status"),
        after("response").alias("responded"),
        days(F.col("response_at"), F.col("created.at")).alias("response_days"),
        *[after(k).alias(name) for k, name in (("oa", "reached_oa"), ("interview", "reached_interview"), ("offer", "offered"), ("rejected", "was_rejected"))],
    )


def cohort(apps: DataFrame, now: datetime, dead_after_days: int = 45, by: list[str] | None = None) -> DataFrame:
    """Funnel totals, response times included; over all, and with ``by`` for each of its columns apart, in one pass:
    the other columns are null in a group's row, and ``grouping`` tells them from groups of null."""
    silent = ~F.col("responded") & ~F.col("status").isin("offer", "rejected")
    dead = F.unix_millis(at_literal(now).cast("timestamp")) - F.unix_millis(F.col("applied_at").cast("timestamp")) > dead_after_days * 86_400_000
    count = lambda c, name: F.count_if(c).alias(name)
    grouped = apps.groupBy() if not by else apps.groupingSets([[], *[[F.col(c)] for c in by]], *[F.col(c) for c in by])
    own = [F.grouping_id(*by).alias("grouping")] if by else []
    return grouped.agg(
        *own,
        F.count(F.lit(1)).alias("applications"),
        count(F.col("responded"), "responded"),
        count(silent & ~dead, "no_response_live"),
        count(silent & dead, "no_response_dead"),
        count(F.col("reached_oa"), "reached_oa"),
        count(F.col("reached_interview"), "reached_interview"),
        count(F.col("offered"), "offers"),
        count(F.col("was_rejected"), "rejected"),
        F.round(F.percentile("response_days", F.lit(0.5)), 6).alias("median_days"),
        F.round(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY response_days)"), 6).alias("p90_days"),
        F.count("response_days").alias("n_days"),
    )


def window(apps: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Half-open window on the creation."""
    if start is not None and end is not None and start >= end:
        raise ValueError("the window's start must be before its end")
    if start is not None:
        apps = apps.filter(F.col("applied_at") >= at_literal(start))
    return apps if end is None else apps.filter(F.col("applied_at") < at_literal(end))


def current_status(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by("status", F.struct(*ORDER)).alias("status"), F.count(F.lit(1)).alias("n_events"))


def verify_status(stored: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """covered, exempt (no events) and mismatch counts of stored status against the log."""
    both = stored.join(current_status(events, keys).withColumnRenamed("status", "folded"), keys, "left")
    return both.agg(
        F.count_if(F.col("folded").isNotNull()).alias("covered"),
        F.count_if(F.col("folded").isNull()).alias("exempt"),
        F.count_if(F.col("folded") != F.col("status")).alias("mismatch"),
    )


def insert_absent(target: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``rows`` whose key is new: the first of each key by ``order``. Null keys never conflict."""
    known = target.select(*key).distinct()
    fresh = rows.join(known, key, "left_anti")
    whole = [F.col(k).isNotNull() for k in key]
    complete = whole[0]
    for c in whole[1:]:
        complete = complete & c
    nth = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    first = fresh.filter(complete).withColumn("_n", nth).filter("_n = 1").drop("_n")
    return first.unionByName(fresh.filter(~complete))


def nudges(apps: DataFrame, now: datetime, thresholds: tuple[int, ...] = (14, 30)) -> DataFrame:
    """One event per silent application and threshold that it has passed."""
    idle = F.floor(days(at_literal(now), F.col("applied_at"))).cast("int")
    silent = apps.filter(~F.col("responded") & ~F.col("status").isin("offer", "rejected")).withColumn("days_idle", idle)
    return silent.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter("days_idle >= threshold")


def upcoming(deadlines: DataFrame, at: str, now: datetime, leads_hours: tuple[int, ...] = (72, 24)) -> DataFrame:
    """One row per deadline and lead in (now, now + lead]."""
    left = (F.unix_millis(F.col(at).cast("timestamp")) - F.unix_millis(at_literal(now).cast("timestamp"))) / 3_600_000
    rows = deadlines.withColumn("_left", left).filter((F.col("_left") > 0) & (F.col("_left") <= max(leads_hours)))
    return rows.withColumn("lead_hours", F.explode(F.array(*map(F.lit, leads_hours)))).filter("_left <= lead_hours").drop("_left")


def rank_percentiles(rows: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """Per key: mean, most, and for each name the value of rank round(p * (n - 1)).

    Values are counted first, so what a window runs over are a key's distinct values in
    RANGES ranges, then the ranges' sums: two levels, neither of which holds a key's rows.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    edges = counts.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("most"), F.sum("_c").alias("_n"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("_mean"))
    width = F.greatest((F.col("most") - F.col("_lo")) / RANGES, F.lit(1e-300))
    placed = counts.join(edges, key).withColumn("_range", F.least(F.lit(RANGES - 1), F.floor((F.col(value) - F.col("_lo")) / width)))
    sums = placed.groupBy(key, "_range").agg(F.sum("_c").alias("_sum"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(key, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy(key, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = placed.join(sums, [key, "_range"]).withColumn("_upto", F.col("_base") + F.sum("_c").over(within))
    ranks = {name: F.round(F.lit(p) * (F.col("_n") - 1)) for name, p in at.items()}
    return ranked.groupBy(key).agg(
        F.round(F.first("_mean"), 6).alias("mean"), F.max("most").alias("most"), *[F.min(F.when(F.col("_upto") > r, F.col(value))).alias(name) for name, r in ranks.items()]
    )
