"""Filtering, ranking, folding and paging of postings."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import score as S
from quillon.operators.events import at_literal

AXES = ("composite", "pay", "posted", "deadline", "prestige")
MAX_LIMIT = 200


def company_signals(postings: DataFrame, sightings: DataFrame | None = None) -> DataFrame:
    """Per company: name, postings, live ones, pay observations, lower median of hourly pay, sources."""
    paid = (F.col("currency") == "USD") & (F.col("period") == "hour") & F.col("pay_min").isNotNull()
    signals = postings.groupBy("company_key").agg(
        F.min("company_name").alias("company_name"),
        F.count(F.lit(1)).alias("total_postings"),
        F.count_if(F.col("expired_at").isNull()).alias("live_postings"),
        F.count_if(paid).alias("pay_observations"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN currency = 'USD' AND period = 'hour' THEN pay_min END)").alias("median_pay"),
        F.min("posted_at").alias("first_seen"),
    )
    if sightings is None:
        return signals
    sources = sightings.join(postings.select("posting_id", "company_key"), "posting_id").groupBy("company_key").agg(F.countDistinct("source").alias("distinct_sources"))
    return signals.join(sources, "company_key", "left").withColumn("distinct_sources", F.coalesce("distinct_sources", F.lit(0)))


def with_prestige(signals: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds tier and prestige. ``tiers`` (key, tier): of a repeated key the best tier counts."""
    best = tiers.groupBy(F.trim(F.lower("key")).alias("company_key")).agg(F.min("tier").alias("tier"))
    most = signals.agg(F.max("distinct_sources").alias("most_sources"))
    joined = signals.join(best, "company_key", "left").crossJoin(most)  # a one-row aggregate
    return joined.withColumn("prestige", S.prestige(F.col("tier"), F.col("live_postings"), F.col("distinct_sources"), F.col("most_sources"), F.col("median_pay"))).drop("most_sources")


def check_filters(limit: int = 50, offset: int = 0, sort: str = "composite", pay_min: float | None = None, pay_max: float | None = None) -> None:
    if sort not in AXES:
        raise ValueError(f"unknown sort {sort!r}; one of {', '.join(AXES)}")
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT} and offset not negative")
    for bound in (pay_min, pay_max):
        if bound is not None and (not math.isfinite(bound) or bound < 0):
            raise ValueError("pay bounds must be finite and not negative")
    if pay_min is not None and pay_max is not None and pay_min > pay_max:
        raise ValueError("pay_min exceeds pay_max")


def hourly() -> Column:
    return S.hourly_usd(F.col("pay_min"), F.col("pay_max"), F.col("currency"), F.col("period"))


def admit(
    postings: DataFrame, *, season: str | None = None, year: int | None = None, place: str | None = None, class_year: int | None = None,
    pay_min: float | None = None, pay_max: float | None = None, company: str | None = None, keep_unknown: bool = True,
) -> DataFrame:
    """Live postings that pass every filter asked for. A filter on an unknown value keeps or drops as told."""
    check_filters(pay_min=pay_min, pay_max=pay_max)
    ok = F.col("expired_at").isNull() & S.tri_state(F.col("season"), season, keep_unknown) & S.tri_state(F.col("term_year"), year, keep_unknown)
    if place is not None:
        text = F.lower(F.concat_ws("\n", "location", "region"))
        ok = ok & F.when(F.trim(text) == "", F.lit(keep_unknown)).otherwise(text.contains(place.lower()))
    if class_year is not None:
        low, high = F.col("class_min"), F.col("class_max")
        inside = F.coalesce(low <= class_year, F.lit(True)) & F.coalesce(high >= class_year, F.lit(True))
        ok = ok & F.when(low.isNull() & high.isNull(), F.lit(keep_unknown)).otherwise(inside)
    if pay_min is not None or pay_max is not None:
        rate = hourly()
        inside = (F.lit(True) if pay_min is None else rate >= pay_min) & (F.lit(True) if pay_max is None else rate <= pay_max)
        ok = ok & F.when(rate.isNull(), F.lit(keep_unknown)).otherwise(inside)
    if company is not None:
        ok = ok & (F.lower("company_name") == company.lower())
    return postings.filter(ok)


def scored(postings: DataFrame, signals: DataFrame, now: datetime) -> DataFrame:
    """Adds hourly, the five parts (``s_*``) and ``composite``. ``signals``: with_prestige()."""
    at = at_literal(now)
    joined = postings.join(signals.select("company_key", "median_pay", "pay_observations", "prestige"), "company_key", "left")
    stated = F.col("pay_min").isNotNull() & F.col("period").isNotNull()
    joined = joined.withColumn("hourly", hourly())
    parts = {
        "pay": S.pay_score(F.col("hourly"), stated, F.col("median_pay"), F.coalesce("pay_observations", F.lit(0))),
        "recency": S.recency(F.col("posted_at"), F.col("posted_estimated"), at),
        "deadline": S.deadline(F.col("deadline"), at),
        "location": S.location(F.col("is_remote")),
        "prestige": F.coalesce(S.clamp(F.nanvl("prestige", F.lit(S.NEUTRAL))), F.lit(S.NEUTRAL)),
    }
    joined = joined.withColumns({f"s_{k}": v for k, v in parts.items()})
    return joined.withColumn("composite", S.composite({k: F.col(f"s_{k}") for k in parts}))


def axis(sort: str, now: datetime) -> tuple[Column, Column]:
    """(tier, value): known values first, passed deadlines next, unknown last; then value descending."""
    at = at_literal(now)
    if sort == "composite":
        return F.lit(0), F.col("composite")
    if sort == "pay":
        return F.when(F.col("hourly").isNull(), 2).otherwise(0), F.col("hourly")
    if sort == "posted":
        return F.when(F.col("posted_at").isNull(), 2).otherwise(0), -S.days(at, F.col("posted_at"))
    if sort == "deadline":
        left = S.days(F.col("deadline"), at)
        return F.when(left.isNull(), 2).when(left < 0, 1).otherwise(0), F.when(left < 0, left).otherwise(-left)
    return F.when(F.col("prestige").isNull(), 2).otherwise(0), F.col("prestige")


def ranked(rows: DataFrame, sort: str, now: datetime) -> DataFrame:
    """Adds ``tier`` and ``value`` of the axis; a limit after ``order()`` needs no full sort."""
    check_filters(sort=sort)
    tier, value = axis(sort, now)
    return rows.withColumns({"tier": tier, "value": value})


def order() -> list[Column]:
    return [F.col("tier").asc(), F.col("value").desc_nulls_last(), F.col("posting_id").asc()]


def fold_openings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best-ranked row of each group of same openings, with the others' ids in rank order.

    Aggregated on the map side: the group's rows meet as one ordered list of ids only.
    """
    place = F.struct(F.col("tier"), F.col("value").isNull().alias("none"), (-F.col("value")).alias("value"), F.col("posting_id"))
    folded = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("all"))
    return folded.select(*keys, F.element_at("all", 1)["posting_id"].alias("posting_id"), F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: x["posting_id"]).alias("other_openings"))


def page(rows: DataFrame, by: list[Column], limit: int, offset: int = 0) -> DataFrame:
    check_filters(limit=limit, offset=offset)
    return rows.orderBy(*by).offset(offset).limit(limit)


def folded_page(live: DataFrame, wanted: Column, keys: list[str], by: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of openings folded by ``keys``, each shown by its first row in order ``by``, with the counters
    total_live, matched (before folding) and total_rows (after)."""
    check_filters(limit=limit, offset=offset)
    matched = live.filter(wanted)
    heads = matched.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")
    counters = live.agg(F.count(F.lit(1)).alias("total_live"), F.count_if(wanted).alias("matched")).crossJoin(matched.select(*keys).distinct().agg(F.count(F.lit(1)).alias("total_rows")))
    return heads.orderBy(*by).offset(offset).limit(limit).crossJoin(counters)  # a row of counters


def keyset_page(rows: DataFrame, at: str, key: str, limit: int, after: tuple | None = None, newest: bool = True) -> DataFrame:
    """``limit`` + 1 rows after the cursor (at, key); the last tells whether there is more."""
    check_filters(limit=limit)
    if after is not None:
        later = F.col(at) < F.lit(after[0]) if newest else F.col(at) > F.lit(after[0])
        rows = rows.filter(later | ((F.col(at) == F.lit(after[0])) & (F.col(key) > F.lit(after[1]))))
    return rows.orderBy(F.col(at).desc() if newest else F.col(at).asc(), F.col(key).asc()).limit(limit + 1)
