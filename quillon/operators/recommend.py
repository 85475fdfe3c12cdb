"""Stock, recipes and suggestions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.score import days, half_life
from quillon.operators.events import at_literal


def purchase_gaps(history: DataFrame, item: str, at: str) -> DataFrame:
    """Per item with two purchases or more: the upper median of the gaps in days, and the last purchase.

    Neighbours are found within the hours of an item, then between its hours; the median by counts of whole days, then by
    counts of the values within its day. So no window runs over all purchases of an item.
    """
    rows = history.select(item, at, F.date_trunc("hour", at).alias("_hour"))
    near = days(F.col(at), F.lag(at).over(W.partitionBy(item, "_hour").orderBy(at)))
    hours = rows.groupBy(item, "_hour").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    far = days(F.col("_first"), F.lag("_last").over(W.partitionBy(item).orderBy("_hour")))
    gaps = rows.select(item, near.alias("_gap")).unionByName(hours.select(item, far.alias("_gap"))).filter("_gap IS NOT NULL")
    values = gaps.groupBy(item, F.floor("_gap").alias("_day"), "_gap").agg(F.count(F.lit(1)).alias("_n"))
    by_day = values.groupBy(item, "_day").agg(F.sum("_n").alias("_in_day"))
    upto = W.partitionBy(item).orderBy("_day").rowsBetween(W.unboundedPreceding, 0)
    by_day = by_day.withColumns({"_upto": F.sum("_in_day").over(upto), "n_gaps": F.sum("_in_day").over(W.partitionBy(item))})
    middle = F.floor(F.col("n_gaps") / 2) + 1
    of = by_day.filter((F.col("_upto") >= middle) & (F.col("_upto") - F.col("_in_day") < middle)).select(item, "_day", "n_gaps", (F.col("_upto") - F.col("_in_day")).alias("_before"))
    within = W.partitionBy(item, "_day").orderBy("_gap").rowsBetween(W.unboundedPreceding, 0)
    reached = values.join(of, [item, "_day"]).withColumn("_reached", F.col("_before") + F.sum("_n").over(within))
    median = reached.filter(F.col("_reached") >= middle).groupBy(item, "n_gaps").agg(F.min("_gap").alias("median_gap"))
    last = hours.groupBy(item).agg(F.max("_last").alias("last_at"))
    return median.join(last, item).select(item, "median_gap", "n_gaps", "last_at")


def shopping_suggestions(stock: DataFrame, history: DataFrame, item: str, expires: str, at: str, now: datetime, within_days: int = 3) -> DataFrame:
    """item, reason: what expires soon, then what is due by its own rhythm and not in stock."""
    expiring = stock.filter(F.col(expires) < at_literal(now) + F.expr(f"INTERVAL {within_days} DAYS")).select(item, F.lit("expiring_replacement").alias("reason")).distinct()
    due = purchase_gaps(history, item, at).join(stock.select(item).distinct(), item, "left_anti")
    due = due.filter(F.col("median_gap") < days(at_literal(now), F.col("last_at"))).select(item, F.lit("frequently_purchased").alias("reason"))
    return expiring.unionByName(due)


def recipe_matches(ingredients: DataFrame, have: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """recipe, total, matched, missing; to be ordered by (total < 2, missing, -total, recipe)."""
    owned = have.select(F.lower("name").alias("name")).distinct().withColumn("_has", F.lit(1))
    joined = ingredients.withColumn("name", F.lower("name")).join(owned, "name", "left")
    counts = joined.groupBy("recipe").agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce("_has", F.lit(0))).alias("matched"))
    if suppressed is not None:
        counts = counts.join(suppressed, "recipe", "left_anti")
    return counts.withColumn("missing", F.col("total") - F.col("matched"))


def recipe_order() -> list:
    return [(F.col("total") < 2).asc(), F.col("missing").asc(), F.col("total").desc(), F.col("recipe").asc()]


def liked(reviews: DataFrame, now: datetime, half_days: float = 120.0, least_mean: float = 4.0) -> DataFrame:
    """Recipes of mean rating ``least_mean`` or more, scored by their best decayed review, 0 at least."""
    gain = half_life(F.col("rating") - F.lit(3.0), days(at_literal(now), F.col("cooked_at")), half_days)
    one = reviews.groupBy("recipe").agg(F.avg("rating").alias("mean"), F.greatest(F.lit(0.0), F.max(gain)).alias("score"))
    return one.filter(F.col("mean") >= least_mean)


def interleave(ranked: DataFrame, order: list, favorites: DataFrame, key: str, seed: str, slots: tuple[int, ...] = (3, 5, 7)) -> DataFrame:
    """Puts favorites from beyond the first places into ``slots`` (from 0), chosen by a seeded hash.

    Only the first places matter: the rows there are at most the last slot's number and are
    placed one by one. All others keep their order; ``position`` is null beyond the first
    places, where the order is ``order`` without the moved rows.
    """
    head = ranked.orderBy(*order).limit(slots[-1] + 1 + len(slots))
    first = [r[0] for r in head.select(key).collect()]  # a bounded head
    safe = first[: slots[0]]
    hashed = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    eligible = ranked.join(favorites.select(key).distinct(), key, "left_semi").filter(~F.col(key).isin(safe)) if safe else ranked.join(favorites.select(key).distinct(), key, "left_semi")
    chosen = [r[0] for r in eligible.orderBy(hashed, key).limit(len(slots)).select(key).collect()]
    at = dict(zip(slots, chosen, strict=False))
    rest = iter([x for x in first if x not in chosen])
    placed = []
    for place in range(slots[-1] + 1):
        row = at[place] if place in at else next(rest, None)
        if row is not None:
            placed.append((row, place))
    places = ranked.sparkSession.createDataFrame(placed, f"_k {dict(ranked.dtypes)[key]}, position long") if placed else None
    if places is None:
        return ranked.withColumn("position", F.lit(None).cast("long"))
    return ranked.join(F.broadcast(places), F.col(key) == F.col("_k"), "left").drop("_k")


def merge_stock(rows: DataFrame, keys: list[str], tolerance_days: float = 3.0) -> DataFrame:
    """Arrivals folded into stock: each joins the earliest-expiring lot of its keys within the tolerance,
    else opens a lot.

    Sequential by nature: rows are sorted by key and arrival within their partition and folded
    as a stream of batches. What a task holds is the open lots of one key.
    """
    tolerance = tolerance_days * 86_400
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", quantity double, expires_at timestamp_ntz, arrivals long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: tuple | None = None
        lots: list[list] = []

        def done() -> list[tuple]:
            return [(*own, *lot) for lot in lots] if own is not None else []

        for frame in frames:
            out: list[tuple] = []
            for r in frame.itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                if key != own:
                    out += done()
                    own, lots = key, []
                near = [x for x in lots if abs((x[1] - r.expires_at).total_seconds()) <= tolerance]
                if near:
                    lot = min(near, key=lambda x: x[1])
                    lot[0] += r.quantity
                    lot[1] = min(lot[1], r.expires_at)
                    lot[2] += 1
                else:
                    lots.append([r.quantity, r.expires_at, 1])
            yield pd.DataFrame(out, columns=[*keys, "quantity", "expires_at", "arrivals"])
        yield pd.DataFrame(done(), columns=[*keys, "quantity", "expires_at", "arrivals"])

    arrived = rows.select(*keys, F.col("quantity").cast("double"), "expires_at", "added_at", "row_id")
    return arrived.repartition(*keys).sortWithinPartitions(*keys, "added_at", "row_id").mapInPandas(run, schema)


# Storage families in order of preference, and the days of a unit.
STORAGE = ("dop_refrigerate", "refrigerate_after_opening", "refrigerate", "dop_pantry", "pantry", "freeze")
UNIT_DAYS = {"days": 1.0, "day": 1.0, "hours": 1 / 24, "weeks": 7.0, "months": 30.0, "years": 365.0, "year": 365.0}


def shelf_life(products: DataFrame, default_days: float = 7.0) -> DataFrame:
    """Adds ``shelf_days`` of the first storage family that is stated (columns NAME_max, NAME_metric)."""
    unit = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])
    stated = [F.col(f"{s}_max") * F.try_element_at(unit, F.lower(f"{s}_metric")) for s in STORAGE]
    return products.withColumn("shelf_days", F.coalesce(*stated, F.lit(default_days)))
