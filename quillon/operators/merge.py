"""Merging new rows into tables, without MERGE: joins and overwrites, or folds of the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: list[str], always_new: list[str]) -> DataFrame:
    """Full outer merge on ``key``: new values win where stated, ``always_new`` columns win even as null;
    ``created`` tells rows that were not there before."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    seen, had = F.col(f"b.{key}").isNotNull(), F.col(f"a.{key}").isNotNull()
    return joined.select(
        F.coalesce(f"b.{key}", f"a.{key}").alias(key),
        *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in keep_old],
        *[F.when(seen, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in always_new],
        (seen & ~had).alias("created"),
    )


def upsert_postings(old: DataFrame, new: DataFrame, now: Column, slug_sources: list[str]) -> DataFrame:
    """Postings seen again over the stored ones, by dedup_key.

    Title and url are always the new ones; other values where stated. A company name from a source that
    only has slugs, or one that is no name, leaves the stored one. A stated date of posting beats an
    estimate; without any it is ``now``, estimated. Being seen brings an expired posting back.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col("a.dedup_key") == F.col("b.dedup_key"), "full_outer")
    seen, had = F.col("b.dedup_key").isNotNull(), F.col("a.dedup_key").isNotNull()
    weak = F.coalesce(F.col("b.source").isin(slug_sources), F.lit(False)) | ~F.coalesce(F.col("b.company_name").rlike(r"\p{L}"), F.lit(False))
    kept_date = F.coalesce("b.posted_at", "a.posted_at")
    return joined.select(
        F.coalesce("b.dedup_key", "a.dedup_key").alias("dedup_key"),
        *[F.when(seen, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("title", "url")],
        F.when(had & (~seen | weak), F.coalesce("a.company_name", "b.company_name")).otherwise(F.coalesce("b.company_name", "a.company_name")).alias("company_name"),
        F.coalesce(kept_date, now).alias("posted_at"),
        F.when(F.col("b.posted_at").isNotNull(), F.lit(False)).when(F.col("a.posted_at").isNotNull(), F.col("a.posted_estimated")).otherwise(F.lit(True)).alias("posted_estimated"),
        F.when(~seen, F.col("a.expired_at")).alias("expired_at"),
        (seen & ~had).alias("created"),
    )


def merge_entities(children: DataFrame, history: DataFrame, entities: DataFrame, mapping: DataFrame, parent: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(children, history, entities) after losers merge into keepers: children move, a loser's history and the loser go.

    A loser that is further along (``rank`` of entities) than its keeper is refused and stays as it is.
    ``mapping``: loser, keeper.
    """
    ranks = entities.select(F.col("id").alias("_id"), F.col("rank").alias("_rank"))
    both = mapping.join(ranks.toDF("loser", "_lost"), "loser").join(ranks.toDF("keeper", "_kept"), "keeper")
    done = both.filter(F.col("_lost") <= F.col("_kept")).select("loser", "keeper")
    gone = done.select(F.col("loser").alias(parent))
    return repoint(children, parent, done), history.join(gone, parent, "left_anti"), entities.join(done.select(F.col("loser").alias("id")), "id", "left_anti")


def quota(rows: DataFrame, owner: str, order: list[Column], most: int, existing: DataFrame | None = None) -> DataFrame:
    """The rows that fit under ``most`` per owner, first come first; ``existing`` (owner, n) counts already."""
    nth = F.row_number().over(W.partitionBy(owner).orderBy(*order))
    rows = rows.withColumn("_nth", nth)
    if existing is not None:
        rows = rows.join(existing.select(owner, F.col("n").alias("_n")), owner, "left")
        return rows.filter(F.col("_nth") + F.coalesce("_n", F.lit(0)) <= most).drop("_nth", "_n")
    return rows.filter(F.col("_nth") <= most).drop("_nth")


def newest(rows: DataFrame, owner: list[str], order: list[Column], most: int) -> DataFrame:
    """Retention: the first ``most`` rows of each owner in ``order``."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*owner).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def changed(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` in any value, nulls counting as equal."""
    a, b = old.alias("a"), new.alias("b")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    return b.join(a, F.col(f"a.{key}") == F.col(f"b.{key}")).filter(~same).select("b.*")


def sync(table: DataFrame, files: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """What a sync of ``files`` does to ``table`` (with ``managed``): key, action.

    Of files with one key the first counts; rows of another origin are skipped; a managed
    row without a file is deleted; a file that did not parse (``parsed`` false) keeps its row.
    """
    one = files.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
    a, b = table.alias("a"), one.alias("b")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    has, had = F.col(f"b.{key}").isNotNull(), F.col(f"a.{key}").isNotNull()
    action = (
        F.when(has & ~F.col("b.parsed"), "rejected").when(has & had & ~F.col("a.managed"), "skipped").when(has & ~had, "created")
        .when(has & same, "unchanged").when(has, "updated").when(F.col("a.managed"), "deleted").otherwise("kept")
    )
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), action.alias("action"))


def repoint(children: DataFrame, parent: str, mapping: DataFrame) -> DataFrame:
    """Entity merge: children of a loser belong to its keeper. ``mapping``: loser, keeper."""
    moved = children.join(mapping, F.col(parent) == F.col("loser"), "left")
    return moved.withColumn(parent, F.coalesce("keeper", parent)).drop("loser", "keeper")


def unique_slugs(rows: DataFrame, slug: str, order: list[str], most: int = 50) -> DataFrame:
    """base, base-2, base-3 and so on within equal slugs; null beyond ``most``."""
    nth = F.row_number().over(W.partitionBy(slug).orderBy(*order))
    return rows.withColumn("unique_slug", F.when(nth == 1, F.col(slug)).when(nth <= most, F.concat_ws("-", slug, nth.cast("string"))))
