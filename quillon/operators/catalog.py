"""Runs, scopes and directories; names, lists and what is shown of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.score import days
from quillon.operators.events import at_literal


def scopes_of_runs(scopes: DataFrame, runs: DataFrame) -> DataFrame:
    return scopes.join(runs, ["source", "run"])


def runs_since_gone(verdicts: DataFrame, runs: DataFrame) -> DataFrame:
    """Per (source, scope): distinct runs of the source since the scope was first called gone; 0 if never."""
    first = verdicts.groupBy("source", "scope").agg(F.min(F.when(F.col("gone"), F.col("run"))).alias("first_gone"))
    n = F.count(F.when(F.col("run") >= F.col("first_gone"), F.col("run")))
    return first.join(runs.select("source", "run").distinct(), "source").groupBy("source", "scope").agg(n.alias("n_runs"))


def progress(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched"))


def scope_counts(runs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Runs with the number of scopes attempted and completed, 0 where there is none."""
    n = scopes.groupBy("source", "run").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("completed")).alias("completed"))
    joined = runs.join(n, ["source", "run"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("attempted", "completed")})


def rolled_up(scopes: DataFrame) -> DataFrame:
    """Outcome of each run from its scopes (read, failed, truncated, gone): nothing read is failed; any failure or a
    truncated read is partial; a board that is gone counts as read."""
    one = scopes.groupBy("source", "run").agg(
        F.count_if(F.col("outcome").isin("read", "gone", "truncated")).alias("_read"), F.count_if(F.col("outcome").isin("failed", "truncated")).alias("_bad")
    )
    return one.select("source", "run", F.when(F.col("_read") == 0, "failed").when(F.col("_bad") > 0, "partial").otherwise("success").alias("outcome"))


def due(runs: DataFrame, now: datetime, interval_hours: float) -> DataFrame:
    """One row: is a run due (none yet, or the last began an interval ago)?"""
    age = days(at_literal(now), F.max("started_at")) * 24
    return runs.agg(F.coalesce(age >= interval_hours, F.lit(True)).alias("due"))


def reconciled(runs: DataFrame, now: datetime) -> DataFrame:
    """Runs that never ended are marked interrupted and ended at ``now``."""
    open_ = F.col("ended_at").isNull()
    return runs.withColumns({"interrupted": open_, "ended_at": F.coalesce("ended_at", at_literal(now))})


def pruned(rejects: DataFrame, keep_runs: int, samples: int) -> DataFrame:
    """Rejected rows all; filtered ones of the last runs, and of older runs the first of each reason.

    Runs are ranked among themselves, and of a reason's rows only the first are ranked at all, so that no
    source's or reason's rows meet whole.
    """
    runs = rejects.select("source", "run").distinct()
    recent = runs.withColumn("_last", F.dense_rank().over(W.partitionBy("source").orderBy(F.desc("run")))).filter(F.col("_last") <= keep_runs).drop("_last")
    nth = F.row_number().over(W.partitionBy("source", "run", "reason").orderBy("id"))
    first = rejects.join(recent, ["source", "run"], "left_anti").withColumn("_nth", nth).filter(F.col("_nth") <= samples).drop("_nth")
    kept = rejects.filter("kind = 'rejected'").unionByName(rejects.filter("kind <> 'rejected'").join(recent, ["source", "run"], "left_semi").select(*rejects.columns))
    return kept.unionByName(first.filter("kind <> 'rejected'").select(*rejects.columns))


def reject_counts(runs: DataFrame, rejects: DataFrame) -> DataFrame:
    """Runs with stored rejects; ``payloads_pruned`` where rows were filtered and none is stored."""
    n = rejects.groupBy("source", "run").agg(F.count_if(F.col("kind") == "filtered").alias("stored"))
    joined = runs.join(n, ["source", "run"], "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return joined.withColumn("payloads_pruned", (F.col("filtered_count") > 0) & (F.col("stored") == 0))


def unknown_boards(seen: DataFrame, known: DataFrame, retired: DataFrame) -> DataFrame:
    """Per source the boards seen that are neither known nor retired, in order."""
    fresh = seen.select("source", "slug").distinct().join(known, ["source", "slug"], "left_anti").join(retired, ["source", "slug"], "left_anti")
    return fresh.groupBy("source").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))


def merged_directories(*directories: DataFrame) -> DataFrame:
    """(source, slug) of all, case-blind: one spelling each, the least."""
    rows = directories[0]
    for d in directories[1:]:
        rows = rows.unionByName(d)
    return rows.groupBy("source", F.lower("slug").alias("_k")).agg(F.min("slug").alias("slug")).drop("_k")


def merged_catalog(own: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, aliases, in_stock): own names with the catalog's aliases, then the catalog's other names."""
    a = own.select(F.lower("name").alias("name"), F.col("aliases").alias("_a"), F.lit(True).alias("_own"))
    b = catalog.select(F.lower("name").alias("name"), F.col("aliases").alias("_b"))
    none = F.array().cast("array<string>")
    joined = a.join(b, "name", "full_outer")
    return joined.select("name", F.array_union(F.coalesce("_a", none), F.coalesce("_b", none)).alias("aliases"), F.col("_own").isNotNull().alias("in_stock"))


def named_reviews(reviews: DataFrame, catalog: DataFrame) -> DataFrame:
    return reviews.join(catalog.select("recipe", "name"), "recipe", "left").withColumn("name", F.coalesce("name", F.lit("Unknown recipe")))


def latest_names(stock: DataFrame) -> DataFrame:
    """Distinct names with the time and product of their latest row."""
    last = F.struct("added_at", "row_id")
    return stock.groupBy(F.lower("name").alias("name")).agg(F.max("added_at").alias("added_at"), F.max_by("product_id", last).alias("product_id"))


def display_names(rows: DataFrame) -> DataFrame:
    """The shortest name of each company, then the least."""
    return rows.groupBy("company_key").agg(F.min(F.struct(F.length("company_name"), F.col("company_name").alias("n")))["n"].alias("name"))


def visible(rows: DataFrame, viewer: int) -> DataFrame:
    """Everyone's, own, and public ones that are not hidden."""
    return rows.filter(F.col("owner").isNull() | (F.col("owner") == viewer) | (F.col("is_public") & ~F.col("hidden")))


def facet(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    return rows if value is None else rows.filter(F.array_contains(column, value))


def merged_list(pending: DataFrame) -> DataFrame:
    """Shopping rows of one name and unit as one: quantities summed into the oldest."""
    return pending.groupBy(F.lower("name").alias("name"), "unit").agg(F.min(F.struct("added_at", "row_id"))["row_id"].alias("row_id"), F.sum("quantity").alias("quantity"))


def rebuilt(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A table's rows under a new schema: SQL expression per column."""
    return rows.select(*[F.expr(e).alias(c) for c, e in columns.items()])


def dated_from_mail(apps: DataFrame, mail: DataFrame) -> DataFrame:
    """Applications dated by the mail that their snapshot names, where it is there."""
    m = mail.select(F.col("verdict_id").alias("_v"), F.col("received_at").alias("_at"))
    named = F.get_json_object("snapshot_json", "$.verdict_id").cast("long")
    return apps.withColumn("_n", named).join(m, F.col("_n") == F.col("_v"), "left").withColumn("applied_at", F.coalesce("_at", "applied_at")).drop("_n", "_v", "_at")


def owned(rows: DataFrame, owner: int) -> DataFrame:
    return rows.withColumn("owner", F.coalesce("owner", F.lit(owner)))


def profile_upsert(old: DataFrame, new: DataFrame, key: str, limits: dict[str, int]) -> DataFrame:
    """The new values, trimmed, blank as null; a row with a value over its limit is refused and the old one stays."""
    clean = {c: F.nullif(F.trim(c), F.lit("")) for c in limits}
    fits = F.lit(True)
    for c, most in limits.items():
        fits = fits & (F.coalesce(F.length(F.trim(c)), F.lit(0)) <= most)
    taken = new.filter(fits).withColumns(clean).select(key, *limits)
    return taken.unionByName(old.select(key, *limits).join(taken.select(key), key, "left_anti"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row per folder that changes when a file's name, time or size does."""
    item = F.concat_ws("|", "name", "mtime", "size")
    return files.groupBy("folder").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(item, 256))), ","), 256).alias("fingerprint"))


def answers_after(answers: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, revisions): an edit with another text replaces it and keeps the old one as a revision."""
    joined = answers.join(edits.select("id", F.col("text").alias("_new")), "id", "left")
    moves = F.coalesce(F.col("_new") != F.col("text"), F.lit(False))
    revisions = joined.filter(moves).select("id", F.col("text").alias("old_text"))
    return joined.withColumn("text", F.when(moves, F.col("_new")).otherwise(F.col("text"))).drop("_new"), revisions


def balanced(report: DataFrame, buckets: list[str]) -> DataFrame:
    """Do a sync's counters add up: classified by bucket, fetched as classified and seen before?"""
    total = F.lit(0)
    for b in buckets:
        total = total + F.col(b)
    return report.withColumn("balanced", (F.col("classified") == total) & (F.col("fetched") == F.col("classified") + F.col("seen")))


def tier_alerts(created: DataFrame, tiers: DataFrame, told: DataFrame, most_tier: int = 2) -> DataFrame:
    """New postings of the best companies that no alert told of yet."""
    best = tiers.groupBy(F.trim(F.lower("key")).alias("company_key")).agg(F.min("tier").alias("tier")).filter(F.col("tier") <= most_tier)
    return created.join(best, "company_key").join(told.select("posting_id"), "posting_id", "left_anti")


def ordered_labels(rows: DataFrame) -> list[Column]:
    """Unarchived first, then by label case-blind."""
    return [F.col("archived").asc(), F.lower("label").asc(), F.col("id").asc()]
