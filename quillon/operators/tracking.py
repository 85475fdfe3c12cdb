"""Applications, their mail and proposals: joins, proposals of status, reviews and plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.classify import status_of
from quillon.operators.events import STATUSES, at_literal, may_advance, may_auto_apply, rank

#: Label of each category on a message; a disregarded one has none.
LABELS = {"confirmation": "Applied", "oa": "Assessment", "interview": "Interview", "offer": "Offer", "rejection": "Rejected", "outreach": "Outreach"}
CREATABLE = ("applied", "oa", "interview", "offer")


def application_rows(apps: DataFrame, variants: DataFrame, events: DataFrame) -> DataFrame:
    """Applications with their variant's label (same user) and each of their events; all kept."""
    v = variants.select(F.col("id").alias("variant"), "user_id", "label")
    return apps.join(v, ["variant", "user_id"], "left").join(events, F.col("id") == F.col("app_id"), "left")


def proposals_with_evidence(proposals: DataFrame, apps: DataFrame, verdicts: DataFrame, messages: DataFrame) -> DataFrame:
    """Proposals of known applications; ``evidence_available`` tells whether the message is still there."""
    joined = proposals.join(apps.select(F.col("id").alias("app_id"), "company"), "app_id")
    joined = joined.join(verdicts.select(F.col("id").alias("verdict_id"), "message_id"), "verdict_id", "left")
    there = messages.select("message_id", F.lit(True).alias("_there"))
    return joined.join(there, "message_id", "left").withColumn("evidence_available", F.col("_there").isNotNull()).drop("_there")


def deadlines_in_context(deadlines: DataFrame, apps: DataFrame, messages: DataFrame) -> DataFrame:
    """Deadlines with company and subject where known; unmatched ones are kept."""
    joined = deadlines.join(apps.select(F.col("id").alias("app_id"), "company"), "app_id", "left")
    return joined.join(messages, "message_id", "left")


def propose_status(mail: DataFrame, apps: DataFrame, pending: DataFrame) -> DataFrame:
    """Adds ``outcome`` to mail (app_id, implied): no_status, no_match, already_pending, already_there, not_ahead or yes.

    ``pending``: app_id, implied of proposals that wait for review.
    """
    waits = pending.select("app_id", "implied", F.lit(True).alias("_waits")).distinct()
    joined = mail.join(apps.select(F.col("id").alias("app_id"), "status"), "app_id", "left").join(waits, ["app_id", "implied"], "left")
    outcome = (
        F.when(F.col("implied").isNull(), "no_status").when(F.col("status").isNull(), "no_match").when(F.col("status") == F.col("implied"), "already_there")
        .when(F.col("_waits"), "already_pending").when(may_advance(F.col("status"), F.col("implied")), "yes").otherwise("not_ahead")
    )
    return joined.withColumn("outcome", outcome).drop("_waits")


def auto_applied(proposed: DataFrame, threshold: float | None) -> DataFrame:
    return proposed.withColumn("auto", (F.col("outcome") == "yes") & may_auto_apply(F.col("implied"), F.col("confidence"), threshold))


def review(proposals: DataFrame, decisions: DataFrame, apps: DataFrame) -> DataFrame:
    """What each decision does: applied, reverted (a refused one that was applied by itself), settled
    (no longer applicable) or rejected. ``proposals``: id, app_id, old, new, auto; ``decisions``: id, accept."""
    joined = proposals.join(decisions, "id").join(apps.select(F.col("id").alias("app_id"), "status"), "app_id", "left")
    fits = F.coalesce(may_advance(F.col("status"), F.col("new")), F.lit(False))
    effect = (
        F.when(~F.col("accept") & F.col("auto"), "reverted").when(~F.col("accept"), "rejected")
        .when(F.col("auto"), "kept").when(fits, "applied").otherwise("settled")
    )
    after = F.when(effect == "applied", F.col("new")).when(effect == "reverted", F.col("old")).otherwise(F.col("status"))
    return joined.select("id", "app_id", effect.alias("effect"), after.alias("status"))


def untracked(mail: DataFrame, proposed: DataFrame) -> DataFrame:
    """New proposals of applications out of mail (company_key, role_key, implied, at, id): one per company and
    role with the highest status said, none for statuses that cannot be created or keys that are there."""
    fit = mail.filter(F.col("implied").isin(*CREATABLE) & (F.col("company_key") != ""))
    best = fit.groupBy("company_key", "role_key").agg(F.max_by("implied", F.struct(rank(F.col("implied")), F.col("at"), F.col("id"))).alias("implied"), F.min("at").alias("at"), F.count(F.lit(1)).alias("n_mails"))
    fresh = best.join(proposed.select("company_key", "role_key").distinct(), ["company_key", "role_key"], "left_anti")
    # A row without a role gives way to a row of the same company with one.
    named = fresh.filter("role_key <> ''").select("company_key").distinct().withColumn("_named", F.lit(True))
    return fresh.join(named, "company_key", "left").filter("role_key <> '' OR _named IS NULL").drop("_named")


def label_of(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), category)


def label_plan(messages: DataFrame) -> DataFrame:
    """Adds ``add`` and ``remove`` to messages (category, recorded: labels put there by us)."""
    wanted = F.array_compact(F.array(label_of(F.col("category"))))
    ours = F.coalesce("recorded", F.array().cast("array<string>"))
    return messages.withColumns({"add": F.array_except(wanted, ours), "remove": F.array_except(ours, wanted)})


def backfilled(apps: DataFrame, proposals: DataFrame) -> DataFrame:
    """Events that applications should have had: a creation each; of each proposal its effect, of one that was applied by
    itself and then refused two; and for an application whose status none explains, that status."""
    created = apps.select(F.col("id").alias("app_id"), F.col("applied_at").alias("at"), F.lit("applied").alias("to_status"), F.lit("creation").alias("cause"))
    took = proposals.filter("auto OR accepted").select("app_id", "at", F.col("new").alias("to_status"), F.lit("proposal").alias("cause"))
    undone = proposals.filter("auto AND NOT accepted").select("app_id", F.col("decided_at").alias("at"), F.col("old").alias("to_status"), F.lit("reverted").alias("cause"))
    known = created.unionByName(took).unionByName(undone)
    last = known.groupBy("app_id").agg(F.max_by("to_status", F.struct("at", "cause")).alias("folded"))
    rest = apps.join(last, F.col("id") == F.col("app_id")).filter(F.col("status") != F.col("folded"))
    return known.unionByName(rest.select("app_id", F.lit(None).cast("timestamp_ntz").alias("at"), F.col("status").alias("to_status"), F.lit("fallback").alias("cause")))


def claimed_once(outcomes: DataFrame) -> DataFrame:
    """Of several mails that imply one status of one application the first received claims it (app_id, implied, at, id)."""
    return outcomes.groupBy("app_id", "implied").agg(F.min(F.struct("at", "id")).alias("f")).select("app_id", "implied", "f.at", "f.id")


def application_list(apps: DataFrame, postings: DataFrame) -> DataFrame:
    """With ``posting_is_live``: null without a posting, else whether it is not expired."""
    p = postings.select("posting_id", F.lit(True).alias("_there"), "expired_at")
    joined = apps.join(p, "posting_id", "left")
    return joined.withColumn("posting_is_live", F.when(F.col("_there"), F.col("expired_at").isNull())).drop("_there", "expired_at")


def snapshot(apps: DataFrame, postings: DataFrame, sightings: DataFrame) -> DataFrame:
    """Applications with a JSON copy of their posting and the source that saw it first (then by name)."""
    first = sightings.groupBy("posting_id").agg(F.min(F.struct("first_seen", "source"))["source"].alias("source"))
    p = postings.select("posting_id", F.to_json(F.struct("posting_id", "company_name", "title")).alias("snapshot_json"))
    return apps.join(p, "posting_id", "left").join(first, "posting_id", "left")


def edit_status(apps: DataFrame, edits: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(applications after, events): ``status_changed_at`` moves and an event is logged only where the status changes."""
    joined = apps.join(edits.select("id", "new_status"), "id", "left")
    moves = F.coalesce(F.col("new_status") != F.col("status"), F.lit(False))
    after = joined.withColumn("status_changed_at", F.when(moves, at_literal(now)).otherwise(F.col("status_changed_at")))
    events = joined.filter(moves).select(F.col("id").alias("app_id"), F.col("status").alias("from_status"), F.col("new_status").alias("to_status"))
    return after.withColumn("status", F.when(moves, F.col("new_status")).otherwise(F.col("status"))).drop("new_status"), events


def decoded_status(c: Column, strict: bool = False) -> Column:
    """A stored status; unknown text is null, or an error where it must not happen."""
    if strict:
        return F.when(c.isNull() | c.isin(*STATUSES), c).otherwise(F.raise_error(F.concat(F.lit("unknown status "), c)).cast("string"))
    return F.when(c.isin(*STATUSES), c)


def reclassified(messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Messages (message_id, now) whose latest stored verdict (message_id, at, id, category) says otherwise, or is missing."""
    last = verdicts.groupBy("message_id").agg(F.max_by("category", F.struct("at", "id")).alias("stored"))
    return messages.join(last, "message_id", "left").filter(~F.col("stored").eqNullSafe(F.col("now")))


def refreshed(pending: DataFrame, changes: DataFrame) -> DataFrame:
    """Proposals (message_id, implied, reviewed) after verdicts changed (message_id, now): one that waits for review says what its
    message says now, if that is a status; ``refreshed`` tells which did."""
    said = changes.select("message_id", status_of(F.col("now")).alias("_said"))
    joined = pending.join(said, "message_id", "left")
    moves = F.coalesce(~F.col("reviewed") & (F.col("_said") != F.col("implied")), F.lit(False))
    return joined.withColumns({"refreshed": moves, "implied": F.when(moves, F.col("_said")).otherwise(F.col("implied"))}).drop("_said")


def relabelled(changes: DataFrame) -> DataFrame:
    """What changed verdicts (message_id, now, recorded: the label that was put there) do to labels: added; replaced, the
    recorded one comes off; withdrawn, nothing is put in its place; or none. A label that is not one of ours stays."""
    wanted, ours = label_of(F.col("now")), F.when(F.col("recorded").isin(*LABELS.values()), F.col("recorded"))
    off = F.when(~ours.eqNullSafe(wanted), ours)
    action = F.when(wanted.isNull() & ours.isNull(), "none").when(wanted.isNull(), "withdrawn").when(off.isNull(), "added").otherwise("replaced")
    after = F.when(wanted.isNull() & ours.isNull(), F.col("recorded")).otherwise(wanted)
    return changes.withColumns({"action": action, "add_label": wanted, "remove_label": off, "recorded_after": after})


def diagnosed(messages: DataFrame) -> DataFrame:
    """Adds ``moved`` and ``invisible_to_the_gate`` to (stored, with_body, metadata_only)."""
    return messages.withColumns(
        {"moved": ~F.col("stored").eqNullSafe(F.col("with_body")), "invisible_to_the_gate": (F.col("with_body") != F.col("metadata_only")) & F.col("stored").eqNullSafe(F.col("metadata_only"))}
    )


def drift(rows: DataFrame, before: str, after: str) -> DataFrame:
    return rows.groupBy(before, after).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("n_moved"))


def labelling_queue(messages: DataFrame, labels: DataFrame, start: datetime, end: datetime, limit: int) -> DataFrame:
    """Messages of the window without a label, in the order of their ids' hashes."""
    inside = messages.filter((F.col("at") >= at_literal(start)) & (F.col("at") < at_literal(end)))
    return inside.join(labels.select("id"), "id", "left_anti").withColumn("place", F.sha2(F.col("id").cast("string"), 256)).orderBy("place").limit(limit)


def inbox_status(runs: DataFrame, accounts: DataFrame) -> DataFrame:
    """The last run of each user, and whether the account was connected anew after it."""
    last = runs.groupBy("user_id").agg(F.max(F.struct("at", "id", "outcome")).alias("r")).select("user_id", F.col("r.at").alias("last_run"), "r.outcome")
    return accounts.join(last, "user_id", "left").withColumn("superseded_by_reconnect", F.coalesce(F.col("connected_at") > F.col("last_run"), F.lit(False)))


def deletable(variants: DataFrame, apps: DataFrame) -> DataFrame:
    """Variants that no application of their user uses."""
    return variants.join(apps.select(F.col("variant").alias("id"), "user_id").distinct(), ["id", "user_id"], "left_anti")


def usage(variants: DataFrame, apps: DataFrame) -> DataFrame:
    """Variants with ``application_count``."""
    n = apps.groupBy(F.col("variant").alias("id"), "user_id").agg(F.count(F.lit(1)).alias("application_count"))
    return variants.join(n, ["id", "user_id"], "left").withColumn("application_count", F.coalesce("application_count", F.lit(0)))


def ungraded(rows: DataFrame, ledger: DataFrame, fingerprint: str) -> DataFrame:
    """Held-out rows that these rules (by fingerprint) were not graded on."""
    return rows.join(ledger.filter(F.col("fingerprint") == fingerprint).select("id"), "id", "left_anti")


def nth_newest(rows: DataFrame, by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order))


def repaired(apps: DataFrame, repairs: DataFrame, apply: bool = False) -> DataFrame:
    """What manual repairs (app_id, to_status) do: unknown_application, same_status (refused), would_repair, or repaired with ``apply``."""
    joined = repairs.join(apps.select(F.col("id").alias("app_id"), "status"), "app_id", "left")
    outcome = F.when(F.col("status").isNull(), "unknown_application").when(F.col("status") == F.col("to_status"), "same_status").otherwise("repaired" if apply else "would_repair")
    return joined.withColumn("outcome", outcome).withColumn("after", F.when(F.col("outcome") == "repaired", F.col("to_status")).otherwise(F.col("status")))


def backfill_outcomes(mail: DataFrame, tracked: DataFrame, proposed: DataFrame) -> DataFrame:
    """Adds ``outcome`` to mail that implies a status (company_key, role_key): unusable, tracked, asked or proposed."""
    t = tracked.select("company_key", F.lit(True).alias("_t")).distinct()
    p = proposed.select("company_key", "role_key", F.lit(True).alias("_p")).distinct()
    joined = mail.filter("implied IS NOT NULL").join(t, "company_key", "left").join(p, ["company_key", "role_key"], "left")
    outcome = F.when(F.coalesce("company_key", F.lit("")) == "", "unusable").when(F.col("_t"), "tracked").when(F.col("_p"), "asked").otherwise("proposed")
    return joined.withColumn("outcome", outcome).drop("_t", "_p")


def decided(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(applications, events, proposals): an accepted proposal (id, company_key, role_key, implied, at) becomes an application
    dated by its mail, with the event of its creation and, beyond applied, of its status; a refused one is only marked."""
    d = proposals.join(decisions.select("id", "accept"), "id", "left")
    taken = d.filter("accept")
    apps = taken.select("id", "company_key", "role_key", F.col("at").alias("applied_at"), F.col("implied").alias("status"))
    steps = F.array_distinct(F.array(F.lit("applied"), F.col("implied")))
    events = taken.select(F.col("id").alias("app_id"), "at", F.explode(steps).alias("to_status"))
    state = F.when(F.col("accept"), "accepted").when(~F.col("accept"), "rejected").otherwise("pending")
    return apps, events, d.withColumn("state", state).drop("accept")


def retitled(pending: DataFrame, tracked: DataFrame) -> DataFrame:
    """What current rules make of pending proposals (id, company_key, role_key, new_company, new_role, implied) beside
    tracked applications (company_key, role_key, status): ahead_of_tracker (says more than any of these, and stays),
    already_tracked (to go), duplicate (to go, its status may raise the kept one's), renamed, retitled or unchanged;
    ``status`` is the highest that the kept one's duplicates say. Of equal ones the least id stays."""
    t = tracked.groupBy(F.col("company_key").alias("new_company"), F.col("role_key").alias("new_role")).agg(F.max_by("status", rank(F.col("status"))).alias("_t"))
    same = pending.groupBy("new_company", "new_role").agg(F.min("id").alias("_first"), F.max_by("implied", F.struct(rank(F.col("implied")), -F.col("id"))).alias("_most"))
    joined = pending.join(t, ["new_company", "new_role"], "left").join(same, ["new_company", "new_role"])
    ahead = F.coalesce(may_advance(F.col("_t"), F.col("implied")), F.lit(False))
    outcome = (
        F.when(F.col("_t").isNotNull(), F.when(ahead, "ahead_of_tracker").otherwise("already_tracked")).when(F.col("id") != F.col("_first"), "duplicate").when(F.col("company_key") != F.col("new_company"), "renamed")
        .when(F.col("role_key") != F.col("new_role"), "retitled").otherwise("unchanged")
    )
    return joined.withColumn("outcome", outcome).select("id", "outcome", F.when(outcome.isin("renamed", "retitled", "unchanged"), F.col("_most")).otherwise(F.col("implied")).alias("status"))
