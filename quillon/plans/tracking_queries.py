"""Applications, proposals, labels and plans over tables made of orders, events and customers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillon.operators import tracking as T
from quillon.operators.events import STATUSES
from quillon.plans import adapters as A
from quillon.plans.registry import query
from quillon.session import table

_APPS = """apps AS (SELECT o_orderkey AS id, o_custkey // 8 AS user_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 400 + 1 END AS posting_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 8 END AS variant,
 ['applied', 'oa', 'interview', 'offer', 'rejected'][o_orderkey % 5 + 1] AS status, o_orderdate AS applied_at, 'co-' || (o_custkey % 97) AS company FROM orders),
variants AS (SELECT c_custkey % 8 AS id, c_custkey // 8 AS user_id, c_name AS label, c_custkey % 5 = 0 AS archived FROM customer)"""


def _apps(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"), F.expr("o_custkey div 8").alias("user_id"), F.when(k % 7 != 0, k % 400 + 1).alias("posting_id"), F.when(k % 3 != 0, k % 8).alias("variant"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (k % 5 + 1).cast("int")).alias("status"), F.col("o_orderdate").alias("applied_at"), F.concat(F.lit("co-"), (F.col("o_custkey") % 97).cast("string")).alias("company"),
    )


def _variants(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select((k % 8).alias("id"), F.expr("c_custkey div 8").alias("user_id"), F.col("c_name").alias("label"), (k % 5 == 0).alias("archived"))


@query(f"""WITH {_APPS} SELECT a.id, v.label, count(e.event_id) AS n_events FROM apps a LEFT JOIN variants v ON a.variant = v.id AND a.user_id = v.user_id LEFT JOIN events e ON e.user_id = a.id GROUP BY 1, 2""")
def jn1_application_rows(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("app_id"), "event_id")
    rows = T.application_rows(_apps(spark, sf), _variants(spark, sf), events)
    return rows.groupBy("id", "label").agg(F.count("event_id").alias("n_events"))


_MAIL = """mail AS (SELECT event_id AS id, ts AS stamp, user_id * 10 + 1 AS app_id, ['oa', 'interview', 'offer', 'rejected', NULL][event_id % 5 + 1] AS implied, value / 100 AS confidence, event_id % 1000 AS message_id FROM events)"""


def _mail(spark, sf):
    k = F.col("event_id")
    implied = F.element_at(F.array(*[F.lit(x) for x in ("oa", "interview", "offer", "rejected", None)]), (k % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(k.alias("id"), F.col("ts").alias("at"), (F.col("user_id") * 10 + 1).alias("app_id"), implied.alias("implied"), (F.col("value") / 100).alias("confidence"), (k % 1000).alias("message_id"))


@query(f"""WITH {_APPS}, {_MAIL}, p AS (SELECT id, app_id, CASE WHEN id % 3 <> 0 THEN id END AS verdict_id FROM mail), v AS (SELECT id, message_id FROM mail WHERE id % 4 <> 0), m AS (SELECT p_partkey AS message_id FROM part WHERE p_partkey % 2 = 0)
SELECT p.id, a.company, m.message_id IS NOT NULL AS evidence_available FROM p JOIN apps a ON a.id = p.app_id LEFT JOIN v ON v.id = p.verdict_id LEFT JOIN m ON m.message_id = v.message_id""")
def jn7_proposals(spark, sf):
    mail = _mail(spark, sf)
    proposals = mail.select("id", "app_id", F.when(F.col("id") % 3 != 0, F.col("id")).alias("verdict_id"))
    messages = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("message_id"))
    return T.proposals_with_evidence(proposals, _apps(spark, sf), mail.filter("id % 4 <> 0").select("id", "message_id"), messages).select("id", "company", "evidence_available")


@query(f"""WITH {_APPS}, d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey + l_linenumber AS app_id, l_partkey AS message_id FROM lineitem)
SELECT d.id, a.company, p_name AS subject FROM d LEFT JOIN apps a ON a.id = d.app_id LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 1) ON p_partkey = message_id""")
def jn8_deadlines(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("app_id"), F.col("l_partkey").alias("message_id"))
    m = table(spark, sf, "part").filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("message_id"), F.col("p_name").alias("subject"))
    return T.deadlines_in_context(d, _apps(spark, sf), m).select("id", "company", "subject")


_OUTCOMES = """ranks AS (SELECT m.*, a.status, w.app_id IS NOT NULL AS waits, CASE a.status WHEN 'applied' THEN 1 WHEN 'oa' THEN 2 WHEN 'interview' THEN 3 ELSE 4 END AS o, CASE m.implied WHEN 'oa' THEN 2 WHEN 'interview' THEN 3 ELSE 4 END AS n
 FROM mail m LEFT JOIN apps a ON a.id = m.app_id LEFT JOIN (SELECT DISTINCT app_id, implied FROM mail WHERE id % 97 = 0) w ON w.app_id = m.app_id AND w.implied = m.implied),
outcomes AS (SELECT *, CASE WHEN implied IS NULL THEN 'no_status' WHEN status IS NULL THEN 'no_match' WHEN status = implied THEN 'already_there' WHEN waits THEN 'already_pending' WHEN CASE WHEN n = 4 THEN o < 4 ELSE n > o END THEN 'yes' ELSE 'not_ahead' END AS outcome FROM ranks)"""


def _outcomes(spark, sf):
    mail = _mail(spark, sf)
    return T.propose_status(mail, _apps(spark, sf), mail.filter("id % 97 = 0").select("app_id", "implied"))


@query(f"WITH {_APPS}, {_MAIL}, {_OUTCOMES} SELECT id, outcome, outcome = 'yes' AND n < 4 AND confidence >= 0.6 AS auto FROM outcomes")
def cl8_propose_status(spark, sf):
    """With CL-7: which of the proposals may be applied by themselves."""
    return T.auto_applied(_outcomes(spark, sf), 0.6).select("id", "outcome", "auto")


@query(f"""WITH {_APPS}, {_MAIL}, {_OUTCOMES}, y AS (SELECT id, app_id, status AS old, implied AS new, n < 4 AND confidence >= 0.6 AS auto, id % 4 <> 0 AS accept FROM outcomes WHERE outcome = 'yes'),
later AS (SELECT y.*, CASE WHEN a.id % 6 = 1 THEN 'rejected' ELSE a.status END AS status FROM y JOIN apps a ON a.id = app_id),
e AS (SELECT *, CASE WHEN NOT accept AND auto THEN 'reverted' WHEN NOT accept THEN 'rejected' WHEN auto THEN 'kept' WHEN status <> new AND CASE WHEN new IN ('offer', 'rejected') THEN status NOT IN ('offer', 'rejected') ELSE list_position(['applied', 'oa', 'interview', 'offer', 'rejected'], new) > list_position(['applied', 'oa', 'interview', 'offer', 'rejected'], status) END THEN 'applied' ELSE 'settled' END AS effect FROM later)
SELECT id, app_id, effect, CASE effect WHEN 'applied' THEN new WHEN 'reverted' THEN old ELSE status END AS status FROM e""")
def cl9_review(spark, sf):
    yes = T.auto_applied(_outcomes(spark, sf), 0.6).filter("outcome = 'yes'").select("id", "app_id", F.col("status").alias("old"), F.col("implied").alias("new"), F.coalesce("auto", F.lit(False)).alias("auto"))
    decisions = yes.select("id", (F.col("id") % 4 != 0).alias("accept"))
    apps = _apps(spark, sf).withColumn("status", F.when(F.col("id") % 6 == 1, "rejected").otherwise(F.col("status")))
    return T.review(yes, decisions, apps)


@query(f"""WITH {_MAIL}, k AS (SELECT *, CASE WHEN id % 11 = 0 THEN '' ELSE 'co-' || (app_id % 23) END AS company_key, CASE WHEN id % 3 = 0 THEN '' ELSE 'role ' || (id % 4) END AS role_key FROM mail),
b AS (SELECT company_key, role_key, arg_max(implied, struct_pack(a := CASE implied WHEN 'oa' THEN 2 WHEN 'interview' THEN 3 ELSE 4 END, b := stamp, c := id)) AS implied, min(stamp) AS stamp, count(*) AS n_mails FROM k WHERE implied IN ('oa', 'interview', 'offer') AND company_key <> '' GROUP BY 1, 2),
f AS (SELECT * FROM b WHERE NOT (company_key = 'co-1' AND role_key = 'role 1') AND NOT (company_key = 'co-2' AND role_key <> ''))
SELECT company_key, role_key, implied, epoch_us(stamp) // 1000 AS at_ms, n_mails FROM f WHERE role_key <> '' OR company_key NOT IN (SELECT company_key FROM f WHERE role_key <> '')""")
def cl10_untracked(spark, sf):
    k = F.col("id")
    mail = _mail(spark, sf).withColumns({"company_key": F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("co-"), (F.col("app_id") % 23).cast("string"))), "role_key": F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("role "), (k % 4).cast("string")))})
    there = spark.createDataFrame([("co-1", "role 1"), *[("co-2", f"role {i}") for i in range(4)]], "company_key string, role_key string")
    return T.untracked(mail, there).select("company_key", "role_key", "implied", F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), "n_mails")


_CATEGORY = "['confirmation', 'oa', 'interview', 'offer', 'rejection', 'outreach', 'disregarded']"
_LABEL_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LABELS.items()) + " END"


def _labelled(spark, sf):
    k = F.col("event_id")
    names = [*T.LABELS, "disregarded"]
    category = F.element_at(F.array(*map(F.lit, names)), (k % 7 + 1).cast("int"))
    recorded = F.when(k % 3 == 0, F.array(F.lit("Applied"))).when(k % 3 == 1, F.array(T.label_of(category))).otherwise(F.lit(None))
    return table(spark, sf, "events").select(k.alias("id"), category.alias("category"), F.array_compact(recorded).alias("recorded"))


@query(f"""WITH m AS (SELECT event_id AS id, {_CATEGORY}[event_id % 7 + 1] AS category FROM events), r AS (SELECT *, {_LABEL_SQL} AS label, CASE id % 3 WHEN 0 THEN 'Applied' WHEN 1 THEN {_LABEL_SQL} END AS recorded FROM m)
SELECT id, CASE WHEN label IS DISTINCT FROM recorded THEN coalesce(label, '') ELSE '' END AS added, CASE WHEN label IS DISTINCT FROM recorded THEN coalesce(recorded, '') ELSE '' END AS removed FROM r""")
def cl11_label_plan(spark, sf):
    """With CP-28: which label goes on a message and which of ours comes off."""
    plan = T.label_plan(_labelled(spark, sf))
    return plan.select("id", F.array_join("add", ",").alias("added"), F.array_join("remove", ",").alias("removed"))


@query(f"""WITH m AS (SELECT event_id AS id, {_CATEGORY}[event_id % 7 + 1] AS category FROM events), r AS (SELECT *, {_LABEL_SQL} AS label, CASE id % 3 WHEN 0 THEN 'Applied' WHEN 1 THEN {_LABEL_SQL} END AS recorded FROM m)
SELECT count(*) FILTER (WHERE label IS NOT NULL AND label IS DISTINCT FROM recorded) AS n_missing, count(*) FILTER (WHERE recorded IS NOT NULL AND label IS DISTINCT FROM recorded) AS n_extra FROM r""")
def cl12_label_drift(spark, sf):
    from quillon.operators.classify import label_drift

    rows = _labelled(spark, sf).withColumns({"expected": F.array_compact(F.array(T.label_of(F.col("category")))), "present": F.coalesce("recorded", F.array().cast("array<string>"))})
    found = label_drift(rows, "expected", "present")
    return found.agg(F.count_if(F.size("missing") > 0).alias("n_missing"), F.count_if(F.size("extra") > 0).alias("n_extra"))


@query(f"""WITH {_APPS}, {_MAIL}, p AS (SELECT m.app_id, m.stamp, m.stamp + INTERVAL 1 DAY AS decided, a.status AS old, m.implied AS new, m.id % 3 = 0 AS auto, m.id % 2 = 0 AS accepted FROM mail m JOIN apps a ON a.id = m.app_id WHERE m.implied IS NOT NULL AND m.id % 5 < 3),
k AS (SELECT id AS app_id, applied_at AS stamp, 'applied' AS to_status, 'creation' AS cause FROM apps UNION ALL SELECT app_id, stamp, new, 'proposal' FROM p WHERE auto OR accepted UNION ALL SELECT app_id, decided, old, 'reverted' FROM p WHERE auto AND NOT accepted),
l AS (SELECT app_id, arg_max(to_status, struct_pack(a := stamp, b := cause)) AS folded FROM k GROUP BY 1)
SELECT cause, to_status, count(*) AS n FROM (SELECT cause, to_status FROM k UNION ALL SELECT 'fallback', status FROM apps JOIN l ON id = app_id WHERE status <> folded) GROUP BY 1, 2""")
def cl15_backfilled(spark, sf):
    apps = _apps(spark, sf)
    mail = _mail(spark, sf).filter("implied IS NOT NULL AND id % 5 < 3").join(apps.select(F.col("id").alias("app_id"), "status"), "app_id")
    proposals = mail.select("app_id", "at", (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("decided_at"), F.col("status").alias("old"), F.col("implied").alias("new"), (F.col("id") % 3 == 0).alias("auto"), (F.col("id") % 2 == 0).alias("accepted"))
    return T.backfilled(apps, proposals).groupBy("cause", "to_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_APPS}, {_MAIL}, {_OUTCOMES} SELECT app_id, implied, arg_min(id, struct_pack(a := stamp, b := id)) AS id FROM outcomes WHERE outcome = 'yes' GROUP BY 1, 2""")
def cp14_claimed_once(spark, sf):
    return T.claimed_once(_outcomes(spark, sf).filter("outcome = 'yes'")).select("app_id", "implied", "id")


@query(f"""WITH {_APPS}, {A.POSTINGS} SELECT a.id, CASE WHEN p.posting_id IS NOT NULL THEN p.expired_at IS NULL END AS posting_is_live FROM apps a LEFT JOIN postings p USING (posting_id) ORDER BY applied_at DESC, a.id DESC LIMIT 100""")
def cp7_application_list(spark, sf):
    rows = T.application_list(_apps(spark, sf), A.postings(spark, sf, deadlines=False))
    return rows.orderBy(F.desc("applied_at"), F.desc("id")).limit(100).select("id", "posting_is_live")


@query(f"""WITH {_APPS}, s AS (SELECT l_orderkey AS posting_id, arg_min('s' || (l_suppkey % 5), struct_pack(a := l_shipdate, b := 's' || (l_suppkey % 5))) AS source FROM lineitem GROUP BY 1)
SELECT a.id, CASE WHEN o.o_orderkey IS NOT NULL THEN to_json(struct_pack(posting_id := o.o_orderkey, company_name := 'Co ' || (o.o_custkey % 97), title := c_mktsegment || ' engineer ' || (o.o_orderkey % 7))) END AS snapshot_json, s.source
FROM apps a LEFT JOIN (orders o JOIN customer ON o_custkey = c_custkey) ON o.o_orderkey = a.posting_id LEFT JOIN s ON s.posting_id = a.posting_id""")
def cp6_snapshot(spark, sf):
    seen = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("posting_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source"), F.col("l_shipdate").alias("first_seen"))
    return T.snapshot(_apps(spark, sf), A.postings(spark, sf, deadlines=False), seen).select("id", "snapshot_json", "source")


_EDIT = "e AS (SELECT id, status, CASE WHEN id % 4 = 0 THEN status WHEN id % 4 = 1 THEN 'offer' END AS new_status, id % 9 = 0 AS moved_before FROM apps)"


def _edited(spark, sf):
    apps, k = _apps(spark, sf), F.col("id")
    apps = apps.withColumn("status_changed_at", F.when(k % 9 == 0, F.lit("2001-01-01").cast("timestamp_ntz")))
    edits = apps.select("id", F.when(k % 4 == 0, F.col("status")).when(k % 4 == 1, "offer").alias("new_status")).filter("new_status IS NOT NULL")
    return T.edit_status(apps, edits, datetime(2002, 2, 2))


@query(f"""WITH {_APPS}, {_EDIT} SELECT id, CASE WHEN new_status <> status THEN new_status ELSE status END AS status, CASE WHEN new_status <> status THEN '2002-02-02' WHEN moved_before THEN '2001-01-01' END AS changed FROM e""")
def cp8_status_edit(spark, sf):
    return _edited(spark, sf)[0].select("id", "status", F.date_format("status_changed_at", "yyyy-MM-dd").alias("changed"))


@query(f"""WITH {_APPS}, {_EDIT} SELECT status AS from_status, new_status AS to_status, count(*) AS n FROM e WHERE new_status <> status GROUP BY 1, 2""")
def cp8_edit_events(spark, sf):
    return _edited(spark, sf)[1].groupBy("from_status", "to_status").agg(F.count(F.lit(1)).alias("n"))


_VERDICTS = "v AS (SELECT conv_id, turn, CASE WHEN contains(text, 'a') THEN 'oa' ELSE 'offer' END AS category, conv_id * 100 + turn AS message_id FROM conversations WHERE conv_id % 5 <> 0)"


@query(f"""WITH {_VERDICTS}, n AS (SELECT conv_id * 100 + turn AS message_id, CASE WHEN length(text) % 2 = 0 THEN 'oa' ELSE 'offer' END AS now FROM conversations)
SELECT n.message_id, category AS stored, now FROM n LEFT JOIN v USING (message_id) WHERE category IS DISTINCT FROM now""")
def cp10_reclassified(spark, sf):
    m = A.messages(spark, sf).withColumn("message_id", F.col("conv_id") * 100 + F.col("turn"))
    stored = m.filter("conv_id % 5 <> 0").select("message_id", F.col("turn").alias("at"), F.col("conv_id").alias("id"), F.when(F.contains("text", F.lit("a")), "oa").otherwise("offer").alias("category"))
    older = stored.withColumns({"at": F.col("at") - 1, "category": F.lit("rejection")})
    now = m.select("message_id", F.when(F.length("text") % 2 == 0, "oa").otherwise("offer").alias("now"))
    return T.reclassified(now, stored.unionByName(older)).select("message_id", "stored", "now")


_LABEL = "CASE {} WHEN 'confirmation' THEN 'Applied' WHEN 'oa' THEN 'Assessment' WHEN 'interview' THEN 'Interview' WHEN 'offer' THEN 'Offer' WHEN 'rejection' THEN 'Rejected' WHEN 'outreach' THEN 'Outreach' END"


@query(f"""WITH c AS (SELECT conv_id * 100 + turn AS message_id, ['oa', 'offer', 'disregarded', 'interview'][length(text) % 4 + 1] AS now, CASE conv_id % 3 WHEN 0 THEN 'Assessment' WHEN 1 THEN 'Starred' END AS recorded FROM conversations),
w AS (SELECT *, {_LABEL.format('now')} AS wanted, CASE WHEN recorded IN ('Applied', 'Assessment', 'Interview', 'Offer', 'Rejected', 'Outreach') THEN recorded END AS ours FROM c)
SELECT message_id, CASE WHEN wanted IS NULL AND ours IS NULL THEN 'none' WHEN wanted IS NULL THEN 'withdrawn' WHEN ours IS NULL OR ours = wanted THEN 'added' ELSE 'replaced' END AS action, wanted AS add_label, CASE WHEN ours IS DISTINCT FROM wanted THEN ours END AS remove_label,
 CASE WHEN wanted IS NULL AND ours IS NULL THEN recorded ELSE wanted END AS recorded_after FROM w""")
def cp10_relabelled(spark, sf):
    now = F.element_at(F.array(*map(F.lit, ("oa", "offer", "disregarded", "interview"))), (F.length("text") % 4 + 1).cast("int"))
    changed = A.messages(spark, sf).select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), now.alias("now"), F.when(F.col("conv_id") % 3 == 0, "Assessment").when(F.col("conv_id") % 3 == 1, "Starred").alias("recorded"))
    return T.relabelled(changed).select("message_id", "action", "add_label", "remove_label", "recorded_after")


@query("""WITH c AS (SELECT conv_id * 100 + turn AS message_id, ['oa', 'offer', 'outreach'][length(text) % 3 + 1] AS now FROM conversations),
p AS (SELECT event_id AS id, event_id % 10000 AS message_id, ['oa', 'interview', 'offer'][event_id % 3 + 1] AS implied, event_id % 4 = 0 AS reviewed FROM events)
SELECT id, CASE WHEN NOT reviewed AND now IN ('oa', 'offer') AND now <> implied THEN now ELSE implied END AS implied, NOT reviewed AND now IS NOT NULL AND now IN ('oa', 'offer') AND now <> implied AS refreshed FROM p LEFT JOIN c USING (message_id)""")
def cp10_refreshed_pending(spark, sf):
    now = F.element_at(F.array(*map(F.lit, ("oa", "offer", "outreach"))), (F.length("text") % 3 + 1).cast("int"))
    changed = A.messages(spark, sf).select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), now.alias("now"))
    k = F.col("event_id")
    pending = table(spark, sf, "events").select(k.alias("id"), (k % 10000).alias("message_id"), F.element_at(F.array(*map(F.lit, ("oa", "interview", "offer"))), (k % 3 + 1).cast("int")).alias("implied"), (k % 4 == 0).alias("reviewed"))
    return T.refreshed(pending, changed).select("id", "implied", "refreshed")


@query("""WITH d AS (SELECT event_id AS id, ['oa', 'offer', NULL][event_id % 3 + 1] AS stored, ['oa', 'offer'][event_id % 2 + 1] AS with_body, ['offer', 'oa', 'oa'][event_id % 3 + 1] AS metadata_only FROM events)
SELECT stored, with_body, count(*) AS n, count(*) FILTER (WHERE stored IS DISTINCT FROM with_body) AS n_moved, count(*) FILTER (WHERE with_body <> metadata_only AND stored IS NOT DISTINCT FROM metadata_only) AS n_invisible FROM d GROUP BY 1, 2""")
def cp15_diagnosed(spark, sf):
    """With AG-22: tallies of stored against current verdicts."""
    k = F.col("event_id")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    rows = T.diagnosed(table(spark, sf, "events").select(k.alias("id"), pick(3, "oa", "offer", None).alias("stored"), pick(2, "oa", "offer").alias("with_body"), pick(3, "offer", "oa", "oa").alias("metadata_only")))
    return rows.groupBy("stored", "with_body").agg(F.count(F.lit(1)).alias("n"), F.count_if("moved").alias("n_moved"), F.count_if("invisible_to_the_gate").alias("n_invisible"))


@query("""SELECT stored, now, count(*) AS n, count(*) FILTER (WHERE stored IS DISTINCT FROM now) AS n_moved FROM (SELECT CASE WHEN quality = 1 THEN 'offer' END AS stored, CASE WHEN toxic = 1 THEN 'disregarded' ELSE 'offer' END AS now FROM labels) GROUP BY 1, 2""")
def ag22_drift(spark, sf):
    rows = table(spark, sf, "labels").select(F.when(F.col("quality") == 1, "offer").alias("stored"), F.when(F.col("toxic") == 1, "disregarded").otherwise("offer").alias("now"))
    return T.drift(rows, "stored", "now")


@query("""SELECT event_id AS id, sha256(CAST(event_id AS VARCHAR)) AS place FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_id % 3 <> 0 ORDER BY 2 LIMIT 30""")
def cp16_labelling_queue(spark, sf):
    m = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return T.labelling_queue(m, m.filter("id % 3 = 0"), datetime(2024, 1, 5), datetime(2024, 1, 20), 30).select("id", "place")


@query("""WITH r AS (SELECT user_id, max(struct_pack(a := ts, b := event_id, c := event_type)) AS r FROM events GROUP BY 1), a AS (SELECT c_custkey AS user_id, TIMESTAMP '2024-01-28' + to_hours(CAST(c_custkey % 60 AS INTEGER)) AS connected_at FROM customer)
SELECT user_id, r.c AS outcome, coalesce(connected_at > r.a, false) AS superseded_by_reconnect FROM a LEFT JOIN r USING (user_id)""")
def cp26_inbox_status(spark, sf):
    runs = table(spark, sf, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("outcome"))
    accounts = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.lit("2024-01-28").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("c_custkey") % 60).cast("int"))).alias("connected_at"))
    return T.inbox_status(runs, accounts).select("user_id", "outcome", "superseded_by_reconnect")


@query(f"""WITH {_APPS} SELECT v.id, v.user_id FROM variants v WHERE NOT EXISTS (SELECT 1 FROM apps a WHERE a.variant = v.id AND a.user_id = v.user_id AND a.id % 40 = 1)""")
def cp20_deletable_variants(spark, sf):
    return T.deletable(_variants(spark, sf), _apps(spark, sf).filter("id % 40 = 1")).select("id", "user_id")


@query(f"""WITH {_APPS} SELECT v.id, v.user_id, v.label, (SELECT count(*) FROM apps a WHERE a.variant = v.id AND a.user_id = v.user_id) AS application_count FROM variants v""")
def ag21_variant_usage(spark, sf):
    return T.usage(_variants(spark, sf), _apps(spark, sf)).select("id", "user_id", "label", "application_count")


@query(f"""WITH {_APPS} SELECT label, archived FROM variants ORDER BY archived, lower(label), id LIMIT 40""")
def so8_variant_order(spark, sf):
    from quillon.operators.catalog import ordered_labels

    return _variants(spark, sf).orderBy(*ordered_labels(None)).limit(40).select("label", "archived")


@query("""SELECT p_partkey AS id, CASE WHEN s IN ('applied', 'oa', 'interview', 'offer', 'rejected') THEN s END AS status FROM (SELECT p_partkey, ['applied', 'OA', 'offer', 'withdrawn'][p_partkey % 4 + 1] AS s FROM part)""")
def cp27_decoded_status(spark, sf):
    s = F.element_at(F.array(*map(F.lit, ("applied", "OA", "offer", "withdrawn"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.decoded_status(s).alias("status"))


@query("""SELECT doc_id AS id FROM labels WHERE NOT (doc_id % 4 = 0 OR doc_id % 6 = 0)""")
def st10_ungraded(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    ledger = rows.filter("id % 4 = 0 OR id % 6 = 0").withColumn("fingerprint", F.lit("now")).unionByName(rows.withColumn("fingerprint", F.lit("before")))
    return T.ungraded(rows, ledger, "now")


@query(f"""WITH {_APPS}, r AS (SELECT o_orderkey + o_orderkey % 3 * 1000000 AS app_id, ['oa', 'offer'][o_orderkey % 2 + 1] AS to_status FROM orders WHERE o_orderkey % 4 = 1)
SELECT app_id, CASE WHEN status IS NULL THEN 'unknown_application' WHEN status = to_status THEN 'same_status' ELSE 'repaired' END AS outcome, CASE WHEN status <> to_status THEN to_status ELSE status END AS after FROM r LEFT JOIN apps ON id = app_id""")
def cp9_repaired(spark, sf):
    k = F.col("o_orderkey")
    repairs = table(spark, sf, "orders").filter(k % 4 == 1).select((k + k % 3 * 1000000).alias("app_id"), F.element_at(F.array(F.lit("oa"), F.lit("offer")), (k % 2 + 1).cast("int")).alias("to_status"))
    return T.repaired(_apps(spark, sf), repairs, apply=True).select("app_id", "outcome", "after")


_KEYED = "k AS (SELECT *, CASE WHEN id % 11 = 0 THEN '' ELSE 'co-' || (app_id % 23) END AS company_key, CASE WHEN id % 3 = 0 THEN '' ELSE 'role ' || (id % 4) END AS role_key FROM mail)"


def _keyed(spark, sf):
    k = F.col("id")
    return _mail(spark, sf).withColumns({"company_key": F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("co-"), (F.col("app_id") % 23).cast("string"))), "role_key": F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("role "), (k % 4).cast("string")))})


@query(f"""WITH {_MAIL}, {_KEYED} SELECT CASE WHEN company_key = '' THEN 'unusable' WHEN company_key IN ('co-3', 'co-4', 'co-5') THEN 'tracked' WHEN company_key = 'co-6' AND role_key IN ('role 1', 'role 2') THEN 'asked' ELSE 'proposed' END AS outcome, count(*) AS n FROM k WHERE implied IS NOT NULL GROUP BY 1""")
def cp11_backfill_counters(spark, sf):
    tracked = spark.createDataFrame([(f"co-{i}",) for i in (3, 4, 5)], "company_key string")
    asked = spark.createDataFrame([("co-6", "role 1"), ("co-6", "role 2")], "company_key string, role_key string")
    return T.backfill_outcomes(_keyed(spark, sf), tracked, asked).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_MAIL}, {_KEYED}, p AS (SELECT *, CASE WHEN id % 5 < 2 THEN id % 2 = 0 END AS accept FROM k WHERE implied IN ('oa', 'interview', 'offer') AND id % 7 = 0)
SELECT 'application' AS kind, id, implied AS what FROM p WHERE accept UNION ALL SELECT 'event', id, unnest(['applied', implied]) FROM p WHERE accept UNION ALL SELECT 'proposal', id, CASE WHEN accept THEN 'accepted' WHEN NOT accept THEN 'rejected' ELSE 'pending' END FROM p""")
def cp12_decided(spark, sf):
    p = _keyed(spark, sf).filter("implied IN ('oa', 'interview', 'offer') AND id % 7 = 0")
    apps, events, left = T.decided(p, p.filter("id % 5 < 2").select("id", (F.col("id") % 2 == 0).alias("accept")))
    rows = apps.select(F.lit("application").alias("kind"), "id", F.col("status").alias("what"))
    rows = rows.unionByName(events.select(F.lit("event").alias("kind"), F.col("app_id").alias("id"), F.col("to_status").alias("what")))
    return rows.unionByName(left.select(F.lit("proposal").alias("kind"), "id", F.col("state").alias("what")))


@query(f"""WITH {_MAIL}, {_KEYED}, p AS (SELECT id, company_key, role_key, implied, CASE WHEN id % 9 = 0 THEN 'co-1' ELSE company_key END AS nc, CASE WHEN id % 10 = 0 THEN 'role ' || id ELSE role_key || '!' END AS nr FROM k WHERE implied IN ('oa', 'interview', 'offer') AND company_key <> '' AND id % 3 <> 0),
q AS (SELECT id, company_key, role_key, implied, nc, CASE WHEN id % 4 = 1 THEN role_key ELSE nr END AS nr FROM p),
s AS (SELECT nc, nr, min(id) AS first, arg_max(implied, struct_pack(a := CASE implied WHEN 'oa' THEN 2 WHEN 'interview' THEN 3 ELSE 4 END, b := -id)) AS most FROM q GROUP BY 1, 2),
o AS (SELECT q.*, most, CASE WHEN nc = 'co-2' AND nr = 'role 1' THEN CASE WHEN implied = 'offer' THEN 'ahead_of_tracker' ELSE 'already_tracked' END WHEN id <> first THEN 'duplicate' WHEN company_key <> nc THEN 'renamed' WHEN role_key <> nr THEN 'retitled' ELSE 'unchanged' END AS outcome FROM q JOIN s USING (nc, nr))
SELECT id, outcome, CASE WHEN outcome IN ('renamed', 'retitled', 'unchanged') THEN most ELSE implied END AS status FROM o""")
def cp13_retitled(spark, sf):
    k = F.col("id")
    p = _keyed(spark, sf).filter("implied IN ('oa', 'interview', 'offer') AND company_key <> '' AND id % 3 <> 0")
    p = p.withColumns({"new_company": F.when(k % 9 == 0, "co-1").otherwise(F.col("company_key")), "new_role": F.when(k % 4 == 1, F.col("role_key")).when(k % 10 == 0, F.concat(F.lit("role "), k.cast("string"))).otherwise(F.concat("role_key", F.lit("!")))})
    return T.retitled(p, spark.createDataFrame([("co-2", "role 1", "interview"), ("co-2", "role 1", "oa")], "company_key string, role_key string, status string"))
