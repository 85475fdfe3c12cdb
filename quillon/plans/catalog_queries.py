"""Runs, directories, names, lists and what is shown, over tables made of events, parts and orders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillon.functions import shown as H
from quillon.functions import text as X
from quillon.operators import catalog as C
from quillon.operators import listing as L
from quillon.operators import matching as M
from quillon.plans import adapters as A
from quillon.plans.registry import query
from quillon.session import table


def _scopes(spark, sf):
    """source, run, scope, gone, completed."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("source"), F.to_date("ts").alias("run"), (F.col("user_id") % 20).alias("scope"), (F.col("event_id") % 13 == 0).alias("gone"), (F.col("event_id") % 4 != 0).alias("completed"), F.col("event_id").alias("id"))


_SCOPES = "scopes AS (SELECT event_type AS source, CAST(ts AS DATE) AS run, user_id % 20 AS scope, event_id % 13 = 0 AS gone, event_id % 4 <> 0 AS completed, event_id AS id FROM events)"


@query(f"WITH {A.RUNS}, {_SCOPES} SELECT outcome, scope, count(*) AS n FROM scopes JOIN runs USING (source, run) GROUP BY 1, 2")
def jn10_scopes_of_runs(spark, sf):
    return C.scopes_of_runs(_scopes(spark, sf), A.runs(spark, sf)[0]).groupBy("outcome", "scope").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {A.RUNS}, {_SCOPES}, f AS (SELECT source, scope, min(run) FILTER (WHERE gone) AS first_gone FROM scopes GROUP BY 1, 2)
SELECT source, scope, (SELECT count(DISTINCT run) FROM runs r WHERE r.source = f.source AND r.run >= first_gone) AS n_runs FROM f""")
def ag11_runs_since_gone(spark, sf):
    return C.runs_since_gone(_scopes(spark, sf), A.runs(spark, sf)[0])


@query(f"WITH {A.RUNS} SELECT count(*) AS n_runs, CAST(coalesce(sum(fetched), 0) AS BIGINT) AS fetched FROM runs WHERE outcome = 'success'")
def ag12_progress(spark, sf):
    return C.progress(A.runs(spark, sf)[0].filter("outcome = 'success'"))


@query(f"""WITH {A.RUNS}, {_SCOPES} SELECT r.source, CAST(r.run AS VARCHAR) AS run, (SELECT count(*) FROM scopes s WHERE s.source = r.source AND s.run = r.run AND scope < 10) AS attempted,
(SELECT count(*) FROM scopes s WHERE s.source = r.source AND s.run = r.run AND scope < 10 AND completed) AS completed FROM runs r""")
def ag13_scope_counts(spark, sf):
    return C.scope_counts(A.runs(spark, sf)[0], _scopes(spark, sf).filter("scope < 10")).select("source", F.col("run").cast("string").alias("run"), "attempted", "completed")


@query("""WITH s AS (SELECT user_id AS source, CAST(ts AS DATE) AS run, ['read', 'failed', 'truncated', 'gone', 'failed'][event_id % 5 + 1] AS outcome FROM events)
SELECT source, CAST(run AS VARCHAR) AS run, CASE WHEN count(*) FILTER (WHERE outcome <> 'failed') = 0 THEN 'failed' WHEN count(*) FILTER (WHERE outcome IN ('failed', 'truncated')) > 0 THEN 'partial' ELSE 'success' END AS outcome FROM s GROUP BY 1, 2""")
def cp18_rolled_up(spark, sf):
    outcome = F.element_at(F.array(*map(F.lit, ("read", "failed", "truncated", "gone", "failed"))), (F.col("event_id") % 5 + 1).cast("int"))
    s = table(spark, sf, "events").select(F.col("user_id").alias("source"), F.to_date("ts").alias("run"), outcome.alias("outcome"))
    return C.rolled_up(s).withColumn("run", F.col("run").cast("string"))


@query("""SELECT 'late' AS kind, epoch_ms(TIMESTAMP '2024-02-15') - epoch_ms(max(ts)) >= 6 * 3600000 AS due FROM events UNION ALL SELECT 'early', epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(max(ts)) > 600 * CAST(3600000 AS BIGINT) FROM events UNION ALL SELECT 'none', true""")
def st5_due(spark, sf):
    runs = table(spark, sf, "events").select(F.col("ts").alias("started_at"))
    cases = [("late", runs, datetime(2024, 2, 15), 6), ("early", runs, datetime(2024, 1, 31), 600), ("none", runs.limit(0), datetime(2024, 2, 15), 6)]
    out = None
    for name, rows, now, hours in cases:
        one = C.due(rows, now, hours).select(F.lit(name).alias("kind"), "due")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT event_id AS id, event_id % 6 = 0 AS interrupted, strftime(CASE WHEN event_id % 6 = 0 THEN TIMESTAMP '2024-02-15' ELSE ts END, '%Y-%m-%d %H:%M:%S') AS ended FROM events""")
def st5_reconciled(spark, sf):
    k = F.col("event_id")
    runs = table(spark, sf, "events").select(k.alias("id"), F.when(k % 6 != 0, F.col("ts")).alias("ended_at"))
    return C.reconciled(runs, A.NOW).select("id", "interrupted", F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended"))


_REJECTS = "rejects AS (SELECT event_id AS id, event_type AS source, CAST(ts AS DATE) AS run, CASE WHEN event_id % 10 = 0 THEN 'rejected' ELSE 'filtered' END AS kind, 'r' || (user_id % 3) AS reason FROM events)"


def _rejects(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.to_date("ts").alias("run"), F.when(F.col("event_id") % 10 == 0, "rejected").otherwise("filtered").alias("kind"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("reason"))


@query(f"""WITH {_REJECTS}, n AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY run DESC) AS a, row_number() OVER (PARTITION BY source, run, reason ORDER BY id) AS b FROM rejects) SELECT id FROM n WHERE kind = 'rejected' OR a <= 3 OR b <= 2""")
def st9_pruned(spark, sf):
    return C.pruned(_rejects(spark, sf), 3, 2).select("id")


@query(f"""WITH {_REJECTS}, n AS (SELECT *, row_number() OVER (PARTITION BY run, reason ORDER BY id) AS n FROM rejects WHERE kind = 'filtered') SELECT id FROM n WHERE n <= 4 UNION ALL SELECT id FROM rejects WHERE kind = 'rejected'""")
def fl14_sampled_rejects(spark, sf):
    from quillon.operators.quality import sampled_rejects

    rows = _rejects(spark, sf).withColumnsRenamed({"kind": "qc_kind", "reason": "qc_reason"})
    return sampled_rejects(rows, "run", ["id"], 4).select("id")


@query(f"""WITH {A.RUNS}, {_REJECTS}, s AS (SELECT source, run, count(*) FILTER (WHERE kind = 'filtered') AS stored FROM rejects WHERE dayofmonth(run) > 9 GROUP BY 1, 2)
SELECT source, CAST(run AS VARCHAR) AS run, coalesce(stored, 0) AS stored, fetched > 0 AND coalesce(stored, 0) = 0 AS payloads_pruned FROM runs LEFT JOIN s USING (source, run)""")
def cp17_reject_counts(spark, sf):
    runs = A.runs(spark, sf)[0].withColumnRenamed("fetched", "filtered_count")
    return C.reject_counts(runs, _rejects(spark, sf).filter(F.dayofmonth("run") > 9)).select("source", F.col("run").cast("string").alias("run"), "stored", "payloads_pruned")


@query("""WITH s AS (SELECT DISTINCT p_brand AS source, lower(p_name) AS slug FROM part), k AS (SELECT p_brand AS source, lower(p_name) AS slug FROM part WHERE p_partkey % 3 = 0), r AS (SELECT p_brand AS source, lower(p_name) AS slug FROM part WHERE p_partkey % 5 = 0)
SELECT source, array_to_string(list_sort(list(slug)), ';') AS slugs FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source = s.source AND k.slug = s.slug) AND NOT EXISTS (SELECT 1 FROM r WHERE r.source = s.source AND r.slug = s.slug) GROUP BY 1""")
def jn20_unknown_boards(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.lower("p_name").alias("slug"), "p_partkey")
    found = C.unknown_boards(rows, rows.filter("p_partkey % 3 = 0").select("source", "slug"), rows.filter("p_partkey % 5 = 0").select("source", "slug"))
    return found.select("source", F.array_join("slugs", ";").alias("slugs"))


@query("""SELECT source, min(slug) AS slug FROM (SELECT p_brand AS source, p_name AS slug FROM part UNION ALL SELECT p_brand, upper(p_name) FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'x', r_name FROM region) GROUP BY source, lower(slug)""")
def set4_merged_directories(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_name").alias("slug"), "p_partkey")
    region = table(spark, sf, "region").select(F.lit("x").alias("source"), F.col("r_name").alias("slug"))
    return C.merged_directories(p.select("source", "slug"), p.filter("p_partkey % 2 = 0").select("source", F.upper("slug").alias("slug")), region).select("source", "slug")


@query("""WITH a AS (SELECT lower(p_name) AS name, list_sort(list(DISTINCT p_brand)) AS al FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT lower(p_name) AS name, list_sort(list(DISTINCT p_brand)) AS al FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.al, []), coalesce(b.al, [])))), ',') AS aliases, a.name IS NOT NULL AS in_stock FROM a FULL JOIN b ON a.name = b.name""")
def jn11_merged_catalog(spark, sf):
    p = table(spark, sf, "part")
    side = lambda rows: rows.groupBy(F.lower("p_name").alias("name")).agg(F.collect_set("p_brand").alias("aliases"))
    found = C.merged_catalog(side(p.filter("p_partkey % 2 = 0")), side(p.filter("p_partkey % 3 = 0")))
    return found.select("name", F.array_join(F.array_sort("aliases"), ",").alias("aliases"), "in_stock")


@query("""SELECT event_id AS id, coalesce(c_name, 'Unknown recipe') AS name FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id""")
def jn13_named_reviews(spark, sf):
    reviews = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("recipe"))
    catalog = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("recipe"), F.col("c_name").alias("name"))
    return C.named_reviews(reviews, catalog).select("id", "name")


@query("""SELECT lower(p_name) AS name, strftime(max(l_shipdate), '%Y-%m-%d') AS added, arg_max(p_partkey, struct_pack(a := l_shipdate, b := l_orderkey * 10 + l_linenumber)) AS product_id FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def ag14_latest_names(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    stock = rows.select(F.col("p_name").alias("name"), F.col("l_shipdate").alias("added_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("p_partkey").alias("product_id"))
    return C.latest_names(stock).select("name", F.date_format("added_at", "yyyy-MM-dd").alias("added"), "product_id")


@query("""SELECT count(*) AS n, coalesce(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS n_good, coalesce(sum(CASE WHEN toxic IS NOT NULL THEN 1 ELSE 0 END), 0)::BIGINT AS n_judged FROM documents LEFT JOIN labels USING (doc_id)""")
def ag15_labelling_progress(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count("toxic").alias("n_judged"))


@query("""WITH r AS (SELECT CAST(ts AS DATE) AS day, count(*) AS fetched, count(*) FILTER (WHERE event_type = 'view') AS seen, count(*) FILTER (WHERE event_type <> 'view') AS classified, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'signup') AS b, count(*) FILTER (WHERE event_type = 'purchase' OR (event_type = 'error' AND dayofmonth(ts) % 2 = 0)) AS c FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, classified = a + b + c AND fetched = classified + seen AS balanced FROM r""")
def ag23_balanced(spark, sf):
    e, kind = table(spark, sf, "events"), F.col("event_type")
    report = e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(kind == "view").alias("seen"), F.count_if(kind != "view").alias("classified"), F.count_if(kind == "click").alias("a"), F.count_if(kind == "signup").alias("b"),
        F.count_if((kind == "purchase") | ((kind == "error") & (F.dayofmonth("ts") % 2 == 0))).alias("c"),
    )
    return C.balanced(report, ["a", "b", "c"]).select("day", "balanced")


@query("""SELECT p_brand AS company_key, arg_min(p_name, struct_pack(a := length(p_name), b := p_name)) AS name FROM part GROUP BY 1""")
def ag25_display_names(spark, sf):
    return C.display_names(table(spark, sf, "part").select(F.col("p_brand").alias("company_key"), F.col("p_name").alias("company_name")))


@query("""SELECT event_id AS id FROM events WHERE event_id % 3 = 0 OR user_id = 7 OR (event_id % 2 = 0 AND event_id % 5 <> 0)""")
def fl10_visible(spark, sf):
    k = F.col("event_id")
    rows = table(spark, sf, "events").select(k.alias("id"), F.when(k % 3 != 0, F.col("user_id")).alias("owner"), (k % 2 == 0).alias("is_public"), (k % 5 == 0).alias("hidden"))
    return C.visible(rows, 7).select("id")


@query("""SELECT p_partkey AS id FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'blue') OR list_contains(string_split(lower(p_name), ' '), 'red')""")
def fl13_facet(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), " ").alias("tags"))
    return C.facet(rows, "tags", "blue").union(C.facet(rows, "tags", "red")).select("id").distinct()


@query(f"""WITH {A.POSTINGS}, live AS (SELECT * FROM postings WHERE expired_at IS NULL), m AS (SELECT *, row_number() OVER (PARTITION BY company_key, title ORDER BY posted_at DESC, posting_id) AS n FROM live WHERE is_remote IS NULL OR is_remote)
SELECT posting_id, title, (SELECT count(*) FROM live) AS total_live, (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM m WHERE n = 1) AS total_rows FROM m WHERE n = 1 ORDER BY posted_at DESC, posting_id LIMIT 20 OFFSET 20""")
def so2_folded_page(spark, sf):
    live = A.postings(spark, sf, deadlines=False).filter("expired_at IS NULL")
    return L.folded_page(live, F.col("is_remote").isNull() | F.col("is_remote"), ["company_key", "title"], [F.desc("posted_at"), F.col("posting_id")], 20, 20).select("posting_id", "title", "total_live", "matched", "total_rows")


@query("""SELECT event_id AS id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 500""")
def so9_recent(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select(F.col("event_id").alias("id"))


@query("""SELECT lower(p_name) AS name, l_linenumber % 2 AS unit, arg_min(l_orderkey * 10 + l_linenumber, struct_pack(a := l_shipdate, b := l_orderkey * 10 + l_linenumber)) AS row_id, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def sk10_merged_list(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pending = rows.select(F.col("p_name").alias("name"), (F.col("l_linenumber") % 2).alias("unit"), F.col("l_shipdate").alias("added_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("quantity"))
    return C.merged_list(pending)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_name) AS name, c_acctbal < 0 AS in_debt FROM customer")
def sk11_rebuilt(spark, sf):
    return C.rebuilt(table(spark, sf, "customer"), {"id": "cast(c_custkey AS string)", "name": "upper(c_name)", "in_debt": "c_acctbal < 0"})


@query("""SELECT o_orderkey AS id, epoch_us(coalesce(e.ts, o_orderdate)) // 1000 AS applied_ms FROM orders LEFT JOIN events e ON e.event_id = CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 2 END""")
def sk13_dated_from_mail(spark, sf):
    k = F.col("o_orderkey")
    apps = table(spark, sf, "orders").select(k.alias("id"), F.col("o_orderdate").alias("applied_at"), F.when(k % 3 != 0, F.to_json(F.struct((k * 2).alias("verdict_id")))).otherwise("{}").alias("snapshot_json"))
    mail = table(spark, sf, "events").select(F.col("event_id").alias("verdict_id"), F.col("ts").alias("received_at"))
    return C.dated_from_mail(apps, mail).select("id", F.unix_millis(F.col("applied_at").cast("timestamp")).alias("applied_ms"))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 99 ELSE user_id END AS owner FROM events")
def cp25_owned(spark, sf):
    return C.owned(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("owner")), 99)


@query("""WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '  ' ELSE '  ' || c_name || ' ' END AS city, CASE WHEN c_custkey % 7 = 0 THEN repeat('x', 50) ELSE c_mktsegment END AS note FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 <> 0 THEN nullif(trim(city), '') ELSE 'old' END AS city, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 7 <> 0 THEN note ELSE 'old note' END AS note FROM customer LEFT JOIN n ON n.id = c_custkey""")
def cp21_profile_upsert(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    old = c.select(k.alias("id"), F.lit("old").alias("city"), F.lit("old note").alias("note"))
    new = c.filter(k % 2 == 0).select(k.alias("id"), F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("city"), F.when(k % 7 == 0, "x" * 50).otherwise(F.col("c_mktsegment")).alias("note"))
    return C.profile_upsert(old, new, "id", {"city": 40, "note": 40})


@query("""SELECT p_brand AS folder, sha256(array_to_string(list_sort(list(sha256(p_name || '|' || p_partkey || '|' || p_size))), ',')) AS fingerprint FROM part GROUP BY 1""")
def cp24_fingerprint(spark, sf):
    return C.fingerprint(table(spark, sf, "part").select(F.col("p_brand").alias("folder"), F.col("p_name").alias("name"), F.col("p_partkey").alias("mtime"), F.col("p_size").alias("size")))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END AS text, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS old_text FROM part""")
def cp19_answers(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    edits = a.filter("id % 3 <> 1").withColumn("text", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    now, revisions = C.answers_after(a, edits)
    return now.join(revisions, "id", "left").select("id", "text", "old_text")


@query(f"""WITH {A.POSTINGS} SELECT posting_id, CASE company_key WHEN 'co-1' THEN 1 ELSE 2 END AS tier FROM postings WHERE company_key IN ('co-1', 'co-2', 'co-5') AND posting_id % 4 <> 0""")
def cp5_tier_alerts(spark, sf):
    p = A.postings(spark, sf, deadlines=False)
    return C.tier_alerts(p.select("posting_id", "company_key"), A.tiers(spark), p.filter("posting_id % 4 = 0")).select("posting_id", "tier")


@query("""SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(p_name), 'blue|navy') THEN 'cool' END, CASE WHEN regexp_matches(lower(p_name), 'red|orange') THEN 'warm' END, CASE WHEN regexp_matches(lower(p_name), 'steel|tin') THEN 'metal' END], lambda x: x IS NOT NULL), ',') AS tags FROM part""")
def pj13_tags(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(H.tags(F.col("p_name"), {"cool": "blue|navy", "warm": "red|orange", "metal": "steel|tin"}), ",").alias("tags"))


@query(f"""WITH {A.POSTINGS}, t AS (SELECT posting_id, title || ' ' || repeat('x', CASE WHEN posting_id % 10 = 0 THEN 140 ELSE 0 END) AS title, season, term_year, location, region FROM postings),
b AS (SELECT posting_id, concat_ws(' · ', title, nullif(concat_ws(' ', upper(substr(season, 1, 1)) || substr(season, 2), term_year), ''), CASE WHEN location IS NOT NULL THEN location || ' +1 more' END) AS body FROM t)
SELECT posting_id, CASE WHEN length(body) > 140 THEN substr(body, 1, 139) || '…' ELSE body END AS body FROM b""")
def pj15_alert_body(spark, sf):
    p = A.postings(spark, sf, deadlines=False)
    title = F.concat("title", F.lit(" "), F.when(F.col("posting_id") % 10 == 0, "x" * 140).otherwise(""))
    return p.select("posting_id", H.alert_body(title, F.col("season"), F.col("term_year"), F.array_compact(F.array("location", "region"))).alias("body"))


@query("""SELECT o_orderkey AS id, lower(hex(encode(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '|' || o_orderkey))) AS cursor, CAST(o_orderkey AS VARCHAR) AS key FROM orders""")
def pj17_cursor(spark, sf):
    at = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), H.cursor(at, F.col("o_orderkey")).alias("cursor"))
    return rows.withColumn("key", H.cursor_parts(F.col("cursor"))["key"])


@query("""WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(ceil((epoch_ms(l_shipdate) - epoch_ms(TIMESTAMP '1998-06-01 06:00:00')) / 86400000.0) AS BIGINT) AS n, l_quantity AS q FROM lineitem)
SELECT id, n AS days_left, CASE WHEN n < 0 THEN 'expired' WHEN n <= 2 THEN 'urgent' WHEN n <= 5 THEN 'soon' ELSE 'fresh' END AS badge, CASE WHEN q % 5 = 0 THEN 0.0 ELSE round(q * 100 / 50, 1) END AS share FROM d""")
def pj19_badges(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), H.days_left(F.col("l_shipdate"), F.lit("1998-06-01 06:00:00").cast("timestamp_ntz")).alias("days_left"), "l_quantity")
    return rows.select("id", "days_left", H.badge(F.col("days_left")).alias("badge"), H.share(F.col("l_quantity"), F.when(F.col("l_quantity") % 5 == 0, F.lit(0.0)).otherwise(F.lit(50.0))).alias("share"))


@query("""WITH m AS (SELECT event_id AS id, ['oa', 'interview', 'offer', 'rejection'][event_id % 4 + 1] AS c, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'Co ' || user_id END AS who, CASE WHEN event_id % 5 <> 0 THEN 'u' || user_id END AS sender FROM events)
SELECT id, CASE c WHEN 'oa' THEN 'Assessment' WHEN 'interview' THEN 'Interview' WHEN 'offer' THEN 'Offer' END || ' — ' || coalesce(nullif(trim(who), ''), sender, 'unknown sender') AS alert FROM m""")
def pj20_mail_alert(spark, sf):
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    c = F.element_at(F.array(*map(F.lit, ("oa", "interview", "offer", "rejection"))), (k % 4 + 1).cast("int"))
    who = F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("Co "), u))
    return table(spark, sf, "events").select(k.alias("id"), H.mail_alert(c, who, F.when(k % 5 != 0, F.concat(F.lit("u"), u))).alias("alert"))


_KEY = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(rf"""WITH q AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Why do you WANT to work -- here?' WHEN 1 THEN 'Tell us of ' || p_name WHEN 2 THEN 'What of ' || p_brand || '?' ELSE p_name END AS question, CASE WHEN p_partkey % 5 = 0 THEN 'I like ' || p_brand ELSE p_type END AS answer, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS company FROM part),
k AS (SELECT id, {_KEY.format(c='question')} AS q, {_KEY.format(c='answer')} AS a, {_KEY.format(c='company')} AS n FROM q)
SELECT id, q AS question, regexp_matches(q, '{'|'.join(H.COMPANY_QUESTION)}') OR coalesce(n <> '' AND (contains(q, n) OR contains(a, n)), false) AS company_specific FROM k""")
def tx15_questions(spark, sf):
    k = F.col("p_partkey")
    question = F.when(k % 4 == 0, "Why do you WANT to work -- here?").when(k % 4 == 1, F.concat(F.lit("Tell us of "), "p_name")).when(k % 4 == 2, F.concat(F.lit("What of "), "p_brand", F.lit("?"))).otherwise(F.col("p_name"))
    answer = F.when(k % 5 == 0, F.concat(F.lit("I like "), "p_brand")).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select(k.alias("id"), H.question_key(question).alias("question"), H.company_specific(question, answer, F.when(k % 7 != 0, F.col("p_brand"))).alias("company_specific"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN lower(p_name) WHEN 1 THEN lower(p_name) WHEN 2 THEN lower(p_name) || ' job' ELSE lower(p_name) || ' 2026' END AS key FROM part""")
def tx17_role_key(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, F.concat(F.lit(" (Job number: 2000"), F.lpad(k.cast("string"), 6, "0"), F.lit(")"))).when(k % 4 == 1, ", 277192").when(k % 4 == 2, " Job").otherwise(" 2026")
    return table(spark, sf, "part").select(k.alias("id"), H.role_key(F.concat("p_name", tail)).alias("key"))


@query(r"""WITH h AS (SELECT p_partkey AS id, p_partkey % 6 AS kind, p_name FROM part)
SELECT id, CASE kind WHEN 0 THEN p_name || ' & Sons' WHEN 1 THEN p_name || '&lt;' WHEN 2 THEN '''' || p_name || '''' WHEN 3 THEN p_name || '&nope;é' WHEN 4 THEN 'A&B ' || p_name ELSE p_name || '&#xD800;' END AS text FROM h""")
def tx3_entities(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_name")
    text = (
        F.when(k % 6 == 0, F.concat(n, F.lit(" &amp; Sons"))).when(k % 6 == 1, F.concat(n, F.lit("&amp;lt;"))).when(k % 6 == 2, F.concat(F.lit("&#39;"), n, F.lit("&rsquo;")))
        .when(k % 6 == 3, F.concat(n, F.lit("&nope;&#xe9;"))).when(k % 6 == 4, F.concat(F.lit("A&B "), n)).otherwise(F.concat(n, F.lit("&#xD800;")))
    )
    return table(spark, sf, "part").select(k.alias("id"), X.decode_entities(text).alias("text"))


@query("""WITH q AS (SELECT DISTINCT lower(p_name) AS question FROM part), a AS (SELECT question, row_number() OVER (ORDER BY question) % 3 = 0 AS specific, 'co-' || (row_number() OVER (ORDER BY question) % 2) AS company FROM q),
s AS (SELECT question, 1 - damerau_levenshtein('blue steel', question) / CAST(greatest(length('blue steel'), length(question)) AS DOUBLE) AS score FROM a WHERE NOT specific OR company = 'co-1')
SELECT question, round(score, 6) AS score FROM s WHERE score >= 0.45 ORDER BY score DESC, question LIMIT 10""")
def jn15_answers(spark, sf):
    from pyspark.sql import Window as W

    q = table(spark, sf, "part").select(F.lower("p_name").alias("question")).distinct()
    n = F.row_number().over(W.orderBy("question"))  # a fixture of 64 names
    answers = q.select("question", (n % 3 == 0).alias("specific"), F.concat(F.lit("co-"), (n % 2).cast("string")).alias("company"))
    return M.similar_answers(answers, "Blue  steel", "co-1").select("question", F.round("score", 6).alias("score"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size * 30.0 WHEN p_partkey % 3 = 1 THEN p_size / 24.0 ELSE 7.0 END AS shelf_days FROM part""")
def pj12_shelf_life(spark, sf):
    from quillon.operators.recommend import STORAGE, shelf_life

    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("id"), "p_size", F.when(k % 3 == 0, F.col("p_size").cast("double")).alias("refrigerate_max"), F.when(k % 3 == 0, "Months").alias("refrigerate_metric"), F.when(k % 3 < 2, F.col("p_size").cast("double")).alias("pantry_max"), F.when(k % 3 < 2, "Hours").alias("pantry_metric"))
    for s in STORAGE:
        if f"{s}_max" not in rows.columns:
            rows = rows.withColumns({f"{s}_max": F.lit(None).cast("double"), f"{s}_metric": F.lit(None).cast("string")})
    return shelf_life(rows).select("id", "shelf_days")


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'acme' WHEN 1 THEN 'jump trading' ELSE lower(p_name) END AS key FROM part""")
def tx6_company_alias(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "ACME Industries, Inc.").when(k % 3 == 1, "Jump Trading Group LLC").otherwise(F.concat("p_name", F.lit(" Ltd")))
    return table(spark, sf, "part").select(k.alias("id"), X.company_key(name, {"acme industries": "acme", "jump trading group": "jump trading"}).alias("key"))
