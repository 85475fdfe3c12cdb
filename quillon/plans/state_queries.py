"""Merges, syncs, expiry, sets, stock and recipes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillon.operators import events as E
from quillon.operators import expiry as X
from quillon.operators import matching as M
from quillon.operators import merge as G
from quillon.operators import recommend as R
from quillon.plans import adapters as A
from quillon.plans.registry import query
from quillon.session import table
from quillon.streaming import jobs


@query("""SELECT coalesce(b.id, a.id) AS id, coalesce(b.price, a.price) AS price, CASE WHEN b.id IS NOT NULL THEN b.status ELSE a.status END AS status, b.id IS NOT NULL AND a.id IS NULL AS created
FROM (SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0) a
FULL JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN 'N' END AS status FROM orders WHERE o_orderkey % 4 <> 1) b ON a.id = b.id""")
def sk1_upsert(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    old = o.filter(k % 3 != 0).select(k.alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    new = o.filter(k % 4 != 1).select(k.alias("id"), F.when(k % 2 == 0, F.col("o_totalprice") * 2).alias("price"), F.when(k % 5 != 0, F.lit("N")).alias("status"))
    return G.upsert(old, new, "id", ["price"], ["status"])


@query("""WITH a AS (SELECT o_orderkey AS k, 'T' || o_orderkey AS title, CASE WHEN o_orderkey % 5 <> 0 THEN 'Old ' || o_custkey END AS company, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS posted, o_orderkey % 6 = 0 AS est, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS expired FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN 'N' || o_orderkey END AS title, CASE WHEN o_orderkey % 8 = 1 THEN '42' WHEN o_orderkey % 8 <> 2 THEN 'New ' || o_custkey END AS company, CASE WHEN o_orderkey % 9 < 4 THEN o_orderdate + INTERVAL 1 DAY END AS posted, o_orderkey % 10 = 3 AS slug FROM orders WHERE o_orderkey % 4 <> 1)
SELECT coalesce(b.k, a.k) AS dedup_key, CASE WHEN b.k IS NOT NULL THEN b.title ELSE a.title END AS title, CASE WHEN a.k IS NOT NULL AND (b.k IS NULL OR slug OR b.company IS NULL OR b.company = '42') THEN coalesce(a.company, b.company) ELSE coalesce(b.company, a.company) END AS company_name,
strftime(coalesce(b.posted, a.posted, TIMESTAMP '2002-01-01'), '%Y-%m-%d') AS posted, CASE WHEN b.posted IS NOT NULL THEN false WHEN a.posted IS NOT NULL THEN a.est ELSE true END AS posted_estimated, CASE WHEN b.k IS NULL THEN strftime(a.expired, '%Y-%m-%d') END AS expired, b.k IS NOT NULL AND a.k IS NULL AS created FROM a FULL JOIN b ON a.k = b.k""")
def sk1_postings(spark, sf):
    """Names of slug sources, estimated dates and postings that come back (ST-12)."""
    o, k, at = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    named = lambda x: F.concat(F.lit(x), F.col("o_custkey").cast("string"))
    old = o.filter(k % 3 != 0).select(k.alias("dedup_key"), F.concat(F.lit("T"), k.cast("string")).alias("title"), F.lit("u").alias("url"), F.when(k % 5 != 0, named("Old ")).alias("company_name"), F.when(k % 4 != 0, at).alias("posted_at"), (k % 6 == 0).alias("posted_estimated"), F.when(k % 7 == 0, at).alias("expired_at"))
    new = o.filter(k % 4 != 1).select(
        k.alias("dedup_key"), F.when(k % 11 != 0, F.concat(F.lit("N"), k.cast("string"))).alias("title"), F.lit("v").alias("url"), F.when(k % 8 == 1, "42").when(k % 8 != 2, named("New ")).alias("company_name"),
        F.when(k % 9 < 4, at + F.expr("INTERVAL 1 DAY")).alias("posted_at"), F.when(k % 10 == 3, "slugs").otherwise("lists").alias("source"),
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    merged = G.upsert_postings(old, new, E.at_literal(datetime(2002, 1, 1)), ["slugs"])
    return merged.select("dedup_key", "title", "company_name", day("posted_at").alias("posted"), "posted_estimated", day("expired_at").alias("expired"), "created")


@query("""WITH e AS (SELECT c_custkey AS id, c_custkey % 4 AS rank FROM customer), m AS (SELECT a.id AS loser, a.id - 1 AS keeper FROM e a JOIN e b ON b.id = a.id - 1 WHERE a.id % 10 = 3 AND a.rank <= b.rank OR a.id % 10 = 7 AND a.rank <= b.rank)
SELECT 'child' AS kind, coalesce(keeper, o_custkey) AS id, count(*) AS n FROM orders LEFT JOIN m ON loser = o_custkey GROUP BY 1, 2 UNION ALL SELECT 'history', user_id, count(*) FROM events WHERE user_id NOT IN (SELECT loser FROM m) GROUP BY 1, 2 UNION ALL SELECT 'entity', id, 1 FROM e WHERE id NOT IN (SELECT loser FROM m)""")
def sk12_merge_entities(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("rank"))
    mapping = e.filter("id % 10 IN (3, 7)").select(F.col("id").alias("loser"), (F.col("id") - 1).alias("keeper"))
    children, history, left = G.merge_entities(table(spark, sf, "orders").select(F.col("o_custkey").alias("owner")), table(spark, sf, "events").select(F.col("user_id").alias("owner")), e, mapping, "owner")
    count = lambda rows, kind, c: rows.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return count(children, "child", "owner").unionByName(count(history, "history", "owner")).unionByName(count(left, "entity", "id"))


@query(f"""WITH {A.RUNS}, s AS (SELECT event_type AS source, user_id AS external_id, max(struct_pack(run := CAST(ts AS DATE), scope := CASE WHEN event_id % 4 <> 0 THEN event_id % 5 ELSE -1 END)) AS s FROM events GROUP BY 1, 2),
done AS (SELECT DISTINCT event_type AS source, CAST(ts AS DATE) AS run, event_id % 5 AS scope FROM events WHERE event_id % 3 = 0)
SELECT s.source, s.external_id, nullif(s.s.scope, -1) AS scope, misses + (SELECT count(DISTINCT d.run) FROM done d JOIN judged j ON j.source = d.source AND j.run = d.run WHERE j.eligible = 'not_successful' AND d.source = s.source AND d.scope = s.s.scope AND d.run > s.s.run) AS misses FROM s JOIN missed m ON m.source = s.source AND m.external_id = s.external_id""")
def st2_scoped_misses(spark, sf):
    """With ST-1's completed scopes of runs that did not succeed."""
    runs, _ = A.runs(spark, sf)
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("run"), F.col("user_id").alias("external_id"), "event_id")
    seen = e.withColumn("scope", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 5))
    completed = e.filter("event_id % 3 = 0").select("source", "run", (F.col("event_id") % 5).alias("scope"))
    return X.scoped_misses(seen, X.eligibility(runs), completed)


@query("""WITH r AS (SELECT user_id AS recipe, 1 + CAST(floor(value) AS INTEGER) % 5 AS rating, ts FROM events WHERE value IS NOT NULL),
l AS (SELECT recipe, greatest(0.0, max((rating - 3.0) * power(0.5, (epoch_ms(TIMESTAMP '2024-02-15') - epoch_ms(ts)) / 86400000.0 / 120.0))) AS score FROM r GROUP BY 1 HAVING avg(rating) >= 2.9),
k AS (SELECT recipe, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, recipe) - 1 AS rk FROM l),
chosen AS (SELECT recipe, [3, 5, 7][n] AS position FROM (SELECT recipe, row_number() OVER (ORDER BY sha256('day|' || recipe), recipe) AS n FROM k WHERE recipe % 2 = 0 AND rk >= 3) WHERE n <= 3),
rest AS (SELECT recipe, row_number() OVER (ORDER BY rk) AS n FROM k WHERE recipe NOT IN (SELECT recipe FROM chosen)), placed AS (SELECT recipe, position FROM chosen UNION ALL SELECT recipe, [0, 1, 2, 4, 6][n] FROM rest WHERE n <= 5)
SELECT k.recipe, score, CAST(position AS BIGINT) AS position FROM k LEFT JOIN placed USING (recipe)""")
def cp3_liked_rerank(spark, sf):
    rows = table(spark, sf, "events").filter("value IS NOT NULL").select(F.col("user_id").alias("recipe"), (1 + F.floor("value").cast("int") % 5).alias("rating"), F.col("ts").alias("cooked_at"))
    liked = R.liked(rows, A.NOW, least_mean=2.9).select("recipe", F.round("score", 6).alias("score"))
    return R.interleave(liked, [F.desc("score"), F.col("recipe")], liked.filter("recipe % 2 = 0"), "recipe", "day")


@query("""WITH fresh AS (SELECT user_id, event_type, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03'), old AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-03'),
k AS (SELECT CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id, event_type, event_id FROM fresh), n AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = k.user_id AND o.event_type = k.event_type))
SELECT * FROM n WHERE user_id IS NULL UNION ALL SELECT user_id, event_type, min(event_id) FROM n WHERE user_id IS NOT NULL GROUP BY 1, 2""")
def sk3_insert_absent(spark, sf):
    ev = table(spark, sf, "events")
    fresh = ev.filter("ts >= TIMESTAMP_NTZ '2024-01-03'").select(F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("user_id"), "event_type", "event_id")
    return E.insert_absent(ev.filter("ts < TIMESTAMP_NTZ '2024-01-03'").select("user_id", "event_type"), fresh, ["user_id", "event_type"], ["event_id"])


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) LEFT JOIN (SELECT c_custkey, c_custkey % 4 AS have FROM customer) ON o_custkey = c_custkey WHERE n + coalesce(have, 0) <= 5""")
def sk5_quota(spark, sf):
    have = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 4).alias("n"))
    return G.quota(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", [F.col("o_orderkey")], 5, have)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_name || '!' ELSE p_name END AS name FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0")
def sk6_changed(spark, sf):
    old = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    new = old.withColumn("name", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return G.changed(old, new, "id", ["name"])


@query("""WITH t AS (SELECT p_partkey AS slug, p_name AS title, p_partkey % 6 <> 0 AS managed FROM part WHERE p_partkey % 4 <> 0), f AS (SELECT p_partkey AS slug, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || '*' END AS title, p_partkey % 11 <> 0 AS parsed FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(f.slug, t.slug) AS slug, CASE WHEN f.slug IS NOT NULL AND NOT parsed THEN 'rejected' WHEN f.slug IS NOT NULL AND t.slug IS NOT NULL AND NOT managed THEN 'skipped' WHEN f.slug IS NOT NULL AND t.slug IS NULL THEN 'created'
 WHEN f.slug IS NOT NULL AND f.title IS NOT DISTINCT FROM t.title THEN 'unchanged' WHEN f.slug IS NOT NULL THEN 'updated' WHEN managed THEN 'deleted' ELSE 'kept' END AS action FROM t FULL JOIN f ON t.slug = f.slug""")
def sk7_sync(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    have = p.filter(k % 4 != 0).select(k.alias("slug"), F.col("p_name").alias("title"), (k % 6 != 0).alias("managed"))
    files = p.filter(k % 5 != 0).select(k.alias("slug"), F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("*"))).alias("title"), (k % 11 != 0).alias("parsed"), k.alias("path"))
    return G.sync(have, files, "slug", ["title"], ["path"])


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END AS owner FROM orders")
def sk12_entity_merge(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey % 10 = 3")
    mapping = c.select(F.col("c_custkey").alias("loser"), (F.col("c_custkey") - 1).alias("keeper"))
    return G.repoint(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner")), "owner", mapping)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def sk15_retention(spark, sf):
    return G.newest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query(f"WITH {A.RUNS} SELECT source, CAST(run AS VARCHAR) AS run, outcome, CAST(fetched AS BIGINT) AS fetched, eligible FROM judged")
def st1_eligibility(spark, sf):
    runs, _ = A.runs(spark, sf)
    return X.eligibility(runs).select("source", F.col("run").cast("string").alias("run"), "outcome", "fetched", "eligible")


def _missed(spark, sf):
    runs, seen = A.runs(spark, sf)
    return X.misses(seen, X.eligibility(runs))


@query(f"WITH {A.RUNS} SELECT source, external_id, CAST(last_run AS VARCHAR) AS last_run, misses FROM missed")
def st2_misses(spark, sf):
    return _missed(spark, sf).withColumn("last_run", F.col("last_run").cast("string"))


_SWEEP = """post AS (SELECT c_custkey AS posting_id, CASE WHEN c_custkey % 9 = 0 THEN TIMESTAMP '2024-01-10' END AS deadline, CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP '2024-01-01' END AS expired_at FROM customer),
counted AS (SELECT external_id AS posting_id, source, external_id, misses FROM missed)"""


def _post(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("posting_id"), F.when(k % 9 == 0, F.lit("2024-01-10").cast("timestamp_ntz")).alias("deadline"), F.when(k % 13 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("expired_at"))


@query(f"""WITH {A.RUNS}, {_SWEEP}, g AS (SELECT posting_id, min(misses) >= 2 AS vanished FROM counted GROUP BY 1), r AS (SELECT posting_id, CASE WHEN deadline < TIMESTAMP '2024-02-15' THEN 'deadline_passed' WHEN vanished THEN 'vanished_from_sources' END AS expiry_reason FROM post LEFT JOIN g USING (posting_id) WHERE expired_at IS NULL)
SELECT * FROM r WHERE expiry_reason IS NOT NULL""")
def st3_sweep(spark, sf):
    counted = _missed(spark, sf).withColumn("posting_id", F.col("external_id"))
    return X.sweep(_post(spark, sf), counted, E.at_literal(A.NOW), 2)


@query(f"""WITH {A.RUNS}, {_SWEEP}, said AS (SELECT posting_id, source FROM counted WHERE external_id % 3 = 0 AND source = 'click')
SELECT DISTINCT posting_id FROM said s WHERE posting_id IN (SELECT posting_id FROM post WHERE expired_at IS NULL) AND NOT EXISTS (SELECT 1 FROM counted c WHERE c.posting_id = s.posting_id AND c.source <> s.source AND c.misses = 0)""")
def st4_closed(spark, sf):
    counted = _missed(spark, sf).withColumn("posting_id", F.col("external_id"))
    closures = counted.filter("external_id % 3 = 0 AND source = 'click'").select("source", "external_id")
    return X.closed(_post(spark, sf), closures, counted)


@query("""SELECT source, scope FROM (SELECT event_type AS source, user_id AS scope, value < 40 AS gone, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value IS NOT NULL) WHERE n <= 3 GROUP BY 1, 2 HAVING count(*) = 3 AND count(*) FILTER (WHERE gone) = 3""")
def ag10_retired(spark, sf):
    v = table(spark, sf, "events").filter("value IS NOT NULL").select(F.col("event_type").alias("source"), F.col("user_id").alias("scope"), (F.col("value") < 40).alias("gone"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return X.retired(v, 3)


@query("""WITH r AS (SELECT user_id AS source, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'failed' ELSE 'success' END AS outcome FROM events),
o AS (SELECT source, max(ts) AS last_run, arg_max(outcome, struct_pack(a := ts, b := event_id)) AS last_outcome, max(ts) FILTER (WHERE outcome = 'success') AS last_success FROM r GROUP BY 1)
SELECT o.source, last_outcome, epoch_us(last_run) // 1000 AS last_run_ms, epoch_us(last_success) // 1000 AS last_success_ms, (SELECT count(*) FROM r WHERE r.source = o.source AND outcome <> 'success' AND (o.last_success IS NULL OR ts > o.last_success)) AS failures FROM o""")
def ag9_source_health(spark, sf):
    r = table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.when(F.col("event_type").isin("view", "click"), "failed").otherwise("success").alias("outcome"))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).alias(f"{c}_ms")
    return X.source_health(r).select("source", "last_outcome", ms("last_run"), ms("last_success"), "failures")


@query("""WITH g AS (SELECT o_custkey, o_orderdate, (epoch_ms(o_orderdate) - epoch_ms(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate))) / 86400000.0 AS gap FROM orders),
l AS (SELECT o_custkey, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps FROM g GROUP BY 1)
SELECT o_custkey, round(gaps[len(gaps) // 2 + 1], 6) AS median_gap, len(gaps) AS n_gaps FROM l WHERE len(gaps) > 0""")
def ag8_purchase_gaps(spark, sf):
    gaps = R.purchase_gaps(table(spark, sf, "orders").select("o_custkey", "o_orderdate"), "o_custkey", "o_orderdate")
    return gaps.select("o_custkey", F.round("median_gap", 6).alias("median_gap"), "n_gaps")


@query("""WITH stock AS (SELECT c_custkey AS item, TIMESTAMP '2001-01-01' + to_days(CAST(c_custkey % 40 AS INTEGER)) AS expires FROM customer WHERE c_custkey % 3 = 0),
g AS (SELECT o_custkey AS item, o_orderdate, (epoch_ms(o_orderdate) - epoch_ms(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate))) / 86400000.0 AS gap FROM orders),
l AS (SELECT item, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps, max(o_orderdate) AS last_at FROM g GROUP BY 1)
SELECT item, 'expiring_replacement' AS reason FROM stock WHERE expires < TIMESTAMP '2001-01-18' UNION ALL
SELECT item, 'frequently_purchased' FROM l WHERE len(gaps) > 0 AND gaps[len(gaps) // 2 + 1] < (epoch_ms(TIMESTAMP '2001-01-15') - epoch_ms(last_at)) / 86400000.0 AND item NOT IN (SELECT item FROM stock)""")
def cp1_shopping_suggestions(spark, sf):
    stock = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("item"), (F.lit("2001-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 40).cast("int"))).alias("expires"))
    history = table(spark, sf, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderdate").alias("at"))
    return R.shopping_suggestions(stock, history, "item", "expires", "at", datetime(2001, 1, 15))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS recipe, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey), h AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_partkey % 3 = 0),
c AS (SELECT recipe, count(*) AS total, count(h.name) AS matched FROM i LEFT JOIN h ON lower(i.name) = h.name WHERE recipe % 7 <> 0 GROUP BY 1)
SELECT recipe, total, matched, total - matched AS missing FROM c ORDER BY total < 2, missing, total DESC, recipe LIMIT 60""")
def cp2_recipes(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recipe"), "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select("recipe", F.col("p_name").alias("name")).distinct()
    have = part.filter("p_partkey % 3 = 0").select(F.col("p_name").alias("name"))
    gone = table(spark, sf, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("recipe"))
    return R.recipe_matches(i, have, gone).orderBy(*R.recipe_order()).limit(60)


@query("""SELECT DISTINCT name FROM (SELECT lower(n_name) AS name FROM nation UNION SELECT lower(r_name) FROM region)""")
def set1_union(spark, sf):
    return table(spark, sf, "nation").select(F.lower("n_name").alias("name")).union(table(spark, sf, "region").select(F.lower("r_name"))).distinct()


@query("SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0) AND c_custkey % 5 <> 0")
def set3_difference(spark, sf):
    seen = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).distinct()
    known = table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("id"))
    return seen.join(known, "id", "left_anti").join(seen.filter("id % 5 = 0"), "id", "left_anti")


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) <= 7200000""")
def jn18_tolerance(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    a = ev.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("at_a"))
    b = ev.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("at_b"))
    return M.within(a, b, ["user_id"], "at_a", "at_b", 7200).select("a", "b")


@query("""WITH n AS (SELECT DISTINCT replace(lower(p_name), ' ', '') AS k FROM part), s AS (SELECT DISTINCT k || 'group' AS a FROM n UNION SELECT k FROM n WHERE length(k) % 2 = 0)
SELECT a, arg_max(k, length(k)) AS k FROM s JOIN n ON starts_with(a, k) AND length(k) >= 6 GROUP BY 1""")
def jn19_prefix(spark, sf):
    n = table(spark, sf, "part").select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")).alias("k")).distinct()
    s = n.select(F.concat("k", F.lit("group")).alias("a")).union(n.filter("length(k) % 2 = 0")).distinct()
    return M.prefix_match(s, "a", n, "k")


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def ext_windowed_counts(spark, sf):
    """An extension on the event table: tumbling windows."""
    w = jobs.windowed_counts(table(spark, sf, "events"), "ts", "6 hours")
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH").alias("bucket"), "n", F.round("total", 4).alias("total"))


@query()
def st8_limiter(spark, sf):
    hits = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.limited_batch(hits, 3, 6 * 3600.0)


@query()
def sk9_merge_stock(spark, sf):
    """Folded per item in order; the lots depend on the order, which SQL cannot express."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("expires_at"), F.col("l_shipdate").alias("added_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return R.merge_stock(rows, ["item"])


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS received, CAST(o_orderkey % 27 + 1 AS INTEGER) AS d, CAST(o_orderkey % 12 + 1 AS INTEGER) AS m, o_orderkey % 5 AS kind FROM orders)
SELECT id, strftime(CASE kind WHEN 0 THEN received + to_days(d) WHEN 1 THEN received + to_hours(d)
 WHEN 2 THEN CASE WHEN make_date(year(received), m, d) >= CAST(received AS DATE) THEN make_date(year(received), m, d) ELSE make_date(year(received) + 1, m, d) END
 WHEN 3 THEN make_date(year(received) + 1, m, d) END, '%Y-%m-%d %H:%M') AS deadline FROM o WHERE kind < 4""")
def dt4_deadlines(spark, sf):
    """Messages made of orders: days, hours, a month's name without a year, a numeric date, and one without a cue."""
    from quillon.functions.parse import deadline

    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    d, m, kind = (k % 27 + 1).cast("string"), (k % 12 + 1).cast("int"), k % 5
    month = F.element_at(F.array(*[F.lit(x) for x in "January February March April May June July August September October November December".split()]), m)
    text = (
        F.when(kind == 0, F.concat(F.lit("Please complete it within "), d, F.lit(" days.")))
        .when(kind == 1, F.concat(F.lit("The link expires within "), d, F.lit(" hours")))
        .when(kind == 2, F.concat(F.lit("It is due by "), month, F.lit(" "), d, F.lit(".")))
        .when(kind == 3, F.concat(F.lit("Submit before "), m.cast("string"), F.lit("/"), d, F.lit("/"), (F.year("o_orderdate") + 1).cast("string")))
        .otherwise(F.concat(F.lit("We met on "), m.cast("string"), F.lit("/"), d))
    )
    found = o.select(k.alias("id"), deadline(text, F.col("o_orderdate")).alias("deadline")).filter("deadline IS NOT NULL")
    return found.select("id", F.date_format("deadline", "yyyy-MM-dd HH:mm").alias("deadline"))


@query("""WITH r AS (SELECT p_partkey AS recipe, p_retailprice AS score, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rk FROM part),
chosen AS (SELECT recipe, [3, 5, 7][n] AS position FROM (SELECT recipe, row_number() OVER (ORDER BY sha256('2024-02-15|' || recipe), recipe) AS n FROM r WHERE recipe % 9 = 0 AND rk >= 3) WHERE n <= 3),
rest AS (SELECT recipe, row_number() OVER (ORDER BY rk) AS n FROM r WHERE recipe NOT IN (SELECT recipe FROM chosen)),
placed AS (SELECT recipe, position FROM chosen UNION ALL SELECT recipe, [0, 1, 2, 4, 6][n] FROM rest WHERE n <= 5)
SELECT r.recipe, score, CAST(position AS BIGINT) AS position FROM r LEFT JOIN placed USING (recipe)""")
def so6_interleave(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("recipe"), F.col("p_retailprice").alias("score"))
    return R.interleave(rows, [F.desc("score"), F.col("recipe")], rows.filter("recipe % 9 = 0"), "recipe", "2024-02-15")
