"""Cohorts, ranking, signals, filters and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import score as S
from quillon.functions import shown
from quillon.operators import events as E
from quillon.operators import listing as L
from quillon.operators import quality
from quillon.operators import recommend as R
from quillon.plans import adapters as A
from quillon.plans.registry import query
from quillon.session import table


def _apps(spark, sf):
    return E.applications(A.status_events(spark, sf), ["user_id", "day"])


@query(f"WITH {A.APPLICATIONS} SELECT {A.COHORT} FROM apps")
def ag5_cohort_totals(spark, sf):
    return E.cohort(_apps(spark, sf), A.NOW, 30)


@query(f"""WITH {A.APPLICATIONS}, labelled AS (SELECT *, strftime(applied_at, '%Y-%m') AS month, CASE WHEN user_id % 4 = 0 THEN '' ELSE CAST(user_id % 4 AS VARCHAR) END AS variant,
 CASE WHEN user_id % 3 = 0 THEN 'unknown' ELSE 's' || (user_id % 3) END AS source, CASE WHEN user_id % 5 < 3 THEN 't' || (user_id % 5 + 1) ELSE 'untiered' END AS tier FROM apps)
SELECT CASE WHEN grouping(month) = 0 THEN 'month' WHEN grouping(variant) = 0 THEN 'variant' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'all' END AS kind, coalesce(month, variant, source, tier, '') AS of, {A.COHORT}
FROM labelled GROUP BY GROUPING SETS ((), (month), (variant), (source), (tier))""")
def ag6_cohort_groups(spark, sf):
    """By month, variant (none as ''), source (blank as unknown) and tier, in one pass."""
    u, by = F.col("user_id"), ["month", "variant", "source", "tier"]
    blank = F.when(u % 3 == 0, " ").otherwise(F.concat(F.lit("s"), (u % 3).cast("string")))
    apps = _apps(spark, sf).withColumns({
        "month": F.date_format("applied_at", "yyyy-MM"), "variant": F.coalesce(F.when(u % 4 != 0, (u % 4).cast("string")), F.lit("")),
        "source": F.coalesce(F.nullif(F.trim(blank), F.lit("")), F.lit("unknown")), "tier": F.when(u % 5 < 3, F.concat(F.lit("t"), (u % 5 + 1).cast("string"))).otherwise("untiered"),
    })
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {15: "all", 7: "month", 11: "variant", 13: "source", 14: "tier"}.items() for x in kv]), F.col("grouping").cast("int"))
    return E.cohort(apps, A.NOW, 30, by).withColumns({"kind": kind, "of": F.coalesce(*by, F.lit(""))}).drop("grouping", *by)


@query(f"WITH {A.APPLICATIONS} SELECT {A.COHORT} FROM apps WHERE applied_at >= TIMESTAMP '2024-01-08' AND applied_at < TIMESTAMP '2024-01-22'")
def fl8_cohort_window(spark, sf):
    from datetime import datetime

    return E.cohort(E.window(_apps(spark, sf), datetime(2024, 1, 8), datetime(2024, 1, 22)), A.NOW, 30)


@query(f"WITH {A.STATUS_EVENTS} SELECT user_id, arg_max(status, struct_pack(a := stamp, b := id)) AS status, count(*) AS n_events FROM ev GROUP BY 1")
def wn6_current_status(spark, sf):
    return E.current_status(A.status_events(spark, sf), ["user_id"])


@query(f"""WITH {A.STATUS_EVENTS}, folded AS (SELECT user_id, arg_max(status, struct_pack(a := stamp, b := id)) AS folded FROM ev WHERE user_id % 9 <> 0 GROUP BY 1),
stored AS (SELECT user_id, arg_max(status, stamp) AS status FROM ev WHERE day < DATE '2024-01-25' GROUP BY 1)
SELECT count(folded) AS covered, count(*) - count(folded) AS exempt, count(*) FILTER (WHERE folded <> status) AS mismatch FROM stored LEFT JOIN folded USING (user_id)""")
def cl14_verify_status(spark, sf):
    ev = A.status_events(spark, sf)
    stored = ev.filter("day < DATE '2024-01-25'").groupBy("user_id").agg(F.max_by("status", "at").alias("status"))
    return E.verify_status(stored, ev.filter("user_id % 9 <> 0"), ["user_id"])


@query(f"""WITH {A.STATUS_EVENTS}, steps AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY stamp, id) AS prev FROM ev),
r AS (SELECT *, CASE status WHEN 'applied' THEN 1 WHEN 'oa' THEN 2 WHEN 'interview' THEN 3 ELSE 4 END AS n, CASE prev WHEN 'applied' THEN 1 WHEN 'oa' THEN 2 WHEN 'interview' THEN 3 ELSE 4 END AS p FROM steps WHERE prev IS NOT NULL)
SELECT prev, status, count(*) AS n_steps, bool_and(prev <> status AND CASE WHEN n = 4 THEN p < 4 ELSE n > p END) AS may_advance FROM r GROUP BY 1, 2""")
def cl6_may_advance(spark, sf):
    from pyspark.sql import Window as W

    steps = A.status_events(spark, sf).withColumn("prev", F.lag("status").over(W.partitionBy("user_id").orderBy("at", "id"))).filter("prev IS NOT NULL")
    return steps.groupBy("prev", "status").agg(F.count(F.lit(1)).alias("n_steps"), F.bool_and(E.may_advance(F.col("prev"), F.col("status"))).alias("may_advance"))


@query(f"""WITH {A.APPLICATIONS}, idle AS (SELECT *, CAST(floor((epoch_ms(TIMESTAMP '2024-02-15') - epoch_ms(applied_at)) / 86400000.0) AS INTEGER) AS days_idle FROM apps WHERE NOT responded AND status NOT IN ('offer', 'rejected'))
SELECT user_id, CAST(day AS VARCHAR) AS day, days_idle, threshold FROM idle, (VALUES (14), (30)) AS t(threshold) WHERE days_idle >= threshold""")
def st7_nudges(spark, sf):
    return E.nudges(_apps(spark, sf), A.NOW).select("user_id", F.col("day").cast("string").alias("day"), "days_idle", "threshold")


@query("""SELECT l_orderkey AS order_id, l_linenumber AS line, lead_hours FROM lineitem, (VALUES (72), (24)) AS t(lead_hours)
WHERE l_shipdate > TIMESTAMP '1998-06-01' AND epoch_ms(l_shipdate) - epoch_ms(TIMESTAMP '1998-06-01') <= lead_hours * 3600000""")
def dt7_lead_window(spark, sf):
    from datetime import datetime

    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), "l_shipdate")
    return E.upcoming(rows, "l_shipdate", datetime(1998, 6, 1)).select("order_id", "line", "lead_hours")


def _signals(spark, sf):
    return L.with_prestige(L.company_signals(A.postings(spark, sf, deadlines=False), A.sightings(spark, sf)), A.tiers(spark))


@query(f"WITH {A.POSTINGS}, {A.SIGHTINGS}, {A.SIGNALS} SELECT company_key, company_name, total_postings, live_postings, pay_observations, round(median_pay, 6) AS median_pay, distinct_sources, round(prestige, 6) AS prestige FROM prestiges")
def ag1_company_signals(spark, sf):
    return _signals(spark, sf).select("company_key", "company_name", "total_postings", "live_postings", "pay_observations", F.round("median_pay", 6).alias("median_pay"), "distinct_sources", F.round("prestige", 6).alias("prestige"))


def _scored(spark, sf, rows=None):
    return L.scored(A.postings(spark, sf).filter("expired_at IS NULL") if rows is None else rows, _signals(spark, sf), A.NOW_POSTINGS)


_PARTS = ("s_pay", "s_recency", "s_deadline", "s_location", "s_prestige", "composite")


@query(f"WITH {A.POSTINGS}, {A.SIGHTINGS}, {A.SIGNALS}, {A.SCORED} SELECT posting_id, {', '.join(f'round({p}, 6) AS {p}' for p in _PARTS)} FROM scored WHERE expired_at IS NULL")
def pj8_scores(spark, sf):
    return _scored(spark, sf).select("posting_id", *[F.round(p, 6).alias(p) for p in _PARTS])


_AXIS = {
    "composite": ("0", "composite"),
    "pay": ("CASE WHEN hourly IS NULL THEN 2 ELSE 0 END", "hourly"),
    "posted": ("0", "-age"),
    "deadline": ("CASE WHEN days_left IS NULL THEN 2 WHEN days_left < 0 THEN 1 ELSE 0 END", "CASE WHEN days_left < 0 THEN days_left ELSE -days_left END"),
    "prestige": ("CASE WHEN prestige IS NULL THEN 2 ELSE 0 END", "prestige"),
}


def _page(axis: str):
    tier, value = _AXIS[axis]

    @query(f"""WITH {A.POSTINGS}, {A.SIGHTINGS}, {A.SIGNALS}, {A.SCORED}, r AS (SELECT posting_id, title, round({value}, 9) AS value, CAST({tier} AS INTEGER) AS tier FROM scored WHERE expired_at IS NULL)
SELECT posting_id, title, tier, round(value, 6) AS value FROM r ORDER BY tier, value DESC NULLS LAST, posting_id LIMIT 50 OFFSET 50""", name=f"so1_rank_{axis}")
    def ranked_page(spark, sf):
        rows = L.ranked(_scored(spark, sf), axis, A.NOW_POSTINGS).withColumn("value", F.round("value", 9))
        return L.page(rows, L.order(), 50, 50).select("posting_id", "title", "tier", F.round("value", 6).alias("value"))

    return ranked_page


for _name in _AXIS:
    _page(_name)


@query(f"""WITH {A.POSTINGS}, {A.SIGHTINGS}, {A.SIGNALS}, {A.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY company_key, title, coalesce(location, '') ORDER BY round(composite, 9) DESC, posting_id) AS n FROM scored WHERE expired_at IS NULL)
SELECT company_key, title, coalesce(location, '') AS place, min(posting_id) FILTER (WHERE n = 1) AS posting_id, count(*) - 1 AS n_other, coalesce(string_agg(CAST(posting_id AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n > 1), '') AS other_openings FROM r GROUP BY 1, 2, 3""")
def er5_fold_openings(spark, sf):
    rows = L.ranked(_scored(spark, sf), "composite", A.NOW_POSTINGS).withColumns({"place": F.coalesce("location", F.lit("")), "value": S.rounded(F.col("value"), 9)})
    folded = L.fold_openings(rows, ["company_key", "title", "place"])
    return folded.select("company_key", "title", "place", "posting_id", F.size("other_openings").cast("long").alias("n_other"), F.array_join(F.transform("other_openings", lambda x: x.cast("string")), ",").alias("other_openings"))


@query(f"""WITH {A.POSTINGS} SELECT posting_id, 'keep' AS mode FROM postings WHERE expired_at IS NULL AND (season IS NULL OR season = 'summer') AND (term_year IS NULL OR term_year = 2001) AND
 (({A.HOURLY}) IS NULL OR ({A.HOURLY}) BETWEEN 20 AND 80) AND ((class_min IS NULL AND class_max IS NULL) OR (coalesce(class_min <= 2003, true) AND coalesce(class_max >= 2003, true))) AND (location IS NULL OR lower(location || chr(10) || region) LIKE '%build%')
UNION ALL SELECT posting_id, 'drop' FROM postings WHERE expired_at IS NULL AND season = 'summer' AND term_year = 2001 AND ({A.HOURLY}) BETWEEN 20 AND 80 AND
 NOT (class_min IS NULL AND class_max IS NULL) AND coalesce(class_min <= 2003, true) AND coalesce(class_max >= 2003, true) AND lower(location || chr(10) || region) LIKE '%build%'""")
def fl1_admit(spark, sf):
    posts = A.postings(spark, sf)
    wanted = {"season": "summer", "year": 2001, "place": "build", "class_year": 2003, "pay_min": 20, "pay_max": 80}
    modes = [L.admit(posts, **wanted, keep_unknown=k).select("posting_id", F.lit("keep" if k else "drop").alias("mode")) for k in (True, False)]
    return modes[0].unionByName(modes[1])


@query(f"WITH {A.POSTINGS} SELECT company_key, count(*) AS n FROM postings WHERE expired_at IS NULL AND lower(company_name) = 'co 7' GROUP BY 1")
def fl6_company_filter(spark, sf):
    return L.admit(A.postings(spark, sf), company="CO 7").groupBy("company_key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {A.POSTINGS} SELECT count(*) FILTER (WHERE pay_min IS NOT NULL AND (currency IS NULL OR period IS NULL)) AS pay_without_unit, count(*) FILTER (WHERE pay_max < pay_min) AS pay_reversed,
count(*) FILTER (WHERE pay_min < 0) AS pay_negative, count(*) FILTER (WHERE class_max < class_min) AS class_reversed, count(*) FILTER (WHERE (expired_at IS NULL) <> (expiry_reason IS NULL)) AS expiry_incomplete FROM postings""")
def qc_violations(spark, sf):
    return quality.violations(A.postings(spark, sf))


@query(f"""WITH {A.POSTINGS}, n AS (SELECT *, CASE posting_id % 4 WHEN 0 THEN lower(replace(title, ' ', '-')) WHEN 1 THEN '--' || lower(title) || '_' || posting_id WHEN 2 THEN title ELSE CAST(posting_id AS VARCHAR) END AS slug FROM postings)
SELECT posting_id, CASE WHEN posting_id % 4 < 2 THEN array_to_string(list_transform(list_filter(regexp_split_to_array(slug, '[-_ ]'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') ELSE slug END AS company_name,
  CASE WHEN NOT coalesce(CASE season WHEN 'spring' THEN make_date(term_year, 6, 1) WHEN 'summer' THEN make_date(term_year, 9, 1) WHEN 'fall' THEN make_date(term_year + 1, 1, 1) WHEN 'winter' THEN make_date(term_year + 1, 4, 1) END <= CAST(posted_at AS DATE), false) THEN term_year END AS term_year FROM n""")
def pj11_term_presented(spark, sf):
    """Slugs as names, and years of terms that were over before the posting was there left out."""
    k, title = F.col("posting_id"), F.col("title")
    slug = F.when(k % 4 == 0, F.lower(F.replace(title, F.lit(" "), F.lit("-")))).when(k % 4 == 1, F.concat(F.lit("--"), F.lower(title), F.lit("_"), k.cast("string"))).when(k % 4 == 2, title).otherwise(k.cast("string"))
    return A.postings(spark, sf).select("posting_id", shown.display_name(slug).alias("company_name"), shown.presented_year(F.col("season"), F.col("term_year"), F.col("posted_at")).alias("term_year"))


@query(f"""WITH {A.POSTINGS}, {A.SIGHTINGS} SELECT company_key, source, count(DISTINCT posting_id) AS live FROM sightings JOIN postings USING (posting_id) WHERE expired_at IS NULL GROUP BY 1, 2""")
def jn2_sources_of_companies(spark, sf):
    joined = A.sightings(spark, sf).join(A.postings(spark, sf, deadlines=False).filter("expired_at IS NULL").select("posting_id", "company_key"), "posting_id")
    return joined.groupBy("company_key", "source").agg(F.countDistinct("posting_id").alias("live"))


@query(f"""WITH {A.SIGHTINGS} SELECT o_orderkey AS posting_id, 'seen_by_s1' AS kind FROM orders WHERE EXISTS (SELECT 1 FROM sightings WHERE posting_id = o_orderkey AND source = 's1')
UNION ALL SELECT o_orderkey, 'not_by_s2' FROM orders WHERE NOT EXISTS (SELECT 1 FROM sightings WHERE posting_id = o_orderkey AND source = 's2')""")
def jn3_semi_and_anti(spark, sf):
    o, s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("posting_id")), A.sightings(spark, sf)
    a = o.join(s.filter("source = 's1'"), "posting_id", "left_semi").withColumn("kind", F.lit("seen_by_s1"))
    return a.unionByName(o.join(s.filter("source = 's2'"), "posting_id", "left_anti").withColumn("kind", F.lit("not_by_s2")))


@query("SELECT e.user_id, e.event_id, e.event_type FROM events e WHERE e.event_id = (SELECT x.event_id FROM events x WHERE x.user_id = e.user_id ORDER BY x.ts DESC, x.event_id DESC LIMIT 1)")
def jn6_latest_row(spark, sf):
    ev = table(spark, sf, "events")
    last = ev.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    return last.select("user_id", "e.event_id", "e.event_type")


@query("""SELECT round(avg(value), 6) AS mean, max(value) AS most, [x for x in list_sort(list(value))][1 + CAST(round(0.5 * (count(*) - 1)) AS BIGINT)] AS p50, list_sort(list(value))[1 + CAST(round(0.99 * (count(*) - 1)) AS BIGINT)] AS p99, event_type FROM events GROUP BY event_type""")
def ag24_load_percentiles(spark, sf):
    return E.rank_percentiles(table(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p99": 0.99})


@query("SELECT o_orderkey AS id, to_json(struct_pack(id := o_orderkey, status := o_orderstatus)) AS snapshot FROM orders")
def pj16_snapshot(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("snapshot"))


@query(f"""WITH r AS (SELECT user_id AS recipe, 1 + CAST(floor(value) AS INTEGER) % 5 AS rating, ts FROM events WHERE value IS NOT NULL),
s AS (SELECT recipe, avg(rating) AS mean, greatest(0.0, max((rating - 3.0) * power(0.5, (epoch_ms(TIMESTAMP '2024-02-15') - epoch_ms(ts)) / 86400000.0 / 120.0))) AS score FROM r GROUP BY 1)
SELECT recipe, round(mean, 6) AS mean, round(score, 6) AS score FROM s WHERE mean >= 2.9""")
def ag19_liked(spark, sf):
    rows = table(spark, sf, "events").filter("value IS NOT NULL").select(F.col("user_id").alias("recipe"), (1 + F.floor("value").cast("int") % 5).alias("rating"), F.col("ts").alias("cooked_at"))
    return R.liked(rows, A.NOW, least_mean=2.9).select("recipe", F.round("mean", 6).alias("mean"), F.round("score", 6).alias("score"))
