"""The library's inputs made out of the driver's tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import table

NOW = datetime(2024, 2, 15)  # of the event tables
NOW_POSTINGS = datetime(2001, 3, 1)
STATUS = {"view": "applied", "click": "oa", "signup": "interview", "purchase": "offer", "error": "rejected"}


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, at, id, status."""
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("ts").alias("at"), F.col("event_id").alias("id"), status.alias("status"))


STATUS_EVENTS = """ev AS (SELECT user_id, CAST(ts AS DATE) AS day, ts AS stamp, event_id AS id, CASE event_type WHEN 'view' THEN 'applied' WHEN 'click' THEN 'oa'
 WHEN 'signup' THEN 'interview' WHEN 'purchase' THEN 'offer' ELSE 'rejected' END AS status FROM events)"""

APPLICATIONS = (
    STATUS_EVENTS
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY stamp, id) AS rn FROM ev),
apps AS (SELECT user_id, day, min(stamp) AS applied_at, arg_max(status, rn) AS status,
  coalesce(bool_or(rn > 1 AND status <> 'applied'), false) AS responded,
  (epoch_ms(min(stamp) FILTER (WHERE rn > 1 AND status <> 'applied')) - epoch_ms(min(stamp))) / 86400000.0 AS response_days,
  coalesce(bool_or(rn > 1 AND status IN ('oa', 'interview', 'offer')), false) AS reached_oa,
  coalesce(bool_or(rn > 1 AND status IN ('interview', 'offer')), false) AS reached_interview,
  coalesce(bool_or(rn > 1 AND status = 'offer'), false) AS offered,
  coalesce(bool_or(rn > 1 AND status = 'rejected'), false) AS was_rejected
  FROM numbered GROUP BY user_id, day)"""
)

COHORT = """count(*) AS applications, count(*) FILTER (WHERE responded) AS responded,
  count(*) FILTER (WHERE NOT responded AND status NOT IN ('offer', 'rejected') AND epoch_ms(TIMESTAMP '2024-02-15') - epoch_ms(applied_at) <= 2592000000) AS no_response_live,
  count(*) FILTER (WHERE NOT responded AND status NOT IN ('offer', 'rejected') AND epoch_ms(TIMESTAMP '2024-02-15') - epoch_ms(applied_at) > 2592000000) AS no_response_dead,
  count(*) FILTER (WHERE reached_oa) AS reached_oa, count(*) FILTER (WHERE reached_interview) AS reached_interview,
  count(*) FILTER (WHERE offered) AS offers, count(*) FILTER (WHERE was_rejected) AS rejected,
  round(quantile_cont(response_days, 0.5), 6) AS median_days, round(quantile_disc(response_days, 0.9), 6) AS p90_days, count(response_days) AS n_days"""


def postings(spark: SparkSession, sf_dir: str, deadlines: bool = True) -> DataFrame:
    """One posting per order; every kind of unknown occurs. Without ``deadlines`` the line items are not read."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    ship = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    k = F.col("o_orderkey")
    period = F.element_at(F.array(F.lit("hour"), F.lit("month"), F.lit("year"), F.lit(None)), (k % 4 + 1).cast("int"))
    pay = F.when(k % 4 == 0, F.col("o_totalprice") / 5000).when(k % 4 == 1, F.col("o_totalprice") / 30).when(k % 4 == 2, F.col("o_totalprice") / 2)
    low = pay
    expired = F.when(k % 10 == 9, F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    rows = o.join(c, o.o_custkey == c.c_custkey)
    rows = rows.join(ship, k == F.col("l_orderkey"), "left") if deadlines else rows.withColumn("last_ship", F.lit(None).cast("timestamp_ntz"))
    return rows.select(
        k.alias("posting_id"),
        F.concat(F.lit("co-"), (F.col("o_custkey") % 97).cast("string")).alias("company_key"),
        F.concat(F.lit("Co "), (F.col("o_custkey") % 97).cast("string")).alias("company_name"),
        F.concat_ws(" ", "c_mktsegment", F.lit("engineer"), (k % 7).cast("string")).alias("title"),
        F.when(k % 9 != 0, F.col("c_mktsegment")).alias("location"),
        F.when(k % 9 != 0, F.col("o_orderpriority")).alias("region"),
        low.alias("pay_min"),
        F.when(k % 3 != 0, low * 1.25).alias("pay_max"),
        F.when(low.isNotNull(), F.when(k % 11 == 0, "EUR").otherwise("USD")).alias("currency"),
        period.alias("period"),
        F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("is_remote"),
        F.col("o_orderdate").alias("posted_at"),
        (k % 5 == 0).alias("posted_estimated"),
        F.when(k % 6 != 0, F.col("last_ship")).alias("deadline"),
        expired.alias("expired_at"),
        F.when(k % 10 == 9, "vanished_from_sources").alias("expiry_reason"),
        F.element_at(F.array(F.lit("spring"), F.lit("summer"), F.lit("fall"), F.lit("winter"), F.lit(None)), (k % 5 + 1).cast("int")).alias("season"),
        F.when(k % 8 != 0, (2000 + k % 3).cast("int")).alias("term_year"),
        F.when(k % 7 > 1, (2001 + k % 4).cast("int")).alias("class_min"),
        F.when(k % 7 > 2, (2003 + k % 4).cast("int")).alias("class_max"),
    )


POSTINGS = """postings AS (SELECT o_orderkey AS posting_id, 'co-' || (o_custkey % 97) AS company_key, 'Co ' || (o_custkey % 97) AS company_name,
  c_mktsegment || ' engineer ' || (o_orderkey % 7) AS title,
  CASE WHEN o_orderkey % 9 <> 0 THEN c_mktsegment END AS location, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS region,
  pay AS pay_min, CASE WHEN o_orderkey % 3 <> 0 THEN pay * 1.25 END AS pay_max,
  CASE WHEN pay IS NOT NULL THEN CASE WHEN o_orderkey % 11 = 0 THEN 'EUR' ELSE 'USD' END END AS currency,
  ['hour', 'month', 'year', NULL][o_orderkey % 4 + 1] AS period,
  CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS is_remote, o_orderdate AS posted_at, o_orderkey % 5 = 0 AS posted_estimated,
  CASE WHEN o_orderkey % 6 <> 0 THEN last_ship END AS deadline, CASE WHEN o_orderkey % 10 = 9 THEN o_orderdate + INTERVAL 60 DAY END AS expired_at,
  CASE WHEN o_orderkey % 10 = 9 THEN 'vanished_from_sources' END AS expiry_reason,
  ['spring', 'summer', 'fall', 'winter', NULL][o_orderkey % 5 + 1] AS season, CASE WHEN o_orderkey % 8 <> 0 THEN CAST(2000 + o_orderkey % 3 AS INTEGER) END AS term_year,
  CASE WHEN o_orderkey % 7 > 1 THEN CAST(2001 + o_orderkey % 4 AS INTEGER) END AS class_min, CASE WHEN o_orderkey % 7 > 2 THEN CAST(2003 + o_orderkey % 4 AS INTEGER) END AS class_max
  FROM (SELECT o.*, c_mktsegment, last_ship, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice / 5000 WHEN 1 THEN o_totalprice / 30 WHEN 2 THEN o_totalprice / 2 END AS pay
    FROM orders o JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey))"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posting_id, source: each order is seen by the sources of its line items."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("posting_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source"))


SIGHTINGS = "sightings AS (SELECT l_orderkey AS posting_id, 's' || (l_suppkey % 5) AS source FROM lineitem)"
# Curated companies of the test tables; a repeated key counts with its better tier.
TIERS = (("co-1", 1), ("co-2", 2), ("Co-3 ", 3), ("co-1", 2), ("co-5", 2))


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TIERS), "key string, tier int")


SIGNALS = """signals AS (SELECT company_key, min(company_name) AS company_name, count(*) AS total_postings, count(*) FILTER (WHERE expired_at IS NULL) AS live_postings,
  count(*) FILTER (WHERE currency = 'USD' AND period = 'hour' AND pay_min IS NOT NULL) AS pay_observations,
  quantile_disc(CASE WHEN currency = 'USD' AND period = 'hour' THEN pay_min END, 0.5) AS median_pay, min(posted_at) AS first_seen FROM postings GROUP BY 1),
src AS (SELECT company_key, count(DISTINCT source) AS distinct_sources FROM sightings JOIN postings USING (posting_id) GROUP BY 1),
tiers AS (SELECT lower(trim(k)) AS company_key, min(t) AS tier FROM (VALUES ('co-1', 1), ('co-2', 2), ('Co-3 ', 3), ('co-1', 2), ('co-5', 2)) AS v(k, t) GROUP BY 1),
facts AS (SELECT s.*, coalesce(distinct_sources, 0) AS distinct_sources, tier, max(coalesce(distinct_sources, 0)) OVER () AS most,
  greatest(0.0, least(1.0, ln(1 + greatest(live_postings, 0)) / ln(41))) AS volume FROM signals s LEFT JOIN src USING (company_key) LEFT JOIN tiers USING (company_key)),
spreads AS (SELECT *, CASE WHEN most <= 1 THEN 0.5 ELSE greatest(0.0, least(1.0, distinct_sources / most)) END AS spread FROM facts),
prestiges AS (SELECT *, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.88 WHEN 3 THEN 0.78 ELSE CASE WHEN live_postings >= 2 OR distinct_sources >= 2 OR median_pay IS NOT NULL THEN
  0.35 + 0.30 * greatest(0.0, least(1.0, 0.5 * coalesce(greatest(0.0, least(1.0, median_pay / 90.0)), (volume + spread) / 2) + 0.3 * volume + 0.2 * spread)) END END AS prestige FROM spreads)"""

HOURLY = """CASE WHEN currency = 'USD' THEN coalesce((pay_min + pay_max) / 2, pay_min) / CASE period WHEN 'hour' THEN 1e0 WHEN 'month' THEN 2080e0 / 12 WHEN 'year' THEN 2080e0 END END"""

SCORED = (
    f"""paid AS (SELECT *, {HOURLY} AS hourly, (epoch_ms(TIMESTAMP '2001-03-01') - epoch_ms(posted_at)) / 86400000.0 AS age,
  (epoch_ms(deadline) - epoch_ms(TIMESTAMP '2001-03-01')) / 86400000.0 AS days_left FROM postings),
parts AS (SELECT p.*, prestige,
  CASE WHEN hourly IS NOT NULL THEN greatest(0.0, least(1.0, (hourly - 15) / 50)) WHEN pay_min IS NOT NULL AND period IS NOT NULL THEN 0.5
    WHEN pay_observations >= 3 THEN coalesce(0.5 + (greatest(0.0, least(1.0, (median_pay - 15) / 50)) - 0.5) * 0.7, 0.5) ELSE 0.5 END AS s_pay,
  CASE WHEN posted_estimated THEN least(0.5, power(0.5, greatest(0.0, age) / 30.0)) ELSE power(0.5, greatest(0.0, age) / 30.0) END AS s_recency,
  CASE WHEN deadline IS NULL THEN 0.5 WHEN days_left < 0 THEN 0.0 WHEN days_left <= 7 THEN 1.0 WHEN days_left >= 90 THEN 0.0 ELSE (90 - days_left) / 83.0 END AS s_deadline,
  CASE WHEN is_remote THEN 1.0 ELSE 0.5 END AS s_location, coalesce(prestige, 0.5) AS s_prestige
  FROM paid p LEFT JOIN prestiges USING (company_key)),
scored AS (SELECT *, s_pay * 0.29 + s_recency * 0.23 + s_deadline * 0.15 + s_location * 0.10 + s_prestige * 0.23 AS composite FROM parts)"""
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(runs: source, run, outcome, fetched; sightings: source, external_id, run) from events by day."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("run"), F.col("user_id").alias("external_id"))
    n = e.groupBy("source", "run").agg(F.count(F.lit(1)).alias("fetched"))
    day = F.dayofmonth("run")
    fetched = F.when(day % 6 == 0, F.lit(0)).otherwise(F.col("fetched")).cast("long")
    return n.select("source", "run", F.when(day % 7 == 0, "partial").otherwise("success").alias("outcome"), fetched.alias("fetched")), e


RUNS = """sight AS (SELECT event_type AS source, CAST(ts AS DATE) AS run, user_id AS external_id FROM events),
runs AS (SELECT source, run, CASE WHEN dayofmonth(run) % 7 = 0 THEN 'partial' ELSE 'success' END AS outcome,
  CASE WHEN dayofmonth(run) % 6 = 0 THEN 0 ELSE count(*) END AS fetched FROM sight GROUP BY 1, 2),
judged AS (SELECT *, CASE WHEN outcome <> 'success' THEN 'not_successful'
  WHEN fetched = 0 AND last_value(CASE WHEN outcome = 'success' AND fetched > 0 THEN fetched END IGNORE NULLS) OVER (PARTITION BY source ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'suspicious_zero'
  ELSE 'eligible' END AS eligible FROM runs),
numbered_runs AS (SELECT source, run, sum(CASE WHEN eligible = 'eligible' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY run) AS nth FROM judged),
seen AS (SELECT source, external_id, max(run) AS run FROM sight GROUP BY 1, 2),
missed AS (SELECT s.source, s.external_id, s.run AS last_run, CAST(l.last_nth - n.nth AS BIGINT) AS misses FROM seen s JOIN numbered_runs n USING (source, run)
  JOIN (SELECT source, max(nth) AS last_nth FROM numbered_runs GROUP BY 1) l ON l.source = s.source)"""
