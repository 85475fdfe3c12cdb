"""Mail bodies, robots files and kept sightings over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions import mime
from quillon.functions import robots as R
from quillon.operators import buckets as B
from quillon.plans.registry import query
from quillon.session import scratch_root, table


def _data(text):
    """Base64 for URLs, without padding."""
    return F.struct(F.translate(F.base64(text.cast("binary")), "+/=", "-_").alias("data"))


def _part(kind: str, body):
    return F.struct(F.lit(kind).alias("mimeType"), _data(body).alias("body"))


_TEXT = r"left(trim(regexp_replace(text || ' ' || text || chr(10) || text, '\s+', ' ', 'g')), 4000)"


@query(f"""SELECT conv_id, turn, sha256(CASE conv_id % 7 WHEN 4 THEN '' WHEN 5 THEN '' ELSE nullif({_TEXT}, '') END) AS body FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)""")
def sc14_bodies(spark, sf):
    """A mail of each turn: plain, HTML, both nested, a blank plain part, none that can be read, no part at all, parts in parts."""
    text = F.coalesce("text", F.lit(""))
    text = F.concat(text, F.lit(" "), text, F.lit("\n"), text)
    html = F.concat(F.lit("<html><style>p { x }</style><p class='>"), F.lit("'>"), text, F.lit("</p><SCRIPT>if (a < b) { c }</SCRIPT><br"))
    html = F.replace(html, F.lit("'>'>"), F.lit("'>"))
    tree = lambda kind, *parts: F.to_json(F.struct(F.lit(kind).alias("mimeType"), F.array(*parts).alias("parts")))
    both = F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(_part("text/plain", text), _part("text/html", F.lit("<b>no</b>"))).alias("parts"))
    payloads = F.array(
        F.to_json(_part("text/plain", text)), F.to_json(_part("text/html", html)), tree("multipart/mixed", _part("text/html", F.lit("no")), _part("text/plain", text)),
        tree("multipart/mixed", _part("text/plain", F.lit(" \n ")), _part("text/html", html)), F.lit('{"mimeType": "text/plain", "body": {"data": "!!"}}'), F.lit('{"mimeType": "multipart/mixed"}'),
        F.to_json(F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(both).alias("parts"))),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.get(payloads, (F.col("conv_id") % 7).cast("int")).alias("payload"))
    body = F.coalesce(mime.body_text(F.col("payload")), F.when((F.col("conv_id") % 7).isin(4, 5), F.lit("")))
    return rows.select("conv_id", "turn", F.sha2(body, 256).alias("body"))


#: Robots files by page, and when each lets a path be fetched, said in SQL.
_ROBOTS = (
    ("User-agent: *\nDisallow: /\nAllow: /en", "starts_with(path, '/en')"),
    ("User-agent: other\nDisallow: /", "true"),
    ("User-agent: x\nUser-agent: *\nDisallow: /*/9*\nAllow: /fr/9", "starts_with(path, '/fr/9') OR NOT contains(substr(path, 2), '/9')"),
    ("User-agent: *\nDisallow: /*5$ # fives\nDisallow:\nCrawl-delay: 2", "strpos(substr(path, 2), '5') <> length(path) - 1 OR NOT contains(path, '5')"),
    (None, "true"),
    ("Disallow: /\nuser-agent: *\nallow: /x\nUser-agent: other\nDisallow: /", "true"),
    ("User-agent: *\nDisallow: /fr\nDisallow: /fr/8*\nAllow: /fr/82", "starts_with(path, '/fr/82') OR NOT starts_with(path, '/fr')"),
)
_PATH = r"^https?://[^/?#]*([^?#]*)"


@query(rf"""SELECT page_id, CASE page_id % {len(_ROBOTS)} {' '.join(f'WHEN {i} THEN ({sql})' for i, (_, sql) in enumerate(_ROBOTS))} END AS permitted
FROM (SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, regexp_extract(url, '{_PATH}', 1) AS p FROM pages))""")
def tx21_robots(spark, sf):
    path = F.coalesce(F.nullif(F.regexp_extract("url", _PATH, 1), F.lit("")), F.lit("/"))
    files = F.array(*[F.lit(text).cast("string") for text, _ in _ROBOTS])
    rows = table(spark, sf, "pages").select("page_id", path.alias("path"), F.get(files, (F.col("page_id") % len(_ROBOTS)).cast("int")).alias("robots"))
    return rows.select("page_id", R.robots_permit(R.robots_rules(F.col("robots")), F.col("path")).alias("permitted"))


@query("""WITH s AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS external_id, 'p' || (event_id % 97) AS posting_id, 'https://x/' || event_id AS url, ts, event_id AS run, dayofmonth(ts) <= 20 AS early FROM events),
b AS (SELECT source, external_id, early, min(ts) AS first_seen, arg_max(struct_pack(posting_id, url, ts, run), struct_pack(a := ts, b := run)) AS n FROM s GROUP BY 1, 2, 3)
SELECT source, external_id, arg_max(n, NOT early).posting_id AS posting_id, arg_max(n, NOT early).url AS url, arg_min(first_seen, NOT early) AS first_seen, arg_max(n, NOT early).ts AS last_seen, arg_max(n, NOT early).run AS run,
 CAST(CASE WHEN bool_or(NOT early) THEN 0 ELSE 3 END AS BIGINT) AS misses FROM b GROUP BY 1, 2""")
def sk2_sightings(spark, sf):
    """A month's sightings kept in buckets: the first twenty days, three misses of all, then the rest."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("external_id"), F.concat(F.lit("p"), (F.col("event_id") % 97).cast("string")).alias("posting_id"),
        F.concat(F.lit("https://x/"), F.col("event_id").cast("string")).alias("url"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("run"),
    )
    early = F.dayofmonth("at") <= 20
    kept = B.BucketedTable(spark, f"{scratch_root(spark)}/quillon/sightings-{uuid.uuid4().hex}", B.SIGHTINGS, ["source", "external_id"], 16)
    kept.merge(rows.filter(early), B.seen_again)
    missed = kept.read().select("source", "external_id")
    kept.merge(missed, lambda old, batch: old.join(batch, ["source", "external_id"]).withColumn("misses", F.col("misses") + 3))
    kept.merge(rows.filter(~early), B.seen_again)
    stamp = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return kept.read().select("source", "external_id", "posting_id", "url", stamp("first_seen"), stamp("last_seen"), "run", "misses")
