"""Text normalisation, URL identity, quality gate, classification and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import fuzzy
from quillon.functions import parse as P
from quillon.functions import text as T
from quillon.functions import urls as U
from quillon.operators import classify as C
from quillon.operators import matching as M
from quillon.operators import quality
from quillon.operators.merge import unique_slugs
from quillon.plans import adapters as A
from quillon.plans.registry import query
from quillon.session import table

_WORDS = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(rf"SELECT doc_id, ' ' || {_WORDS.format(c='text')} || ' ' AS padded, contains(' ' || {_WORDS.format(c='text')} || ' ', ' the ') AS has_the FROM documents")
def tx1_phrase(spark, sf):
    padded = T.phrase(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", padded.alias("padded"), padded.contains(" the ").alias("has_the"))


@query(r"SELECT doc_id, sha256(coalesce(nullif(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ''), '')) AS collapsed FROM documents")
def tx2_collapse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce(T.collapse(F.col("text")), F.lit("")), 256).alias("collapsed"))


@query(rf"SELECT p_partkey AS id, regexp_replace({_WORDS.format(c='p_name')}, '( (' || '{'|'.join(T.LEGAL_SUFFIXES)}' || '))+$', '') AS key FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', Co. Ltd' WHEN 2 THEN ' GmbH' ELSE '' END AS p_name FROM part)")
def tx6_company_key(spark, sf):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 4 == 0, " Inc.").when(k % 4 == 1, ", Co. Ltd").when(k % 4 == 2, " GmbH").otherwise(""))
    return table(spark, sf, "part").select(k.alias("id"), T.company_key(name).alias("key"))


_TITLE = "p_name || CASE p_partkey % 5 WHEN 0 THEN ' Intern (Summer 2026)' WHEN 1 THEN ' [R-123] Software Engineer Internship 2025' WHEN 2 THEN ', fall program' WHEN 3 THEN ' Mechanical Engineering Intern' ELSE '' END"


def _titles(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(k % 5 == 0, " Intern (Summer 2026)").when(k % 5 == 1, " [R-123] Software Engineer Internship 2025").when(k % 5 == 2, ", fall program").when(k % 5 == 3, " Mechanical Engineering Intern").otherwise("")
    return table(spark, sf, "part").withColumn("title", F.concat("p_name", tail))


@query(rf"""SELECT p_partkey AS id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace({_TITLE}, '[(\[{{{{][^)\]}}}}]*[)\]}}}}]', '', 'g')), '[^\p{{L}}\p{{N}}]+'),
 lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]{{4}}') AND NOT list_contains({list(T.TITLE_NOISE)}, w)), '-') AS key FROM part""".replace("{{{{", "{").replace("}}}}", "}").replace("{{4}}", "{4}"))
def er3_title_key(spark, sf):
    return _titles(spark, sf).select(F.col("p_partkey").alias("id"), T.title_key(F.col("title")).alias("key"))


@query(f"""SELECT p_partkey AS id, CASE regexp_extract(lower({_TITLE}), '\\b(spring|summer|fall|autumn|winter)\\b', 1) WHEN 'autumn' THEN 'fall' WHEN '' THEN NULL ELSE regexp_extract(lower({_TITLE}), '\\b(spring|summer|fall|autumn|winter)\\b', 1) END AS season,
CAST(nullif(regexp_extract({_TITLE}, '\\b(2025|2026|2027|2028|2029)\\b', 1), '') AS INTEGER) AS year FROM part""")
def tx8_term(spark, sf):
    return _titles(spark, sf).select(F.col("p_partkey").alias("id"), P.season(F.col("title")).alias("season"), P.term_year(F.col("title"), 2026).alias("year"))


@query(f"""WITH raw AS (SELECT p_partkey AS id, {_TITLE} AS title, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE 'lists' END AS source, CASE WHEN p_partkey % 13 = 0 THEN 'ftp://x' ELSE 'https://x/' || p_partkey END AS url, CASE WHEN p_partkey % 19 <> 0 THEN p_brand END AS company FROM part),
t AS (SELECT *, ' ' || {_WORDS.format(c='title')} || ' ' AS p FROM raw),
f AS (SELECT id, CASE WHEN trim(source) = '' THEN 'rejected:missing_source' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'rejected:not_http' WHEN coalesce(trim(company), '') = '' THEN 'rejected:missing_company'
 WHEN NOT regexp_matches(p, ' ({'|'.join(quality.INTERN)}) ') THEN 'filtered:not_an_internship'
 WHEN NOT (regexp_matches(p, ' ({'|'.join(quality.SOFTWARE)}) ') OR (regexp_matches(p, ' ({'|'.join(quality.ENGINEERING)}) ') AND NOT regexp_matches(p, ' ({'|'.join(quality.OTHER)}) '))) THEN 'filtered:not_software' ELSE 'accepted:' END AS qc FROM t)
SELECT id, split_part(qc, ':', 1) AS qc_kind, nullif(split_part(qc, ':', 2), '') AS qc_reason FROM f""")
def tx12_quality_gate(spark, sf):
    k = F.col("p_partkey")
    raw = _titles(spark, sf).select(
        k.alias("id"), "title", F.when(k % 17 == 0, " ").otherwise("lists").alias("source"), k.cast("string").alias("external_id"),
        F.when(k % 13 == 0, "ftp://x").otherwise(F.concat(F.lit("https://x/"), k.cast("string"))).alias("url"), F.when(k % 19 != 0, F.col("p_brand")).alias("company"),
    )
    return quality.gate(raw).select("id", "qc_kind", "qc_reason")


@query(r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '^https?://', ''), '[?#].*$', '') AS bare FROM pages),
p AS (SELECT page_id, regexp_replace(lower(split_part(bare, '/', 1)), '^(www\.)+', '') AS host, CASE WHEN contains(bare, '/') THEN substr(bare, instr(bare, '/') + 1) ELSE '' END AS path FROM s),
k AS (SELECT page_id, host, array_to_string(list_filter(string_split(regexp_replace(trim(path, '/'), '(^|/)(apply|application)(/(apply|application))*$', ''), '/'), lambda x: x <> '' AND NOT regexp_full_match(x, '[a-z]{2}[-_][A-Za-z]{2}')), '/') AS path FROM p)
SELECT page_id, CASE WHEN path = '' THEN host ELSE host || '/' || path END AS canonical FROM k""")
def er1_canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query("""SELECT k.id, k.ats FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'greenhouse:acme:' || p_partkey WHEN 1 THEN 'lever:acme:job-' || p_partkey WHEN 2 THEN 'ashby:acme:a' || p_partkey END AS ats FROM part) k""")
def er2_ats_identity(spark, sf):
    k = F.col("p_partkey").cast("string")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://boards.greenhouse.io/Acme/jobs/"), k, F.lit("?gh_src=x"))).when(k % 4 == 1, F.concat(F.lit("https://jobs.lever.co/acme/job-"), k, F.lit("/apply"))).when(k % 4 == 2, F.concat(F.lit("http://jobs.ashbyhq.com/acme/a"), k)).otherwise(F.concat(F.lit("https://example.com/"), k))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), U.ats_identity(url).alias("ats"))


@query(r"SELECT p_partkey AS id, slug, CASE WHEN n = 1 THEN slug WHEN n <= 50 THEN slug || '-' || n END AS unique_slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part))")
def cp23_unique_slugs(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.slugify(F.col("p_name")).alias("slug"))
    return unique_slugs(rows, "slug", ["id"])


@query("""WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), w AS (SELECT name, unnest(string_split(name, ' ')) AS w FROM n),
c AS (SELECT name, max(1 - damerau_levenshtein('blue', w) / CAST(greatest(length('blue'), length(w)) AS DOUBLE)) AS s FROM w GROUP BY 1),
r AS (SELECT name, CASE WHEN name = 'blue' THEN 1.0 WHEN contains(' ' || name, ' blue') THEN 0.8 + 0.09 * (strlen('blue') / CAST(strlen(name) AS DOUBLE)) WHEN contains(name, 'blue') THEN 0.6 + 0.09 * (strlen('blue') / CAST(strlen(name) AS DOUBLE)) WHEN s > 0.7 THEN 0.3 + 0.2 * s END AS score FROM c)
SELECT name, round(score, 6) AS score FROM r WHERE score IS NOT NULL ORDER BY score DESC, name LIMIT 25""")
def tx13_suggest(spark, sf):
    return M.suggest(table(spark, sf, "part"), "p_name", " Blue ", 25).select("name", F.round("score", 6).alias("score"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS a FROM part), v AS (SELECT a, unnest([a, substr(a, 2, 1) || substr(a, 1, 1) || substr(a, 3), a || 's', substr(a, 2)]) AS b FROM w)
SELECT DISTINCT a, b, round(1 - damerau_levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 6) AS similarity FROM v""")
def tx14_similarity(spark, sf):
    """Each word against itself and three misspellings: swapped, longer, shorter."""
    words = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("a")).distinct()
    swapped = F.concat(F.substring("a", 2, 1), F.substring("a", 1, 1), F.substr("a", F.lit(3)))
    pairs = words.withColumn("b", F.explode(F.array("a", swapped, F.concat("a", F.lit("s")), F.substr("a", F.lit(2))))).distinct()
    return pairs.select("a", "b", F.round(fuzzy.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_GRADED = "g AS (SELECT CASE WHEN toxic = 1 THEN 'disregarded' WHEN quality = 1 THEN 'offer' ELSE 'outreach' END AS truth, CASE WHEN length(text) > 1500 THEN 'offer' WHEN length(text) > 700 THEN 'outreach' ELSE 'disregarded' END AS predicted FROM labels JOIN documents USING (doc_id))"


def _graded(spark, sf, high=1500, low=700, rows="true"):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), "doc_id").filter(rows)
    truth = F.when(F.col("toxic") == 1, "disregarded").when(F.col("quality") == 1, "offer").otherwise("outreach")
    return joined.select(truth.alias("truth"), F.when(F.col("n") > high, "offer").when(F.col("n") > low, "outreach").otherwise("disregarded").alias("predicted"))


@query(f"WITH {_GRADED} SELECT truth, predicted, count(*) AS n FROM g GROUP BY 1, 2")
def ag16_confusion(spark, sf):
    return C.confusion(_graded(spark, sf), "truth", "predicted")


@query(f"""WITH {_GRADED} SELECT count(*) AS graded, count(*) FILTER (WHERE truth = predicted) AS agreed, count(*) FILTER (WHERE truth = 'disregarded') AS junk, count(*) FILTER (WHERE truth = 'disregarded' AND predicted = 'outreach') AS junk_leaked_to_outreach,
count(*) FILTER (WHERE truth <> 'disregarded') AS real, count(*) FILTER (WHERE truth <> 'disregarded' AND predicted = 'disregarded') AS real_mail_disregarded, count(*) FILTER (WHERE truth = 'offer') AS pressing, count(*) FILTER (WHERE truth = 'offer' AND predicted <> truth) AS pressing_missed FROM g""")
def ag16_rates(spark, sf):
    return C.rates(_graded(spark, sf), "truth", "predicted")


_RATES = "count(*) AS graded, count(*) FILTER (WHERE truth = predicted) AS agreed, count(*) FILTER (WHERE truth = 'disregarded' AND predicted = 'outreach') AS leaked, count(*) FILTER (WHERE truth <> 'disregarded' AND predicted = 'disregarded') AS dropped, count(*) FILTER (WHERE truth = 'offer' AND predicted <> truth) AS missed"
#: Baselines of the gate: the other prediction (by a lower cut), the same, and one over fewer rows.
_BASELINES = {"lower_cut": (1200, 700, "true"), "same": (1500, 700, "true"), "fewer_rows": (1500, 700, "doc_id % 2 = 0"), "higher_cut": (3000, 900, "true")}


@query(f"""WITH base AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'disregarded' WHEN quality = 1 THEN 'offer' ELSE 'outreach' END AS truth, length(text) AS n FROM labels JOIN documents USING (doc_id)),
m AS (SELECT {_RATES} FROM (SELECT truth, CASE WHEN n > 1500 THEN 'offer' WHEN n > 700 THEN 'outreach' ELSE 'disregarded' END AS predicted FROM base)),
b AS ({' UNION ALL '.join(f"SELECT '{k}' AS baseline, {_RATES} FROM (SELECT truth, CASE WHEN n > {hi} THEN 'offer' WHEN n > {lo} THEN 'outreach' ELSE 'disregarded' END AS predicted FROM base WHERE {cond})" for k, (hi, lo, cond) in _BASELINES.items())})
SELECT baseline, m.graded = b.graded AND m.agreed >= b.agreed AND m.leaked <= b.leaked AND m.dropped <= b.dropped AND m.missed <= b.missed AS passed FROM m, b""")
def ag17_gate(spark, sf):
    """The predictions by length against four baselines: some pass, some fail."""
    measured, out = C.rates(_graded(spark, sf), "truth", "predicted"), None
    for name, (high, low, rows) in _BASELINES.items():
        gated = C.gate(measured, C.rates(_graded(spark, sf, high, low, rows), "truth", "predicted")).select(F.lit(name).alias("baseline"), "passed")
        out = gated if out is None else out.unionByName(gated)
    return out


@query(rf"""WITH names AS (SELECT lower(n_name) AS name FROM nation UNION SELECT 'the ' || lower(r_name) FROM region UNION SELECT * FROM (VALUES ('the'), ('of the'), ('in'))), t AS (SELECT doc_id, ' ' || {_WORDS.format(c='text')} || ' ' AS p FROM documents)
SELECT doc_id, arg_max(name, struct_pack(a := length(name), b := name)) AS name FROM t JOIN names ON contains(p, ' ' || {_WORDS.format(c='name')} || ' ') GROUP BY 1""")
def jn17_mentions(spark, sf):
    names = table(spark, sf, "nation").select(F.lower("n_name").alias("name")).union(table(spark, sf, "region").select(F.concat(F.lit("the "), F.lower("r_name"))))
    names = names.union(spark.createDataFrame([("the",), ("of the",), ("in",)], "name string")).distinct()
    return M.mentions(table(spark, sf, "documents"), "doc_id", "text", names, "name")


@query("""WITH u AS (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS a, lower(split_part(split_part(url, '://', 2), '/', 1)) AS b FROM pages), t AS (SELECT page_id AS target, a, b FROM u WHERE page_id % 3 = 0),
h AS (SELECT u.page_id, target, 0 AS nth_key FROM u JOIN t USING (a) UNION ALL SELECT u.page_id, target, 1 FROM u JOIN t USING (b))
SELECT page_id, arg_min(target, struct_pack(a := nth_key, b := target)) AS target, min(nth_key) AS nth_key FROM h GROUP BY 1""")
def jn16_identity(spark, sf):
    u = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_replace("url", "[?#].*$", "")).alias("a"), F.lower(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))).alias("b"))
    return M.by_identity(u, u.filter("page_id % 3 = 0").withColumnRenamed("page_id", "target"), ["a", "b"], "page_id", "target")


@query("""WITH n AS (SELECT DISTINCT lower(p_name) AS a FROM part), b AS (SELECT DISTINCT replace(lower(p_name), 'e', 'ee') AS b FROM part)
SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE round(1 - damerau_levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 6) END AS score FROM n JOIN b ON 1 - damerau_levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) >= 0.9 - 1e-12""")
def jn14_fuzzy_company(spark, sf):
    n = table(spark, sf, "part").select(F.lower("p_name").alias("a"))
    b = n.select(F.replace("a", F.lit("e"), F.lit("ee")).alias("b"))
    return M.fuzzy_companies(n, "a", b, "b", 0.9 - 1e-12).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'que la') OR contains(lower(source), 'que la') ORDER BY doc_id LIMIT 50")
def fl9_search(spark, sf):
    return M.search(table(spark, sf, "documents"), ["text", "source"], "Que LA").select("doc_id", "lang").orderBy("doc_id").limit(50)


_ROLES = """m AS (SELECT event_id AS id, 'firm ' || substr(md5(CAST(user_id AS VARCHAR)), 1, 12) || CASE WHEN event_id % 2 = 0 THEN 's' ELSE '' END AS company_key, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'software engineering intern' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' platform' ELSE ' summer' END END AS role_key FROM events),
a AS (SELECT c_custkey AS id, 'firm ' || substr(md5(CAST(c_custkey // 3 AS VARCHAR)), 1, 12) AS company_key, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'software engineering intern' WHEN 2 THEN 'software engineering intern platform' WHEN 3 THEN 'data intern' ELSE 'software engineering intern platform team' END AS role_key FROM customer)"""


@query(f"""WITH {_ROLES}, keys AS (SELECT DISTINCT m.company_key AS m, a.company_key AS k FROM (SELECT DISTINCT company_key FROM m) m, (SELECT DISTINCT company_key FROM a) a WHERE m.company_key = a.company_key OR 1 - damerau_levenshtein(m.company_key, a.company_key) / CAST(greatest(length(m.company_key), length(a.company_key)) AS DOUBLE) >= 0.9 - 1e-12),
p AS (SELECT m.id, a.id AS app_id, CASE WHEN m.role_key = '' THEN 0 WHEN m.role_key = a.role_key THEN 3 WHEN a.role_key <> '' AND least(len(string_split(m.role_key, ' ')), len(string_split(a.role_key, ' '))) >= 3 AND (starts_with(a.role_key, m.role_key || ' ') OR starts_with(m.role_key, a.role_key || ' ')) THEN 2 WHEN a.role_key = '' THEN 1 END AS fit FROM m JOIN keys ON m.company_key = keys.m JOIN a ON a.company_key = keys.k),
g AS (SELECT id, fit, count(DISTINCT app_id) AS n, min(app_id) AS app_id FROM p WHERE fit IS NOT NULL GROUP BY 1, 2)
SELECT id, app_id, fit FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fit DESC) AS r FROM g) WHERE r = 1 AND n = 1""")
def jn14_role_match(spark, sf):
    k, u, c = F.col("event_id"), F.col("user_id"), F.col("c_custkey")
    firm = lambda x: F.concat(F.lit("firm "), F.substring(F.md5(x.cast("string")), 1, 12))
    role = F.concat(F.lit("software engineering intern"), F.when(k % 3 == 0, "").when(k % 3 == 1, " platform").otherwise(" summer"))
    mail = table(spark, sf, "events").select(k.alias("id"), F.concat(firm(u), F.when(k % 2 == 0, "s").otherwise("")).alias("company_key"), F.when(k % 4 == 0, "").otherwise(role).alias("role_key"))
    own = F.element_at(F.array(*map(F.lit, ("", "software engineering intern", "software engineering intern platform", "data intern", "software engineering intern platform team"))), (c % 5 + 1).cast("int"))
    apps = table(spark, sf, "customer").select(c.alias("id"), firm(F.expr("c_custkey div 3")).alias("company_key"), own.alias("role_key"))
    return M.match_applications(mail, apps, 0.9 - 1e-12)


@query("""WITH n AS (SELECT lower(p_name) AS name, list_sort(list(DISTINCT lower(p_brand))) AS aliases FROM part GROUP BY 1), x AS (SELECT name, aliases, unnest(list_distinct(list_concat(string_split(name, ' '), flatten(list_transform(aliases, lambda a: string_split(a, ' ')))))) AS w FROM n),
c AS (SELECT name, max(1 - damerau_levenshtein('bl', w) / CAST(greatest(2, length(w)) AS DOUBLE)) AS s FROM x GROUP BY 1),
b AS (SELECT name, CASE WHEN name = 'bl' THEN 1.0 WHEN contains(' ' || name, ' bl') THEN 0.8 + 0.09 * (2 / CAST(strlen(name) AS DOUBLE)) WHEN contains(name, 'bl') THEN 0.6 + 0.09 * (2 / CAST(strlen(name) AS DOUBLE)) END AS own,
 list_max(list_transform(aliases, lambda a: CASE WHEN a = 'bl' THEN 0.9 WHEN contains(' ' || a, ' bl') THEN 0.7 + 0.09 * (2 / CAST(strlen(a) AS DOUBLE)) WHEN contains(a, 'bl') THEN 0.5 + 0.09 * (2 / CAST(strlen(a) AS DOUBLE)) END)) AS alias FROM n)
SELECT name, round(coalesce(greatest(own, alias), CASE WHEN s > 0.7 THEN 0.3 + 0.2 * s END), 6) AS score FROM b JOIN c USING (name) WHERE coalesce(own, alias, CASE WHEN s > 0.7 THEN s END) IS NOT NULL ORDER BY 2 DESC, name LIMIT 20""")
def cp4_suggest_with_aliases(spark, sf):
    names = table(spark, sf, "part").groupBy(F.lower("p_name").alias("name")).agg(F.array_sort(F.collect_set(F.lower("p_brand"))).alias("aliases"), F.max("p_partkey").alias("at"))
    return M.suggest_with_aliases(names, "BL", 20).withColumn("score", F.round("score", 6))


@query("""SELECT lower(p_name) AS name, 1.0 AS score FROM part GROUP BY 1 ORDER BY max(p_partkey) DESC, 1 LIMIT 5""")
def cp4_suggest_recent(spark, sf):
    names = table(spark, sf, "part").groupBy(F.lower("p_name").alias("name")).agg(F.array_sort(F.collect_set(F.lower("p_brand"))).alias("aliases"), F.max("p_partkey").alias("at"))
    return M.suggest_with_aliases(names, " ", 5)


@query("""WITH k AS (SELECT DISTINCT key FROM (SELECT lower(p_name) AS key FROM part UNION ALL SELECT split_part(lower(p_name), ' ', 1) FROM part UNION ALL SELECT lower(p_name) || ' labs' FROM part WHERE p_partkey % 3 = 0)) SELECT a.key AS alias, b.key AS canonical FROM k a JOIN k b ON starts_with(a.key, b.key || ' ')""")
def er7_alias_candidates(spark, sf):
    n = table(spark, sf, "part").select(F.lower("p_name").alias("key"), "p_partkey")
    keys = n.select("key").union(n.select(F.split_part("key", F.lit(" "), F.lit(1)))).union(n.filter("p_partkey % 3 = 0").select(F.concat("key", F.lit(" labs"))))
    return M.alias_candidates(keys, "key")


@query("SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id > 5) ORDER BY ts DESC, event_id LIMIT 26")
def so3_keyset_page(spark, sf):
    from datetime import datetime

    from quillon.operators.listing import keyset_page

    return keyset_page(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id", 25, (datetime(2024, 1, 20), 5))


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS place FROM documents ORDER BY 2 LIMIT 40")
def so7_hash_shuffle(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("place")).orderBy("place").limit(40)
