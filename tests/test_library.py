"""Column builders and operators on small rows; queries against DuckDB on the smallest tables."""

import collections
import datetime as dt
import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillon.functions import fuzzy, parse, score, shown, text, urls
from quillon.operators import classify, events, listing, matching, merge, quality, recommend, tracking
from quillon.sources import boards, files
from quillon.streaming import jobs

SF = "/root/testdata/sf0.001"
LIBRARY = __spark_entry__._library()


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name", sorted(LIBRARY.SQL))
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = LIBRARY.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = connection.sql(LIBRARY.SQL[name])
    assert sorted(found.columns) == columns
    plain = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    want = collections.Counter(tuple(plain(dict(zip(found.columns, row))[c]) for c in columns) for row in found.fetchall())
    got = collections.Counter(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(LIBRARY.QUERIES) - set(LIBRARY.SQL)))
def test_query_runs(spark, name):
    assert LIBRARY.QUERIES[name](spark, SF).count() > 0


def test_limiter_against_plain_loop(spark):
    hits = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("at")).collect():
        hits[str(r.user_id)].append(r["at"])
    want = collections.Counter()
    for key, stamps in hits.items():
        taken = []
        for at in sorted(stamps):
            taken = [x for x in taken if (at - x).total_seconds() < 6 * 3600]
            if len(taken) < 3:
                taken.append(at)
                want[(key, at, True, 0.0)] += 1
            else:
                want[(key, at, False, round(6 * 3600 - (at - taken[0]).total_seconds(), 3))] += 1
    rows = LIBRARY.QUERIES["st8_limiter"](spark, SF).collect()
    assert collections.Counter((r.key, r["at"], r.allowed, round(r.retry_after, 3)) for r in rows) == want and not all(r.allowed for r in rows)


def test_merge_stock_against_plain_fold(spark):
    rows = [(r.l_partkey, r.l_shipdate, r.l_orderkey * 10 + r.l_linenumber, r.l_quantity) for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()]
    lots = collections.defaultdict(list)
    for item, at, _, quantity in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        near = [x for x in lots[item] if abs((x[1] - at).total_seconds()) <= 3 * 86_400]
        if near:
            lot = min(near, key=lambda x: x[1])
            lot[0], lot[1], lot[2] = lot[0] + quantity, min(lot[1], at), lot[2] + 1
        else:
            lots[item].append([float(quantity), at, 1])
    want = collections.Counter((item, round(q, 4), at, n) for item, own in lots.items() for q, at, n in own)
    got = LIBRARY.QUERIES["sk9_merge_stock"](spark, SF).collect()
    assert collections.Counter((r.item, round(r.quantity, 4), r.expires_at, r.arrivals) for r in got) == want and len(got) < len(rows)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Acme, Inc.", "acme"), ("Acme Co. Ltd", "acme"), ("Co", "co"), ("Foo L L C", "foo l l c"), ("Åre AB", "åre"),
    ],
)
def test_company_key(spark, given, want):
    assert one(spark, text.company_key(F.lit(given))) == want


def test_canonical_url(spark):
    cases = {
        "https://www.Example.com/jobs/1/apply?utm=x#y": "example.com/jobs/1",
        "http://boards.greenhouse.io/Acme/jobs/5": "job-boards.greenhouse.io/acme/jobs/5",
        "https://jobs.ashbyhq.com/Acme/x/application": "jobs.ashbyhq.com/Acme/x",
        "https://a.wd1.myworkdayjobs.com/en-US/Site/job/R1": "a.wd1.myworkdayjobs.com/Site/job/R1",
        "https://example.com/": "example.com",
    }
    for given, want in cases.items():
        assert one(spark, urls.canonical_url(F.lit(given))) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("$45/hr", (45.0, None, "USD", "hour")), ("USD 100,000 - 120,000", (100_000.0, 120_000.0, "USD", "year")), ("$30 - $40 per hour", (30.0, 40.0, "USD", "hour")),
        ("CA$8k monthly", (8000.0, None, "CAD", "month")), ("competitive", None), ("$500 per week", None), ("$40 - $30 hourly", None), ("$5,000", None), (None, None), ("$60k-80k", (60_000.0, 80_000.0, "USD", "year")),
    ],
)
def test_parse_pay(given, want):
    assert parse.parse_pay_text(given) == want


def test_edit_distance():
    assert fuzzy.edit_distance("ca", "ac") == 1 and fuzzy.edit_distance("ca", "abc") == 2 and fuzzy.edit_distance("", "abc") == 3 and fuzzy.edit_distance("kitten", "sitting") == 3


def test_deadlines():
    now = dt.datetime(2024, 1, 15, 9)  # a Monday
    assert parse.find_deadline("Please complete within 3 days", now) == dt.datetime(2024, 1, 18, 9)
    assert parse.find_deadline("due by January 20", now) == dt.datetime(2024, 1, 20)
    assert parse.find_deadline("submit before Monday", now) == dt.datetime(2024, 1, 22)
    assert parse.find_deadline("deadline: 1/10", now) == dt.datetime(2025, 1, 10)
    assert parse.find_deadline("see you on 1/20", now) is None and parse.find_deadline(None, now) is None


def test_unknown_is_neutral_and_weights_sum_to_one(spark):
    assert sum(score.WEIGHTS.values()) == pytest.approx(1)
    null = F.lit(None)
    parts = {"pay": score.pay_score(null.cast("double"), F.lit(False), null.cast("double"), F.lit(0)), "recency": score.recency(null.cast("timestamp"), F.lit(False), F.current_timestamp()), "deadline": score.deadline(null.cast("timestamp"), F.current_timestamp()), "location": score.location(null.cast("boolean")), "prestige": F.lit(0.5)}
    assert one(spark, score.composite(parts)) == pytest.approx(0.5)


def test_instants(spark):
    at = {"2024-01-02T03:04:05Z": 1704164645, "2024-01-02": 1704153600, "2024/01/02": 1704153600, "1704164645": 1704164645, "1704164645000": 1704164645, "soon": None}
    for given, want in at.items():
        assert one(spark, F.unix_seconds(parse.instant(F.lit(given)))) == want, given


def test_filters_are_checked():
    for bad in ({"limit": 0}, {"limit": 201}, {"sort": "x"}, {"pay_min": float("nan")}, {"pay_min": 3, "pay_max": 2}, {"offset": -1}):
        with pytest.raises(ValueError):
            listing.check_filters(**bad)
    with pytest.raises(ValueError):
        events.window(None, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1))


def test_classifier_rules(spark):
    cases = {
        "Unfortunately, we chose other candidates.": "rejection", "We are pleased to offer you the role": "offer", "Please schedule your interview": "interview", "We would like to schedule an interview": "interview",
        "Complete the online assessment": "oa", "Thank you for applying to us": "confirmation", "hello": "disregarded", "If you were not selected, apply again": "disregarded",
        "If you are selected, we will schedule an interview": "disregarded", "Your verification code is 1": "disregarded", "Kindly reply within 5 business days about your application": "oa", "We reply within 5 business days about your application": "disregarded",
    }
    for given, want in cases.items():
        assert one(spark, classify.classify(classify.mail(F.lit(""), F.lit(given)))["category"]) == want, given
    decided = {r.rule for r in LIBRARY.QUERIES["cl1_classify"](spark, SF).collect()}
    assert decided == set(range(-1, len(classify.RULES)))  # every rule decides something


def test_quality_gate_counts_add_up(spark):
    rows = [("s", "1", "https://x", "Acme", "Software Intern"), ("s", "2", "https://x", "Acme", "Sales Intern"), ("s", "3", "ftp://x", "Acme", "Software Intern"), (None, "4", "https://x", "Acme", "Software Intern"), ("s", "5", "https://x", "Acme", "Chef")]
    out = quality.gate(spark.createDataFrame(rows, "source string, external_id string, url string, company string, title string"))
    got = {r.external_id: (r.qc_kind, r.qc_reason) for r in out.collect()}
    assert got == {"1": ("accepted", None), "2": ("filtered", "not_software"), "3": ("rejected", "not_http"), "4": ("rejected", "missing_source"), "5": ("filtered", "not_an_internship")}


def test_board_readers(spark):
    frame = lambda x, **more: spark.createDataFrame([(json.dumps(x), *more.values())], ", ".join(["body string", *(f"{k} string" for k in more)]))
    g = boards.greenhouse(frame({"jobs": [{"id": 7, "absolute_url": "u", "title": "T", "company_name": "C", "location": {"name": "L"}, "pay_input_ranges": [{"min_cents": 4500, "max_cents": 5000, "currency_type": "USD"}] * 2}]})).first()
    assert (g.external_id, g.pay_text) == ("7", "USD 45.00 - 50.00 [+1 more published ranges]") and boards.greenhouse(frame({})).count() == 0
    lever = boards.lever(frame([{"id": "a", "text": "T", "hostedUrl": "h", "workplaceType": "remote", "categories": {"allLocations": ["X", "Y"]}, "salaryRange": {"min": 1.0, "max": 2.0, "currency": "USD", "interval": "per-hour-wage"}}], company="C")).first()
    assert (lever.company, lever.location, lever.is_remote, lever.pay_text) == ("C", "X; Y", True, "USD 1.00 - 2.00 hour")
    ashby = boards.ashby(frame({"jobs": [{"id": "a", "title": "T", "compensation": {"summaryComponents": [{"compensationType": "Equity", "minValue": 1.0}, {"compensationType": "Salary", "minValue": 3.0, "maxValue": 4.0, "currencyCode": "USD", "interval": "NONE"}]}}]})).first()
    assert ashby.pay_text == "USD 3.00 - 4.00"
    assert boards.ashby(frame({"jobs": [{"id": "a", "title": "T", "location": "X", "secondaryLocations": ["Y", {"location": "Z"}, " "]}]})).first().location == "X; Y; Z"
    assert boards.more_pages(100, 3) and not boards.more_pages(99, 3) and not boards.more_pages(100, 20)
    w = boards.workable(frame({"name": "Acme", "jobs": [{"title": "T", "shortcode": "Q", "city": "A", "state": None, "country": "B"}]})).first()
    assert (w.company, w.location, w.url) == ("Acme", "A, B", "https://apply.workable.com/j/Q")
    rows, closed = boards.listings(frame([{"id": "1", "active": True, "title": "T", "terms": ["N/A", "Summer 2026"], "locations": ["A", "B"]}, {"id": "2", "active": False}]))
    assert rows.first().title == "T (Summer 2026)" and [r.external_id for r in closed.collect()] == ["2"]
    rss = "<rss><channel><item><title>Acme: Engineer &amp; more</title><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate><guid>g</guid><link>l</link></item></channel></rss>"
    item = boards.feed(spark.createDataFrame([(rss,)], "body string")).first()
    assert (item.company, item.title, item.posted_text) == ("Acme", "Engineer & more", "2024-01-02T03:04:05Z")
    html = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"T","hiringOrganization":{"name":"C"},"baseSalary":{"currency":"USD","value":{"minValue":1,"maxValue":2,"unitText":"HOUR"}}},{"@type":"Thing"}]}</script>'
    ld = boards.json_ld(spark.createDataFrame([("u", html)], "url string, html string")).collect()
    assert [(r.title, r.company, r.pay_text, r.url) for r in ld] == [("T", "C", "USD 1 - 2 hour", "u")]


def test_front_matter(spark):
    rows = [("d/a.md", "---\ntitle: A\nslug: x\n---\nBody"), ("d/b.md", "---\r\ntitle: B\r\n---\r\n"), ("d/c.md", "---\ntitle: C\ntitle: D\n---\n"), ("d/e.md", "none"), ("d/README.md", "x"), ("d/f.md", "---\ntitle: F\nnope: 1\n---\n")]
    got = {r.path: (r.slug, r.parsed, r.error) for r in files.front_matter(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"d/a.md": ("x", True, None), "d/b.md": ("b", False, "no body"), "d/c.md": ("c", False, "repeated key"), "d/e.md": ("e", False, "no front matter"), "d/f.md": ("f", False, "unknown key")}


def test_limiter_ignores_refused_hits(spark):
    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (0, 1, 2, 11, 12)]
    rows = jobs.limited_batch(spark.createDataFrame([("k", t) for t in at], "key string, at timestamp"), 2, 10).orderBy("at").collect()
    assert [r.allowed for r in rows] == [True, True, False, True, True] and rows[2].retry_after == 8


def test_interleave_keeps_every_row_once(spark):
    rows = spark.range(20).select(F.col("id").alias("recipe"))
    out = recommend.interleave(rows, [F.col("recipe")], rows.filter("recipe > 10"), "recipe", "s").collect()
    assert sorted(r.recipe for r in out) == list(range(20))
    placed = {r.position: r.recipe for r in out if r.position is not None}
    assert sorted(placed) == list(range(8)) and all(placed[i] > 10 for i in (3, 5, 7)) and [placed[i] for i in (0, 1, 2, 4, 6)] == [0, 1, 2, 3, 4]
    few = recommend.interleave(rows.limit(2), [F.col("recipe")], rows, "recipe", "s").collect()
    assert {r.recipe: r.position for r in few} == {0: 0, 1: 1}


def test_parsers_of_places_years_and_names(spark):
    place = lambda t: tuple(one(spark, parse.location_parts(F.lit(t))))
    assert place("Hybrid - Seattle, WA; Boston, MA") == ("Seattle", "WA", "United States", None)
    assert place("London, England") == ("London", None, "United Kingdom", None) and place("Remote") == (None, None, None, True)
    assert place("Toronto, ON, Canada (on-site)") == ("Toronto", "ON", "Canada", False) and place("Canada") == (None, None, "Canada", None)
    assert tuple(one(spark, parse.class_years(F.lit("Class of 2027 or 2029, req 1999"), 2026))) == (2027, 2029)
    assert tuple(one(spark, parse.class_years_of_description(F.lit("Founded in 2026. Rising seniors of 2028 apply. Call 2027."), 2026))) == (2028, 2028)
    assert tuple(one(spark, parse.term(F.lit("Intern 2027"), F.lit("Winter 2026"), 2026))) == ("winter", 2026)
    assert one(spark, urls.dedup_key(F.lit("https://jobs.lever.co/Acme/x1"), F.lit("acme"), F.lit("t"), F.lit(None), F.lit(None))) == "ats:lever:acme:x1"
    assert one(spark, urls.dedup_key(F.lit("https://x.org/1"), F.lit("acme"), F.lit("t"), F.lit("fall"), F.lit(None))) == "co:acme|t|fall-any"
    for given, want in {"Acme": True, "A": False, "42": False, "Unknown": False}.items():
        assert one(spark, text.is_company_name(F.lit(given), ["unknown"])) == want
    assert shown.graduation_year("Junior", 2026, 9) == 2028 and shown.graduation_year("senior", 2026, 3) == 2026 and shown.graduation_year("2031", 2026, 3) == 2031 and shown.graduation_year("1990", 2026, 3) is None


def test_stored_status_is_decoded_or_refused(spark):
    assert one(spark, tracking.decoded_status(F.lit("x"))) is None
    with pytest.raises(Exception, match="unknown status x"):
        one(spark, tracking.decoded_status(F.lit("x"), strict=True))
    assert one(spark, events.may_auto_apply(F.lit("oa"), F.lit(0.9), 0.8)) and not one(spark, events.may_auto_apply(F.lit("offer"), F.lit(0.9), 0.8)) and not one(spark, events.may_auto_apply(F.lit("oa"), F.lit(0.9), None))
    assert one(spark, classify.status_of(F.lit("rejection"))) == "rejected" and one(spark, classify.status_of(F.lit("outreach"))) is None


def test_file_readers_and_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ID,Name,Keywords\n2,Milk,\"dairy, white\"\n5,Eggs,\n7, milk ,\"fresh,dairy\"\n")
    products = spark.read.csv(str(tmp_path / "p.csv"), header=True, schema="ID int, Name string, Keywords string")
    rows = {r.name_lower: tuple(r)[1:] for r in files.catalog(products, "Name", "ID", "Keywords").collect()}
    assert rows["milk"] == ("Milk", [2, 7], ["dairy", "fresh", "white"]) and rows["eggs"][1] == [5]
    meal = spark.createDataFrame([("m", "Salt", " pinch", "Beef", None, " ")], "idMeal string, strIngredient1 string, strMeasure1 string, strIngredient2 string, strMeasure2 string, strIngredient3 string").withColumn("strMeasure3", F.lit(None).cast("string"))
    assert [tuple(r) for r in files.ingredients(meal, ["salt", "oil"], 3).collect()] == [("m", "Salt", "pinch", True), ("m", "Beef", None, False)]
    (tmp_path / "labels.csv").write_text("id,label\n# a note\n1,oa\n2,\n")
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "labels.csv"), "id int, label string").collect()] == [(1, "oa"), (2, None)]
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "a.md").write_text("---\ntitle: A\n---\nBody")
    assert [r.slug for r in files.read_markdown(spark, str(tmp_path / "posts")).collect()] == ["a"]
    head = "---\ntitle: {}\n---\n"
    for name, text in (("long", head.format("t" * 201) + "x"), ("limit", head.format("字" * 200) + "é" * 100_000), ("body", head.format("t") + "x" * 100_001), ("blank", head.format("t") + " \n"), ("huge", "x" * (files.MOST_BYTES + 1)), ("README", "x" * (files.MOST_BYTES + 1))):
        (tmp_path / "posts" / f"{name}.md").write_text(text)
    read = files.read_markdown(spark, str(tmp_path / "posts"))
    assert {r.slug: r.error for r in read.collect()} == {"a": None, "long": "title too long", "limit": None, "body": "body too long", "blank": "no body", "huge": "file too large"}
    assert "LessThanOrEqual(length" in read._jdf.queryExecution().toString()
    frame = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    files.write_csv(frame, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_suggestions_of_equal_score_come_by_source(spark):
    rows = spark.createDataFrame([("milk a", [], 1, 2), ("milk b", [], 2, 1), ("milk c", [], 3, 1)], "name string, aliases array<string>, at int, source int")
    assert [(r.name, r.source) for r in matching.suggest_with_aliases(rows, "milk", 2).collect()] == [("milk b", 1), ("milk c", 1)]


def test_html_is_read_with_all_entities(spark):
    assert one(spark, text.strip_html(F.lit("<p>caf&eacute; &#8211; &amp;lt; <script>x</script>end"))) == "cafe – &lt; end"


def test_sole_best_refuses_ties(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 0.9), ("b", "y", 0.8)], "r string, t string, s double")
    assert [(r.r, r.t) for r in matching.sole_best(rows, "r", "s", "t").collect()] == [("b", "x")]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
