"""Job boards' JSON, feeds and pages as one shape of raw postings.

Each reader takes a DataFrame with a text column ``body`` (one payload a row, of
``spark.read.text(..., wholetext=True)``) and returns ``RAW`` columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import first_string, unescape

RAW = ("source", "external_id", "url", "company", "title", "location", "pay_text", "posted_text", "deadline_text", "is_remote", "raw_json")


def _raw(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    columns["source"] = F.lit(source)
    return df.select(*[columns.get(c, F.lit(None)).cast("boolean" if c == "is_remote" else "string").alias(c) for c in RAW])


def _items(payloads: DataFrame, schema: str, field: str | None) -> DataFrame:
    kept = [c for c in payloads.columns if c != "body"]
    parsed = payloads.select(*kept, F.from_json("body", schema).alias("b"))
    return parsed.select(*kept, F.col("b").alias("board") if field else F.lit(None).alias("board"), F.explode(F.col(f"b.{field}") if field else F.col("b")).alias("j"))


def greenhouse(payloads: DataFrame) -> DataFrame:
    """``{jobs: [...]}``; without jobs no row. Cents become "USD a - b", no period; further ranges are counted."""
    schema = """struct<jobs:array<struct<id:bigint,absolute_url:string,title:string,company_name:string,location:struct<name:string>,
      first_published:string,updated_at:string,application_deadline:string,pay_input_ranges:array<struct<min_cents:bigint,max_cents:bigint,currency_type:string>>>>>"""
    j = _items(payloads, schema, "jobs")
    ranges = F.col("j.pay_input_ranges")
    first = F.get(ranges, F.lit(0))
    amount = lambda c: F.format_string("%.2f", c / 100)
    pay = F.concat(first["currency_type"], F.lit(" "), amount(first["min_cents"]), F.lit(" - "), amount(first["max_cents"]))
    more = F.size(ranges) - 1
    pay = F.when(more > 0, F.concat(pay, F.lit(" [+"), more.cast("string"), F.lit(" more published ranges]"))).otherwise(pay)
    return _raw(
        j, "greenhouse", external_id=F.col("j.id"), url=F.col("j.absolute_url"), company=F.col("j.company_name"), title=F.col("j.title"), location=F.col("j.location.name"), pay_text=pay,
        posted_text=F.coalesce("j.first_published", "j.updated_at"), deadline_text=F.col("j.application_deadline"), raw_json=F.to_json("j"),
    )


def lever(payloads: DataFrame) -> DataFrame:
    """A bare array; ``company`` is a column of the payloads, as the page does not name it."""
    schema = """array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:bigint,workplaceType:string,
      categories:struct<location:string,allLocations:array<string>>,salaryRange:struct<min:double,max:double,currency:string,interval:string>>>"""
    j = _items(payloads, schema, None)
    s = F.col("j.salaryRange")
    pay = F.when(s.isNotNull(), F.concat_ws(" ", s["currency"], F.format_string("%.2f - %.2f", s["min"], s["max"]), F.regexp_extract(s["interval"], "(hour|month|year)", 1)))
    remote = F.when(F.lower("j.workplaceType") == "remote", True).when(F.lower("j.workplaceType").isin("onsite", "on-site", "hybrid"), False)
    places = F.coalesce(F.nullif(F.array_join("j.categories.allLocations", "; "), F.lit("")), F.col("j.categories.location"))
    company = F.col("company") if "company" in payloads.columns else F.lit(None)
    return _raw(j, "lever", external_id=F.col("j.id"), url=F.coalesce("j.hostedUrl", "j.applyUrl"), company=company, title=F.col("j.text"), location=places, pay_text=pay, posted_text=F.col("j.createdAt"), is_remote=remote, raw_json=F.to_json("j"))


#: Rows of a full page, and pages that are asked for at most.
PAGE_ROWS, MOST_PAGES = 100, 20


def more_pages(rows_of_last: int, pages: int) -> bool:
    """Is another page to be asked for? A short page is the last one."""
    return rows_of_last >= PAGE_ROWS and pages < MOST_PAGES


def ashby(payloads: DataFrame) -> DataFrame:
    """Pay is the first Salary component with a minimum; interval NONE is no period. Further places are names or objects with one."""
    schema = """struct<jobs:array<struct<id:string,title:string,location:string,secondaryLocations:array<string>,publishedAt:string,isRemote:boolean,jobUrl:string,
      compensation:struct<summaryComponents:array<struct<compensationType:string,minValue:double,maxValue:double,currencyCode:string,interval:string>>>>>>"""
    j = _items(payloads, schema, "jobs")
    s = F.get(F.filter("j.compensation.summaryComponents", lambda x: (x["compensationType"] == "Salary") & x["minValue"].isNotNull()), F.lit(0))
    period = F.when(s["interval"] != "NONE", F.lower(F.regexp_extract(s["interval"], "(HOUR|MONTH|YEAR)", 1)))
    pay = F.when(s.isNotNull(), F.concat_ws(" ", s["currencyCode"], F.format_string("%.2f - %.2f", s["minValue"], s["maxValue"]), period))
    company = F.col("company") if "company" in payloads.columns else F.lit(None)
    # An object in an array of strings is read as its JSON text.
    more = F.transform(F.coalesce("j.secondaryLocations", F.array().cast("array<string>")), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.location")).otherwise(x))
    places = F.array_join(F.filter(F.concat(F.array("j.location"), more), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), "; ")
    return _raw(j, "ashby", external_id=F.col("j.id"), url=F.col("j.jobUrl"), company=company, title=F.col("j.title"), location=F.nullif(places, F.lit("")), pay_text=pay, posted_text=F.col("j.publishedAt"), is_remote=F.col("j.isRemote"), raw_json=F.to_json("j"))


def workable(payloads: DataFrame) -> DataFrame:
    """The company is the board's name; the URL is made of the shortcode."""
    schema = """struct<name:string,jobs:array<struct<title:string,shortcode:string,telecommuting:boolean,published_on:string,created_at:string,
      city:string,state:string,country:string,locations:array<struct<city:string,region:string,country:string>>>>>"""
    j = _items(payloads, schema, "jobs")
    place = lambda x: F.concat_ws(", ", x["city"], x["region"], x["country"])
    many = F.nullif(F.array_join(F.transform("j.locations", place), "; "), F.lit(""))
    return _raw(
        j, "workable", external_id=F.col("j.shortcode"), url=F.concat(F.lit("https://apply.workable.com/j/"), F.col("j.shortcode")), company=F.col("board.name"), title=F.col("j.title"),
        location=F.coalesce(many, F.nullif(F.concat_ws(", ", "j.city", "j.state", "j.country"), F.lit(""))), posted_text=F.coalesce("j.published_on", "j.created_at"), is_remote=F.col("j.telecommuting"), raw_json=F.to_json("j"),
    )


_LISTS = "array<struct<id:string,active:boolean,url:string,company_name:string,title:string,locations:array<string>,terms:array<string>,season:string,date_posted:bigint>>"


def listings(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open postings, ids of closed ones) of a community list; the term is added to the title."""
    j = _items(payloads, _LISTS, None)
    terms = F.nullif(F.array_join(F.filter("j.terms", lambda t: t != "N/A"), ", "), F.lit(""))
    term = F.coalesce(terms, F.col("j.season"))
    rows = _raw(
        j.filter("coalesce(j.active, true)"), "listings", external_id=F.col("j.id"), url=F.col("j.url"), company=F.col("j.company_name"), title=F.concat_ws(" ", "j.title", F.concat(F.lit("("), term, F.lit(")"))),
        location=F.array_join("j.locations", "; "), posted_text=F.col("j.date_posted"), raw_json=F.to_json("j"),
    )
    return rows, j.filter("NOT j.active").select(F.lit("listings").alias("source"), F.col("j.id").alias("external_id"))


def json_ld(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """schema.org JobPosting objects of pages' ld+json scripts: alone, in an array or in @graph."""
    posting = "struct<`@type`:string,title:string,identifier:string,url:string,hiringOrganization:struct<name:string>,datePosted:string,validThrough:string,baseSalary:string,jobLocation:string>"
    script = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script"), 1))
    blocks = pages.select(F.col(url).alias("page_url"), script.alias("s"))
    many = F.from_json("s", f"array<{posting}>")
    graph = F.from_json("s", f"struct<`@graph`:array<{posting}>>")["@graph"]
    j = blocks.select("page_url", F.explode(F.concat(F.coalesce(many, F.array().cast(f"array<{posting}>")), F.coalesce(graph, F.array().cast(f"array<{posting}>")))).alias("j")).filter("j.`@type` = 'JobPosting'")
    amount = lambda k: F.coalesce(F.get_json_object("j.baseSalary", f"$.value.{k}"))
    pay = F.nullif(F.concat_ws(" ", F.get_json_object("j.baseSalary", "$.currency"), F.concat_ws(" - ", F.coalesce(amount("minValue"), amount("value")), amount("maxValue")), F.lower(amount("unitText"))), F.lit(""))
    address = lambda k: F.coalesce(F.get_json_object("j.jobLocation", f"$[0].address.{k}"), F.get_json_object("j.jobLocation", f"$.address.{k}"))
    place = F.nullif(F.concat_ws(", ", address("addressLocality"), address("addressRegion"), address("addressCountry")), F.lit(""))
    return _raw(j, "json_ld", external_id=first_string(F.col("j.identifier"), F.col("j.url"), F.col("page_url")), url=first_string(F.col("j.url"), F.col("page_url")), company=F.col("j.hiringOrganization.name"), title=F.col("j.title"), location=place, pay_text=pay, posted_text=F.col("j.datePosted"), deadline_text=F.col("j.validThrough"), raw_json=F.to_json("j"))


def feed(payloads: DataFrame, source: str = "feed") -> DataFrame:
    """RSS items and Atom entries; "Company: Title" is split; of a repeated field the first counts."""
    item = F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<(?:\w+:)?(?:item|entry)\b[^>]*>(.*?)</(?:\w+:)?(?:item|entry)>"), 1))
    items = payloads.select(item.alias("i"))

    def field(*names: str) -> Column:
        found = [F.nullif(F.trim(F.regexp_extract("i", rf"(?is)<(?:\w+:)?{n}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{n}>", 1)), F.lit("")) for n in names]
        return unescape(F.coalesce(*found))

    title = field("title")
    posted = F.regexp_replace(field("pubDate", "published", "updated"), "^[A-Za-z]{3}, ", "")
    stamp = F.coalesce(F.try_to_timestamp(posted, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(posted, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(posted))
    company = F.when(title.contains(":"), F.trim(F.split_part(title, F.lit(":"), F.lit(1))))
    role = F.when(title.contains(":"), F.trim(F.regexp_replace(title, "^[^:]*:", ""))).otherwise(title)
    link = F.coalesce(field("link"), F.nullif(F.regexp_extract("i", r'(?is)<link\b[^>]*href="([^"]*)"', 1), F.lit("")))
    return _raw(items, source, external_id=F.coalesce(field("guid", "id"), link), url=link, company=company, title=role, location=field("region", "location"), posted_text=F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ssXXX"), raw_json=F.col("i"))


def together(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def boards_of(urls: DataFrame, url: str) -> DataFrame:
    """(ats, slug) of the boards that URLs point to."""
    host, path = F.parse_url(F.col(url), F.lit("HOST")), F.ltrim(F.parse_url(F.col(url), F.lit("PATH")), F.lit("/"))
    first = F.url_decode(F.split_part(path, F.lit("/"), F.lit(1)))
    sub = F.split_part(host, F.lit("."), F.lit(1))
    ats = (
        F.when(host.endswith("greenhouse.io"), "greenhouse").when(host == "jobs.lever.co", "lever").when(host == "jobs.ashbyhq.com", "ashby").when(host == "apply.workable.com", "workable")
        .when(host.endswith(".recruitee.com"), "recruitee").when(host.endswith(".myworkdayjobs.com"), "workday")
    )
    slug = F.when(ats == "recruitee", sub).when(ats == "workday", F.concat_ws(".", sub, F.split_part(host, F.lit("."), F.lit(2)))).otherwise(F.lower(first))
    return urls.select(ats.alias("ats"), slug.alias("slug")).filter("ats IS NOT NULL AND slug <> ''").distinct()
