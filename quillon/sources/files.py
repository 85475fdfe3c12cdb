"""Files with front matter, catalogs and labelled sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRONT_KEYS = ("title", "slug", "date", "published", "summary")
#: Characters of a title and of a body at most; a file of more bytes cannot keep to that and is not read.
MOST_TITLE, MOST_BODY = 200, 100_000
MOST_BYTES = 4 * (MOST_TITLE + MOST_BODY) + (1 << 16)


def front_matter(files: DataFrame) -> DataFrame:
    """slug, title, body, parsed, error of Markdown files (columns path, text) with ``key: value`` front matter.

    A byte order mark and CRLF are tolerated; a README is skipped; an unknown or repeated key is an error, and so are a body
    that is blank and a title or body that is too long.
    """
    text = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n", "\n")
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    rows = files.filter(~F.lower("path").rlike(r"(^|/)readme\.md$")).select("path", text.alias("text"), name.alias("stem"))
    head = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda line: F.trim(line) != ""), lambda line: F.struct(F.trim(F.split_part(line, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("v")))
    rows = rows.withColumn("_p", pairs).withColumn("_k", F.transform("_p", lambda p: p["k"]))
    value = lambda k: F.nullif(F.get(F.filter("_p", lambda p: p["k"] == k), F.lit(0))["v"], F.lit(""))
    error = (
        F.when(head == "", "no front matter").when(F.size("_k") != F.size(F.array_distinct("_k")), "repeated key")
        .when(F.size(F.array_except("_k", F.array(*map(F.lit, FRONT_KEYS)))) > 0, "unknown key").when(value("title").isNull(), "no title")
    )
    body = F.regexp_replace("text", r"(?s)\A---\n.*?\n---(\n|\z)", "")
    error = F.coalesce(error, F.when(F.length(value("title")) > MOST_TITLE, "title too long").when(body.rlike(r"^\s*$"), "no body").when(F.length(body) > MOST_BODY, "body too long"))
    return rows.select("path", F.coalesce(value("slug"), F.col("stem")).alias("slug"), value("title").alias("title"), body.alias("body"), error.isNull().alias("parsed"), error.alias("error"))


def read_markdown(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Markdown files below ``path``, through Spark's readers; of a file beyond ``most_bytes`` only its name is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    # The filter on length reaches the reader, which leaves larger files alone.
    posts = front_matter(found.filter(F.col("length") <= most_bytes).select("path", F.decode("content", "UTF-8").alias("text")))
    large = found.filter((F.col("length") > most_bytes) & ~F.lower("path").rlike(r"(^|/)readme\.md$")).select("path")
    nothing = F.lit(None).cast("string")
    rejected = large.select("path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("slug"), nothing.alias("title"), nothing.alias("body"), F.lit(False).alias("parsed"), F.lit("file too large").alias("error"))
    return posts.unionByName(rejected)


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and ``#`` comment lines."""
    return spark.read.option("header", True).option("comment", "#").schema(schema).csv(path)


def catalog(rows: DataFrame, name: str, product: str, keywords: str) -> DataFrame:
    """One row per lower-case name: the first display name, product ids in order, distinct keywords."""
    split = F.filter(F.transform(F.split(F.lower(keywords), ","), lambda k: F.trim(k)), lambda k: k != "")
    key = F.lower(F.trim(name))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(product).alias("id"), F.trim(name).alias("name"), split.alias("keys"))))
    one = rows.groupBy(key.alias("name_lower")).agg(ordered.alias("all"))
    return one.select("name_lower", F.element_at("all", 1)["name"].alias("name"), F.transform("all", lambda x: x["id"]).alias("product_ids"), F.array_sort(F.array_distinct(F.flatten(F.transform("all", lambda x: x["keys"])))).alias("aliases"))


def ingredients(recipes: DataFrame, staples: list[str], n: int = 20) -> DataFrame:
    """recipe, name, measure, staple: the numbered ingredient columns as rows, blanks left out."""
    pairs = F.array(*[F.struct(F.trim(f"strIngredient{i}").alias("name"), F.trim(f"strMeasure{i}").alias("measure")) for i in range(1, n + 1)])
    rows = recipes.select(F.col("idMeal").alias("recipe"), F.explode(F.filter(pairs, lambda p: F.coalesce(p["name"], F.lit("")) != "")).alias("p"))
    staple = F.lower("p.name").rlike("|".join(staples)) if staples else F.lit(False)
    return rows.select("recipe", "p.name", "p.measure", staple.alias("staple"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
