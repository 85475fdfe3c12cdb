"""Quality gate of ingested postings: accepted, filtered (valid, out of scope) or rejected (defective)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.text import company_key, has_phrase

# Phrases that make a title an internship; a software role; an engineering role; and disciplines
# that make an engineering role no software role.
INTERN = [
    "intern", "interns", "internship", "internships", "interning", "co op", "coop", "apprentice", "apprenticeship",
    "industrial placement", "placement student", "trainee",
]
SOFTWARE = [
    "software", "swe", "sde", "developer", "programmer", "programming", "computer science", "frontend", "front end",
    "backend", "back end", "fullstack", "full stack", "web development", "web developer", "devops", "site reliability",
    "sre", "machine learning", "compiler", "distributed systems", "ios", "android", "cybersecurity",
    "security engineering", "platform engineering", "infrastructure engineering",
]
ENGINEERING = ["engineer", "engineers", "engineering"]
OTHER = [
    "mechanical", "chemical", "civil", "electrical", "industrial", "aerospace", "aeronautical", "biomedical", "petroleum",
    "structural", "environmental", "manufacturing", "materials", "nuclear", "sales", "field", "hardware", "packaging",
    "mining", "geotechnical", "automotive", "marine", "agricultural",
]


def gate(raw: DataFrame, wrong_term: str = "false") -> DataFrame:
    """Adds qc_kind, qc_reason, qc_field; tested in a fixed order, the first failure counts."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    other = has_phrase(F.col("title"), OTHER)
    software = has_phrase(F.col("title"), SOFTWARE) | (has_phrase(F.col("title"), ENGINEERING) & ~other)
    steps = [
        ("rejected", "missing_source", "source", blank("source")),
        ("rejected", "missing_external_id", "external_id", blank("external_id")),
        ("rejected", "missing_url", "url", blank("url")),
        ("rejected", "not_http", "url", ~F.lower("url").rlike("^https?://")),
        ("rejected", "missing_company", "company", blank("company") | (company_key(F.col("company")) == "")),
        ("rejected", "missing_title", "title", blank("title")),
        ("filtered", "not_an_internship", "title", ~has_phrase(F.col("title"), INTERN)),
        ("filtered", "not_software", "title", ~software),
        ("filtered", "wrong_term", "term", F.coalesce(F.expr(wrong_term), F.lit(False))),
    ]
    outcome = F.struct(F.lit("accepted").alias("kind"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("field"))
    for kind, reason, field, test in reversed(steps):
        outcome = F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), F.lit(field).alias("field"))).otherwise(outcome)
    return raw.withColumn("_qc", outcome).withColumns({"qc_kind": F.col("_qc.kind"), "qc_reason": F.col("_qc.reason"), "qc_field": F.col("_qc.field")}).drop("_qc")


def sampled_rejects(rejects: DataFrame, run: str, order: list[str], most: int = 20) -> DataFrame:
    """All rejected rows and the first ``most`` filtered ones of each run and reason (all, if not positive)."""
    if most <= 0:
        return rejects
    nth = F.row_number().over(W.partitionBy(run, "qc_reason").orderBy(*order))
    return rejects.filter("qc_kind = 'rejected'").unionByName(rejects.filter("qc_kind = 'filtered'").withColumn("_n", nth).filter(F.col("_n") <= most).drop("_n"))


def violations(postings: DataFrame) -> DataFrame:
    """Counts of rows that break an integrity rule: one row."""
    c = F.col
    return postings.agg(
        F.count_if(c("pay_min").isNotNull() & (c("currency").isNull() | c("period").isNull())).alias("pay_without_unit"),
        F.count_if(c("pay_max") < c("pay_min")).alias("pay_reversed"),
        F.count_if(c("pay_min") < 0).alias("pay_negative"),
        F.count_if(c("class_max") < c("class_min")).alias("class_reversed"),
        F.count_if(c("expired_at").isNull() != c("expiry_reason").isNull()).alias("expiry_incomplete"),
    )
