"""URL identity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _split(c: Column) -> tuple[Column, Column]:
    """(lower-case host without www., path) without scheme, query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "^https?://", ""), "[?#].*$", "")
    host = F.regexp_replace(F.lower(F.split_part(bare, F.lit("/"), F.lit(1))), r"^(www\.)+", "")
    return host, F.regexp_extract(bare, "^[^/]*/(.*)$", 1)


def canonical_url(c: Column) -> Column:
    """Host and path that identify a posting: no tracking, no closing action words, no locale segments."""
    host, path = _split(c)
    board = host.rlike(r"^(boards|job-boards)\..*\.greenhouse\.io$|^(boards|job-boards)\.greenhouse\.io$")
    host = F.when(board, F.lit("job-boards.greenhouse.io")).otherwise(host)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", ""), "(^|/)(apply|application)(/(apply|application))*$", "")
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike("^[a-z]{2}[-_][A-Za-z]{2}$"))
    path = F.array_join(kept, "/")
    path = F.when(host == "job-boards.greenhouse.io", F.lower(path)).otherwise(path)
    return F.when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))


def query_value(c: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(c, rf"[?&]{key}=([^&#]*)", 1), F.lit(""))


def ats_identity(c: Column) -> Column:
    """``system:board:job`` of the job boards that number their postings; null elsewhere."""
    host, path = _split(c)
    part = lambda i: F.split_part(path, F.lit("/"), F.lit(i))
    joined = lambda system, board, job: F.when((board != "") & (job != ""), F.concat_ws(":", F.lit(system), F.lower(board), job))
    number = F.coalesce(F.nullif(F.regexp_extract(path, r"jobs/(\d+)", 1), F.lit("")), query_value(c, "gh_jid"))
    return (
        F.when(host.rlike(r"greenhouse\.io$"), joined("greenhouse", F.coalesce(query_value(c, "for"), part(1)), F.coalesce(number, query_value(c, "token"), F.lit(""))))
        .when(host == "jobs.lever.co", joined("lever", part(1), part(2)))
        .when(host == "jobs.ashbyhq.com", joined("ashby", part(1), part(2)))
        .when(host == "jobs.smartrecruiters.com", joined("smartrecruiters", part(1), F.regexp_extract(part(2), r"^\d+", 0)))
        .when(host == "apply.workable.com", joined("workable", part(1), F.when(part(2) == "j", part(3)).otherwise(part(2))))
        .when(host == "ats.rippling.com", joined("rippling", part(1), F.when(part(2) == "jobs", part(3)).otherwise(part(2))))
        .when(host.rlike(r"\.myworkdayjobs\.com$"), joined("workday", F.split_part(host, F.lit("."), F.lit(1)), F.regexp_extract(path, r"_([A-Za-z]*-?\d+)(-\d+)?$", 1)))
        .when(query_value(c, "gh_jid").isNotNull(), joined("greenhouse", host, query_value(c, "gh_jid")))
    )


def dedup_key(url: Column, company: Column, title: Column, season: Column, year: Column) -> Column:
    """The board's own identity where there is one, else company, title and term."""
    term = F.concat_ws("-", F.coalesce(season, F.lit("any")), F.coalesce(year.cast("string"), F.lit("any")))
    return F.coalesce(F.concat(F.lit("ats:"), ats_identity(url)), F.concat(F.lit("co:"), F.concat_ws("|", company, title, term)))
