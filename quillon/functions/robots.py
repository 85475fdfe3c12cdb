"""What a robots file permits, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def robots_rules(text: Column, agent: str = "*") -> Column:
    """array<struct<pattern, allow>> of the groups for ``agent``, in order.

    Consecutive agent lines head one group; comments, empty values and other fields are left out.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.trim(F.regexp_replace(line, "#.*$", "")))
    fields = F.transform(
        F.filter(lines, lambda line: line.contains(":")),
        lambda line: F.struct(F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("v")),
    )
    nothing = F.array().cast("array<struct<pattern:string,allow:boolean>>")
    start = F.struct(F.lit(False).alias("ours"), F.lit(False).alias("head"), nothing.alias("rules"))

    def step(seen: Column, field: Column) -> Column:
        named, rule = field["k"] == "user-agent", field["k"].isin("allow", "disallow") & (field["v"] != "")
        ours = F.when(named, (seen["head"] & seen["ours"]) | (field["v"] == agent)).otherwise(seen["ours"])
        more = F.array(F.struct(field["v"].alias("pattern"), (field["k"] == "allow").alias("allow")))
        return F.struct(ours.alias("ours"), named.alias("head"), F.when(seen["ours"] & rule, F.concat(seen["rules"], more)).otherwise(seen["rules"]).alias("rules"))

    return F.aggregate(fields, start, step, lambda seen: seen["rules"])


def _matches(pattern: Column, path: Column) -> Column:
    """The first part at the path's start, each part behind a ``*`` where it comes next; with ``$`` at the end nothing after the last."""
    parts = F.split(F.regexp_replace(pattern, r"[$]$", ""), "[*]")
    quoted = F.transform(parts, lambda part: F.regexp_replace(part, r"([^A-Za-z0-9])", r"\\$1"))
    later = F.filter(F.slice(quoted, F.lit(2), F.size(quoted)), lambda part: part != "")
    found = F.array_join(F.transform(later, lambda part: F.concat(F.lit("(?>.*?"), part, F.lit(")"))), "")
    return F.call_function("rlike", path, F.concat(F.lit("(?s)^"), F.get(quoted, F.lit(0)), found, F.when(pattern.endswith("$"), r"\z").otherwise("")))


def robots_decision(rules: Column, path: Column) -> Column:
    """struct<allow, pattern> of the rule that decides: the longest pattern that matches, of equal ones one that allows; null if none does."""
    fit = F.filter(rules, lambda r: _matches(r["pattern"], path))
    ranked = F.transform(fit, lambda r: F.struct(F.octet_length(r["pattern"]).alias("n"), r["allow"].alias("allow"), (-F.array_position(rules, r)).alias("at"), r["pattern"].alias("pattern")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct(best["allow"].alias("allow"), best["pattern"].alias("pattern")))


def robots_permit(rules: Column, path: Column) -> Column:
    return F.coalesce(robots_decision(rules, path)["allow"], F.lit(True))
