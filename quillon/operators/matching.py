"""Fuzzy, dictionary and identity matching: blocked, then scored."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.fuzzy import similarity, suggestion_score
from quillon.functions.text import phrase
from quillon.session import materialize


def by_identity(rows: DataFrame, targets: DataFrame, keys: list[str], row_id: str, target_id: str) -> DataFrame:
    """First hit over several keys in order of trust: one equi-join per key, never an OR join.

    ``rows`` and ``targets`` hold the key columns; null keys match nothing. Of a key's targets the least is what can be
    hit, so a row meets one target a key, however many share it.
    """
    found = rows.select(row_id, *keys)
    for i, key in enumerate(keys):
        least = targets.groupBy(F.col(key).alias(f"_key{i}")).agg(F.min(target_id).alias(f"_least{i}"))
        found = found.join(least, F.col(key) == F.col(f"_key{i}"), "left")
    hits = [F.when(F.col(f"_key{i}").isNotNull(), F.struct(F.lit(i).alias("nth_key"), F.col(f"_least{i}").alias(target_id))) for i in range(len(keys))]
    hit = found.select(row_id, F.coalesce(*hits).alias("m")).filter("m IS NOT NULL")
    return hit.groupBy(row_id).agg(F.min("m").alias("m")).select(row_id, f"m.{target_id}", "m.nth_key")


#: So many names at most are broadcast; more are joined by a shuffle of both sides.
MOST_BROADCAST = 100_000


def mentions(texts: DataFrame, text_id: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Per text the longest of ``names`` that it holds as whole words.

    Names and texts meet on a name's first word. Of a text go on only its starts:
    a word and the few after it that the longest name can need, never the text itself.
    """
    words = lambda c: F.split(F.trim(phrase(c)), " ")
    keyed = names.select(F.col(name).alias("name"), words(F.col(name)).alias("_words")).filter("_words[0] <> ''")
    keyed = keyed.groupBy("_words").agg(F.max("name").alias("name")).withColumn("_first", F.get("_words", F.lit(0)))
    found = keyed.agg(F.count(F.lit(1)), F.max(F.size("_words"))).first()
    longest = found[1] or 1
    shifted = [F.slice("_all", F.lit(k + 1), F.greatest(F.size("_all") - k, F.lit(0))).alias(f"w{k}") for k in range(longest)]
    starts = texts.select(text_id, words(F.col(text)).alias("_all")).select(text_id, F.explode(F.arrays_zip(*shifted)).alias("_start"))
    same = F.lit(True)
    for k in range(1, longest):
        same = same & ((F.size("_words") <= k) | F.coalesce(F.get("_words", F.lit(k)) == F.col(f"_start.w{k}"), F.lit(False)))
    side = F.broadcast(keyed) if found[0] <= MOST_BROADCAST else keyed.hint("merge")
    hits = starts.join(side, F.col("_start.w0") == F.col("_first")).filter(same)
    return hits.groupBy(text_id).agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"))


#: Keys of a string for one partner length at most, about, letters in a key at most, and letters whose order of frequency counts.
KEYS, IN_KEY, LETTERS = 64, 4, 4096
_SLACK = 1e-9


def _shared_at_least(length: int, least: float) -> int:
    """Letters that a string of this length has in common with any that is similar enough: an edit spoils one, a swap none."""
    return max(1, math.ceil(least * length - _SLACK))


def _in_key(length: int, least: float) -> int:
    """How many letters make a key for strings of this length, so that their number stays near KEYS."""
    shared = _shared_at_least(length, least)
    return max([n for n in range(1, min(IN_KEY, shared) + 1) if math.comb(length - shared + n, n) <= KEYS], default=1)


def _edits(length, least: float):
    """Edits that strings may be apart if the longer has this length; a number or a column."""
    if isinstance(length, Column):
        return F.floor((1 - least) * length + _SLACK).cast("int")
    return math.floor((1 - least) * length + _SLACK)


def _one_edit_length(least: float) -> float:
    """The greatest length up to which similar strings are one edit apart at most."""
    if 1 - least <= _SLACK:
        return math.inf
    n = int(2 / (1 - least)) + 1
    while _edits(n, least) > 1:
        n -= 1
    return n


def _one_less(strings: DataFrame, least: float) -> DataFrame:
    """(t, key): a string and each string that is one letter less, where that many edits are allowed, as 64-bit hashes.

    Strings one edit apart, or with two neighbours swapped, share one of these, and hardly any other strings do.
    """
    n = F.length("t")
    made = F.transform(F.sequence(F.when(_edits(n, least) >= 1, 0).otherwise(n), n), lambda i: F.xxhash64(F.concat(F.substr("t", F.lit(1), i), F.substr("t", i + 2))))
    return strings.filter(_edits(n + 1, least) >= 1).select("t", F.explode(F.array_distinct(made)).alias("key"))


def _letter_keys(rank: dict[str, int], least: float, probe: bool, above: float = 0, others: set[int] | None = None):
    """Keys of strings: sets of their rarest letters, one of which two similar strings share.

    Of two strings that share s letters (repeated ones numbered), the first length - s + n in any one order have n in
    common. So the n-letter subsets of these are keys. An indexed string has keys of its own length; a probe has keys
    for each length that a similar string can have. Only pairs of which the longer string is longer than ``above`` are
    sought, and partners of the lengths ``others``, if told.
    """

    def keys(text: str) -> set[str]:
        seen: dict[str, int] = {}
        letters = []
        for c in text:
            seen[c] = seen.get(c, 0) + 1
            letters.append((rank.get(c, -1), c, seen[c]))
        letters = [f"{c}{n}" for _, c, n in sorted(letters)]
        n = len(letters)
        lengths = [x for x in range(_shared_at_least(n, least), int((n + _SLACK) / least) + 1) if max(n, x) > above and (others is None or x in others)]
        out = set()
        for other in lengths if probe else [n] if lengths else []:
            shared, size = _shared_at_least(max(n, other), least), _in_key(other, least)
            out.update(f"{other} {''.join(x)}" for x in combinations(letters[: n - shared + size], size))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                found = [(t, k) for t in batch.iloc[at : at + 256, 0] for k in keys(t)]
                yield pd.DataFrame(found, columns=["t", "key"])

    return run


def fuzzy_companies(rows: DataFrame, row_key: str, known: DataFrame, known_key: str, least: float = 0.9) -> DataFrame:
    """(row_key, known_key, score) of all pairs with an edit similarity of ``least`` (above 0) or more; equal keys score 1.

    Equal strings meet by themselves, and those so short that one edit is the most under what is left of them without
    a letter. Longer ones meet under keys of rare letters. All keys follow from ``least`` and miss no pair; what meets
    is tested by length and by a plain edit distance first, then by the similarity itself.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    a = rows.select(F.col(row_key).alias("t")).filter("t IS NOT NULL AND t <> ''").distinct()
    b = known.select(F.col(known_key).alias("t")).filter("t IS NOT NULL AND t <> ''").distinct()
    equal = a.join(b, "t").select(F.col("t").alias("_a"), F.col("t").alias("_b"), F.lit(1.0).alias("score"))
    near = _one_edit_length(least)
    short = F.length("t") <= near
    left, right = (_one_less(x.filter(short) if near < math.inf else x, least) for x in (a, b))
    # keys are many times the strings, which Spark's estimates don't see: no side is broadcast
    pairs = left.withColumnRenamed("t", "_a").join(right.withColumnRenamed("t", "_b").hint("merge"), "key").filter("_a <> _b").select("_a", "_b")
    sizes = rows.select(F.length(row_key).alias("n"), F.lit(True).alias("probe")).distinct().union(known.select(F.length(known_key), F.lit(False)).distinct())
    sizes = [r for r in sizes.filter("n > 0").collect()]
    by_rows, by_known = ({r.n for r in sizes if r.probe == side} for side in (True, False))
    if any(max(x, y) > near and min(x, y) >= _shared_at_least(max(x, y), least) for x in by_rows for y in by_known):
        letters = b.select(F.explode(F.split("t", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(LETTERS)
        rank = {r.c: i for i, r in enumerate(reversed(letters.collect()))}  # rare letters first, unknown ones before all
        left = a.mapInPandas(_letter_keys(rank, least, True, near, by_known), "t string, key string").withColumnRenamed("t", "_a")
        right = b.mapInPandas(_letter_keys(rank, least, False, near, by_rows), "t string, key string").withColumnRenamed("t", "_b")
        pairs = pairs.union(left.join(right.hint("merge"), "key").filter("_a <> _b").select("_a", "_b"))
    longer = F.greatest(F.length("_a"), F.length("_b"))
    edits = _edits(longer, least)
    close = pairs.distinct().filter(longer - F.least(F.length("_a"), F.length("_b")) <= edits).withColumn("_plain", F.levenshtein("_a", "_b"))
    close = close.filter(F.col("_plain") <= 2 * edits)  # a swap is two edits where swaps are not known
    swapped = lambda c: F.when(F.col("_plain") > 1, F.col(c))  # noqa: E731  one plain edit is one in any case
    scored = close.withColumn("score", F.when(F.col("_plain") == 1, 1 - 1 / longer).otherwise(similarity(swapped("_a"), swapped("_b"))))
    return scored.select("_a", "_b", "score").filter(F.col("score") >= least).union(equal).toDF(row_key, known_key, "score")


def sole_best(scored: DataFrame, row: str, score: str, target: str) -> DataFrame:
    """The best target of each row; rows whose best score is shared by two targets match nothing."""
    best = scored.withColumn("_best", F.max(score).over(W.partitionBy(row))).filter(F.col(score) == F.col("_best"))
    return best.groupBy(row).agg(F.countDistinct(target).alias("_n"), F.min(target).alias(target)).filter("_n = 1").drop("_n")


def prefix_match(rows: DataFrame, row_key: str, known: DataFrame, known_key: str, least: int = 6) -> DataFrame:
    """The longest known key that a row's key begins with; both share the first ``least`` letters."""
    a = rows.select(F.col(row_key).alias("_a")).distinct().withColumn("_p", F.substring("_a", 1, least))
    b = known.select(F.col(known_key).alias("_b")).distinct().filter(F.length("_b") >= least).withColumn("_p", F.substring("_b", 1, least))
    hit = a.join(b, "_p").filter(F.startswith("_a", F.col("_b")))
    return hit.groupBy("_a").agg(F.max_by("_b", F.length("_b")).alias("_b")).toDF(row_key, known_key)


def within(a: DataFrame, b: DataFrame, keys: list[str], at_a: str, at_b: str, seconds: int) -> DataFrame:
    """Tolerance join |at_a - at_b| <= seconds within equal keys: equi-join on time buckets, three per row."""
    ms = seconds * 1000
    left = a.withColumn("_ta", F.unix_millis(F.col(at_a).cast("timestamp"))).withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("_ta") / ms) + i)))
    right = b.withColumn("_tb", F.unix_millis(F.col(at_b).cast("timestamp"))).withColumn("_bucket", F.floor(F.col("_tb") / ms))
    return left.join(right, [*keys, "_bucket"]).filter(F.abs(F.col("_ta") - F.col("_tb")) <= ms).drop("_bucket", "_ta", "_tb")


def suggest(names: DataFrame, name: str, query: str, limit: int = 5) -> DataFrame:
    """The best ``limit`` (1 to 25) distinct names for a query: score descending, then name."""
    limit = max(1, min(25, limit))
    q = " ".join(query.lower().split())
    one = names.select(F.lower(name).alias("name")).distinct()
    words = one.withColumn("_w", F.explode(F.array_distinct(F.split("name", " "))))
    close = words.withColumn("_s", similarity(F.lit(q), F.col("_w"))).groupBy("name").agg(F.max("_s").alias("_s"))
    scored = close.select("name", suggestion_score(F.lit(q), F.col("name"), F.col("_s")).alias("score")).filter("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), "name").limit(limit)


def contains_text(c: Column, query: str) -> Column:
    """Case-blind substring, with no wildcards."""
    return F.lower(c).contains(query.lower())


def similar_answers(answers: DataFrame, question: str, company: str | None, least: float = 0.45, limit: int = 10) -> DataFrame:
    """Stored answers (question, specific, company) to a question like this one, best first; what is specific to a
    company only for the same one."""
    q = " ".join(question.lower().split())
    fit = answers.filter(~F.col("specific") | F.coalesce(F.col("company") == F.lit(company), F.lit(False)))
    scored = fit.withColumn("score", similarity(F.lit(q), F.col("question"))).filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "question").limit(limit)


def match_applications(mail: DataFrame, apps: DataFrame, least: float = 0.9) -> DataFrame:
    """The application that each mail is about: id, app_id, fit; mail without a match has no row.

    Companies meet by equal keys or edit similarity. Among a company's applications an equal role comes first
    (3), then one of which either is the other's beginning, three words at least, if it is the only such (2),
    then an application without a role (1). Mail without a role matches a sole candidate only (0). Two
    applications of the best fit are none. ``mail``: id, company_key, role_key; ``apps``: id, company_key, role_key.
    """
    asked = mail.select(F.col("company_key").alias("_m"), F.col("role_key").alias("_asked")).distinct()
    asked = materialize(asked, "asked")  # what decides; mail repeats it
    near = fuzzy_companies(asked, "_m", apps.withColumnRenamed("company_key", "_k"), "_k", least)
    a = apps.select(F.col("id").alias("app_id"), F.col("company_key").alias("_k"), F.col("role_key").alias("_role"))
    pairs = near.select("_m", "_k").join(a, "_k").join(asked, "_m")
    role, own = F.col("_asked"), F.col("_role")
    short = F.least(F.size(F.split(role, " ")), F.size(F.split(own, " ")))
    begins = (short >= 3) & (F.startswith(own, F.concat(role, F.lit(" "))) | F.startswith(role, F.concat(own, F.lit(" "))))
    fit = F.when(role == "", 0).when(role == own, 3).when((own != "") & begins, 2).when(own == "", 1)

    def top(rows: DataFrame, *by: str) -> DataFrame:
        """The best fit, with the least and the greatest application of it."""
        first = F.min(F.struct(-F.col("fit"), F.isnull("lo"), F.col("lo").alias("lo"))).alias("_first")
        return rows.groupBy(*by).agg(first, F.max(F.struct("fit", "hi")).alias("_last")).select(*by, "_last.fit", "_first.lo", "_last.hi")

    best = top(pairs.select("_m", "_asked", fit.alias("fit"), F.col("app_id").alias("lo"), F.col("app_id").alias("hi")).filter("fit IS NOT NULL"), "_m", "_asked")
    hits = mail.join(best, (F.col("company_key") == F.col("_m")) & F.col("role_key").eqNullSafe(F.col("_asked")))
    return top(hits.select("id", "fit", "lo", "hi"), "id").filter("lo = hi").select("id", F.col("lo").alias("app_id"), "fit")


def search(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows that hold the text in any of the columns, case-blind and without wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(contains_text(F.col(c), query), F.lit(False))
    return rows.filter(hit)


def suggest_with_aliases(names: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The best names (name, aliases, at) for a query, each by itself or its best alias; for an empty query the latest, score 1.

    With a column ``source`` (a number) names of equal score come in its order, so that what is at hand stands before a
    catalog's.
    """
    tie = ["source", "name"] if "source" in names.columns else ["name"]
    limit = max(1, min(25, limit))
    q = " ".join(query.lower().split())
    if not q:
        return names.select("name", F.lit(1.0).alias("score"), "at").orderBy(F.desc("at"), "name").limit(limit).drop("at")
    fill = lambda c: F.octet_length(F.lit(q)) / F.octet_length(c)
    begins = lambda c: c.startswith(q) | F.contains(F.concat(F.lit(" "), c), F.lit(" " + q))

    def bands(c: Column, exact: float, prefix: float, inside: float) -> Column:
        return F.when(c == q, F.lit(exact)).when(begins(c), prefix + 0.09 * fill(c)).when(c.contains(q), inside + 0.09 * fill(c))

    own = bands(F.col("name"), 1.0, 0.8, 0.6)
    alias = F.array_max(F.transform("aliases", lambda a: bands(a, 0.9, 0.7, 0.5)))
    words = names.select("name", F.explode(F.array_distinct(F.concat(F.split("name", " "), F.flatten(F.transform("aliases", lambda a: F.split(a, " ")))))).alias("_w"))
    close = words.withColumn("_s", similarity(F.lit(q), F.col("_w"))).groupBy("name").agg(F.max("_s").alias("_s"))
    scored = names.join(close, "name").withColumn("score", F.coalesce(F.greatest(own, alias), F.when(F.col("_s") > 0.7, 0.3 + 0.2 * F.col("_s"))))
    return scored.filter("score IS NOT NULL").orderBy(F.desc("score"), *tie).limit(limit).select("name", "score", *tie[:-1])


def alias_candidates(keys: DataFrame, key: str) -> DataFrame:
    """(alias, canonical): keys that begin with another key and a word boundary; for review by hand."""
    one = keys.select(F.col(key).alias("alias")).distinct().filter("alias <> ''")
    starts = one.withColumn("_w", F.split("alias", " ")).withColumn("canonical", F.explode(F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.array_join(F.slice("_w", 1, i), " ")))).filter("canonical <> alias")
    return starts.select("alias", "canonical").join(one.toDF("canonical"), "canonical", "left_semi").select("alias", "canonical")
