"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes every whole text to one bit of a filter and notes the bits that two rows hit;
what it moves is a bit's number a row, counted within each task first, and no id, hash or
text. Pass 2 probes each row: a row whose bit was hit only once has no equal row, so it
goes straight through. The others (true repeats and some 3% false positives) shuffle on the
full SHA-256 and are grouped exactly. The filter has 32 bits a key up to ``max_blocks``
blocks, which bounds the broadcast; with more keys more rows shuffle, and nothing else changes.

Defined results: a null text counts as empty; all empty texts are equal; of equal
texts the largest doc_id stays; repeated rows (same doc_id and text) are rows of one
group; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import bloom
from quillon.session import materialize

BITS_PER_KEY = 32


def _key(sha: Column) -> Column:
    """64 bits of the SHA-256, as a bigint."""
    return F.xxhash64(sha)


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _probed(rows: DataFrame, hashed: DataFrame, n: int, max_blocks: int) -> DataFrame:
    """``rows`` with ``_maybe``: may another row of ``hashed`` have the same text_sha256?"""
    key, blocks = _key(F.col("text_sha256")), bloom.block_count(n, max_blocks, BITS_PER_KEY)
    return bloom.probe(rows, key, blocks, bloom.build_twice(hashed, key, blocks), "_maybe", k=1)


def exact_dedup(docs: DataFrame, max_blocks: int = bloom.MAX_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = materialize(docs.select("doc_id", _sha(F.col("text")).alias("text_sha256")), "exact-sha")
    probed = _probed(hashed, hashed, hashed.count(), max_blocks)

    single = probed.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = probed.filter("_maybe").drop("_maybe")
    # Written first: a join of two plain shuffles is one that Spark can split where a group is large.
    groups = materialize(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    repeated = maybe.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"
    )
    return single.unionByName(repeated)


def survivors(docs: DataFrame, max_blocks: int = bloom.MAX_BLOCKS) -> DataFrame:
    """One row of ``docs`` for each distinct text, whole with all its columns: the one of largest doc_id.

    Only rows that may have an equal one shuffle; each task first keeps its best row of a
    text, so a text that a third of the rows share is a row of each task. A null doc_id
    comes after all others; among rows of one doc_id and text one stays, by a hash of the
    other columns. What a doc_id's other texts are plays no part.
    """
    rows = bloom.packed(docs).withColumn("text_sha256", _sha(F.col("row.text")))
    hashed = materialize(rows.select("text_sha256"), "exact-sha")
    probed = _probed(rows, hashed, hashed.count(), max_blocks)
    order = F.struct(F.col("row.doc_id"), F.xxhash64(F.to_json("row")))
    best = probed.filter("_maybe").groupBy("text_sha256").agg(F.max_by("row", order).alias("row"))
    return probed.filter("NOT _maybe").select("row.*").unionByName(best.select("row.*"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
