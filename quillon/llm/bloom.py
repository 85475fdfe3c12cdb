"""Blocked Bloom filters as DataFrames.

A filter is a small table ``(_block long, _bits binary)``: blocks of 32,768 bits
(4 KiB). A key sets ``k`` bits of one block, so a probe is one join on the block
number. The number of blocks never exceeds ``max_blocks``; that bounds what is
broadcast (4 KiB a block) whatever the data. Beyond that the filter lets more
keys pass, which costs time and never changes a result: every user of a filter
checks its positives exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768
BITS_PER_KEY = 16
#: 32 MiB at most.
MAX_BLOCKS = 8192


def packed(docs: DataFrame, into: str = "row") -> DataFrame:
    """All columns in one struct, so that no name of theirs meets an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(into))


def block_count(n_keys: int, max_blocks: int = MAX_BLOCKS, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(1, min(max_blocks, -(-n_keys * bits_per_key // BLOCK_BITS)))


def _places(hashed: Column, blocks: int, k: int) -> tuple[Column, list[Column]]:
    bit = [F.shiftrightunsigned(hashed, n).bitwiseAND(F.lit(BLOCK_BITS - 1)) for n in (19, 34, 49)[:k]]
    return F.pmod(hashed, F.lit(blocks).cast("long")), bit


def build(keys: DataFrame, hashed: Column, blocks: int) -> DataFrame:
    """The filter of a 64-bit hash column, three bits a key."""
    block, bits = _places(hashed, blocks, 3)
    hits = keys.select(block.alias("_block"), F.explode(F.array(*bits)).alias("_bit"))
    return hits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def build_twice(keys: DataFrame, hashed: Column, blocks: int) -> DataFrame:
    """The filter of the bits that two rows hit or more, one bit a key.

    What moves is the number of a bit, counted within each task first: a key that
    many rows share is one row of each task.
    """
    block, bits = _places(hashed, blocks, 1)
    place = (block * BLOCK_BITS + bits[0]).cast("int")
    hits = keys.groupBy(place.alias("_place")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    hits = hits.select(F.floor(F.col("_place") / BLOCK_BITS).alias("_block"), F.pmod("_place", F.lit(BLOCK_BITS)).cast("long").alias("_bit"))
    return hits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def probe(rows: DataFrame, hashed: Column, blocks: int, bloom: DataFrame, into: str, k: int = 3) -> DataFrame:
    """``rows`` with a boolean column: may the filter hold the key?"""
    block, bits = _places(hashed, blocks, k)
    has = [
        F.expr(f"(shiftright(cast(conv(hex(substring(_bits, cast(shiftright(_p{i}, 3) as int) + 1, 1)), 16, 10) as int), cast(_p{i} & 7 as int)) & 1) = 1")
        for i in range(k)
    ]
    named = rows.withColumns({"_block": block} | {f"_p{i}": b for i, b in enumerate(bits)})
    joined = named.join(F.broadcast(bloom), "_block", "left")
    found = has[0]
    for h in has[1:]:
        found = found & h
    return joined.withColumn(into, F.coalesce(found, F.lit(False))).drop("_block", "_bits", *[f"_p{i}" for i in range(k)])


def only_known(rows: DataFrame, key: str, ids: DataFrame, n_ids: int) -> DataFrame:
    """Rows whose key may be among ``ids`` (column ``key``), found without a shuffle of ``rows``.

    False positives stay; the join that follows drops them.
    """
    blocks = block_count(n_ids)
    hashed = F.xxhash64(F.col(key))
    bloom = build(ids.select(key), hashed, blocks)
    return probe(rows, hashed, blocks, bloom, "_maybe").filter("_maybe").drop("_maybe")
