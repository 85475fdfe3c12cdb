"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a row of slots of about equal token count. Slot t belongs to the source whose
interval of cumulative target shares holds the golden-ratio point frac((t + 1) / phi),
so at any length each source's share is within a few slots of its target. Slots are
ranked within their source. A source's documents, shuffled by a hash and repeated for
three passes at most, are a stream that is taken up to the source's target and cut into as many
blocks as the source has slots, which differ by a word at most; the r-th slot takes the
r-th block. So each source gets its target (rounded to a word), however small it is beside the mix.
A source whose interval holds no point shares one slot with the slot's own source.

Everything that needs an order within a source (running totals, ranks) is done in two
levels, within hash or slot ranges and then over the ranges' sums, so that a source
with a third of all rows never meets in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in
the order of weights; size 0 documents take nothing; an empty table gives an empty
result; null and repeated doc_ids count as separate rows, dealt by their texts. Rows equal in doc_id, text and
source take turns in the order in which they are read; as a group they get the same whatever that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import bloom
from quillon.session import materialize

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
MAX_PASSES = 3
#: Tokens in a slot, about: a 2^18th of the mix, between these bounds.
MIN_BLOCK, MAX_BLOCK, SLOTS = 16, 4096, 1 << 18
_RANGES = 256
_GRID = 1024


def sized(rows: DataFrame) -> DataFrame:
    """doc_id, source, size, a place in the shuffled order, the text's hash and the row's number, of doc_id, text, source, _row.

    The order depends on a row's id and text alone, so that the same rows read in another order are dealt alike.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return rows.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text", F.lit("shuffle")).alias("_order"), F.xxhash64("text").alias("_text"), "_row")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size, weight, target.

    A target is weight times the level at which the targets, each held to
    ``max_passes`` times its source's size, add up to the whole. Sorted by the level at
    which they are held, the held sources are a prefix; one pass of running sums finds it.
    The table has a row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (nth % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", max_passes * F.col("source_size").cast("double"))
    per = per.withColumn("_level", F.col("_cap") / F.col("weight"))
    upto = W.orderBy("_level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns(
        {"_total": F.sum(F.col("source_size").cast("double")).over(every), "_held": F.sum("_cap").over(upto), "_free": F.sum("weight").over(every) - F.sum("weight").over(upto)}
    )
    # If exactly the sources up to this row are held, the others' level is (total - held) / free weight.
    before = F.col("_free") + F.col("weight")
    level_before = (F.col("_total") - F.col("_held") + F.col("_cap")) / before
    per = per.withColumn("_is_held", F.col("_level") < level_before)
    level = (F.col("_total") - F.coalesce(F.sum(F.when(F.col("_is_held"), F.col("_cap"))).over(every), F.lit(0.0))) / F.sum(
        F.when(~F.col("_is_held"), F.col("weight"))
    ).over(every)
    target = F.when(F.col("_is_held"), F.col("_cap")).otherwise(F.col("weight") * level)
    return per.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _running(df: DataFrame, keys: list[str], range_col: str, order: list[str], value: Column, into: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row, per key, in two levels."""
    df = df.withColumn("_v", value)
    sums = df.groupBy(*keys, range_col).agg(F.sum("_v").alias("_sum"))
    before = W.partitionBy(*keys).orderBy(range_col).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, range_col, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy(*keys, range_col).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return df.join(sums, [*keys, range_col]).withColumn(into, F.col("_base") + F.col("_in")).drop("_v", "_in", "_base")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``rows``: doc_id, text, source and, where the caller has one, the row's number ``_row``.

    Returns (sizes, sources, schedule). sizes: doc_id, source, size and the row's number
    ``_row``. sources: the targets, with a dense ``_sid``. schedule, one row per slot and
    piece of a document in it: slot, _row, words, pass.
    """
    spark = rows.sparkSession
    if "_row" not in rows.columns:
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
    sizes = materialize(sized(rows), "mix-sizes")
    found = targets(sizes, weights, max_passes)
    first = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = F.try_divide(F.col("target"), F.sum("target").over(every))
    sources = materialize(
        found.withColumn("_sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_share", F.coalesce(share, F.lit(0.0)))
        .withColumn("_hi", F.sum("_share").over(first)),
        "mix-sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(MIN_BLOCK, min(MAX_BLOCK, -(-total // SLOTS)))
    slots = -(-total // block)

    # Slots to sources: each source covers the grid cells that its interval touches, so
    # that the search of the interval is an equi-join on the cell.
    cells = sources.filter("_share > 0").select(
        "_sid",
        (F.col("_hi") - F.col("_share")).alias("_lo"),
        # The last interval takes what rounding leaves at its upper end.
        F.when(F.col("_hi") > 1 - 1e-9, F.lit(2.0)).otherwise(F.col("_hi")).alias("_hi"),
        F.explode(F.expr(f"sequence(cast(floor((_hi - _share) * {_GRID}) as int), cast(least(floor(_hi * {_GRID}), {_GRID - 1}) as int))")).alias("_cell"),
    )
    golden = (5**0.5 - 1) / 2
    t = F.col("slot") + 1
    point = spark.range(slots).withColumnRenamed("id", "slot").withColumn("_u", t * golden - F.floor(t * golden))
    point = point.withColumn("_cell", F.floor(F.col("_u") * _GRID).cast("int"))
    dealt = point.join(cells, "_cell").filter("_u >= _lo AND _u < _hi").select("slot", "_sid")
    counted = sources.select("_sid", F.col("source").alias("_src"), F.col("source_size").alias("_of"), F.round("target").cast("long").alias("_take")).filter("_take > 0")
    counted = counted.join(dealt.groupBy("_sid").agg(F.count(F.lit(1)).alias("_slots")), "_sid", "left")
    counted = materialize(counted, "mix-slots")  # a row per source; the joins below know its size
    slotless = counted.filter("_slots IS NULL").select(F.pmod(F.xxhash64("_sid"), F.lit(max(1, slots))).alias("slot"), "_sid")
    dealt = dealt.unionByName(slotless).withColumn("_range", F.floor(F.col("slot") / 4096))
    ranked = _running(dealt, ["_sid"], "_range", ["slot"], F.lit(1), "_rank")

    # Documents to blocks: places in the shuffled stream of the source, pass after pass up to its
    # target, cut at block ends. The first _more blocks have a word more than the others.
    of = counted.withColumn("_slots", F.coalesce("_slots", F.lit(1))).withColumns({"_least": F.expr("_take div _slots"), "_more": F.expr("_take % _slots")})
    placed = sizes.filter("size > 0").join(of, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    placed = placed.withColumn("_range", F.pmod(F.shiftrightunsigned("_order", 40), F.lit(_RANGES)))
    placed = _running(placed, ["_sid"], "_range", ["_order", "doc_id", "_text", "_row"], F.col("size"), "_start")
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))))
    passes = passes.withColumn("_from", F.col("pass") * F.col("_of") + F.col("_start")).filter("_from < _take")
    passes = passes.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("_take")))
    block_of = lambda at: F.expr(
        f"IF({at} < _more * (_least + 1), ({at}) div (_least + 1), _more + ({at} - _more * (_least + 1)) div greatest(_least, 1L))"
    )
    cut = passes.withColumn("_rank", F.explode(F.sequence(block_of("_from"), block_of("(_to - 1)"))))
    begin = F.col("_rank") * F.col("_least") + F.least("_rank", "_more")
    end = begin + F.col("_least") + F.when(F.col("_rank") < F.col("_more"), 1).otherwise(0)
    pieces = cut.select("_sid", "_rank", "_row", (F.least(F.col("_to"), end) - F.greatest(F.col("_from"), begin)).alias("words"), "pass")
    schedule = ranked.join(pieces, ["_sid", "_rank"]).select("slot", "_row", "words", "pass")
    return sizes, sources, schedule


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words of it in the mix)."""
    sizes, sources, schedule = plan(docs.select("doc_id", "text", "source"), weights, max_passes)
    taken = schedule.groupBy("_row").agg(F.sum("words").alias("taken"))
    of = sources.select(F.col("source").alias("_src"), "source_size", "target")
    out = sizes.join(of, F.col("source").eqNullSafe(F.col("_src"))).join(taken, "_row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), "source")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The rows of ``docs`` that the mix uses, whole with all their columns, each once per pass that takes words of it.

    So of each source the last document taken counts whole, where its target ends within it.
    Rows without words are left out. Rows with null or repeated doc_ids are rows like all others.
    """
    rows = materialize(bloom.packed(docs).withColumn("_row", F.monotonically_increasing_id()), "mix-docs")
    schedule = plan(rows.select("row.doc_id", "row.text", "row.source", "_row"), weights, max_passes)[2]
    times = materialize(schedule.groupBy("_row").agg(F.count_distinct("pass").cast("int").alias("times")), "mix-times")
    # A shuffle of both sides at every size: the rows' counts are as many as the rows.
    return rows.join(times.hint("merge"), "_row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
