"""All pairs within a key, without a row for each pair and without a key in one task.

The rows of a key are cut into blocks of bounded size. Each pair of blocks (and each block with
itself) is a square, to which Spark deals its rows; a task compares the rows of a square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.kernels import trimmed
from quillon.session import materialize


def _squares(work):
    """``work`` on the squares of a partition's rows, which are sorted by ``square``; a square is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and held[-1].column("square")[-1] != batch.column("square")[0]:
                yield from done(held)
                held = []
            column = batch.column("square").to_numpy()
            cut = int(np.searchsorted(column, column[-1]))  # the last square may go on in the next batch
            if cut:
                yield from done([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(held)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        square = table.column("square").to_numpy()
        ends = np.append(np.flatnonzero(np.diff(square)) + 1, len(square))
        out = work(table, zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True))
        if out.num_rows:
            yield out

    return run


#: Rows of a block and bytes of the column ``heavy`` in it at most, about. Below MOST_SHARES blocks of a key they are smaller.
BLOCK_DOCS, BLOCK_BYTES, SMALL, MOST_SHARES = 4096, 4 << 20, 1024, 16


def _dealt(rows: DataFrame, heavy: str) -> DataFrame:
    """Rows of open keys dealt to the squares of their key's blocks: one row per square, with its side in it."""
    n = F.count(F.lit(1))
    by_rows = F.greatest(F.ceil(n / BLOCK_DOCS), F.least(F.ceil(n / SMALL), F.lit(MOST_SHARES)))
    by_bytes = [F.ceil(F.sum(F.octet_length(heavy)) / BLOCK_BYTES)] if heavy in rows.columns else []
    sizes = rows.groupBy("key").agg((F.greatest(by_rows, *by_bytes) if by_bytes else by_rows).cast("int").alias("blocks"))
    cut = rows.join(materialize(sizes, "near-blocks"), "key")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    square = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.withColumns({"square": square, "side": F.signum(F.col("block") - F.col("other")).cast("int")}).drop("block", "other", "blocks")


def by_squares(rows: DataFrame, work, schema: str, label: str, heavy: str = "shingles") -> DataFrame:
    """What ``work(table, groups)`` makes of the squares of ``rows`` (key, cid and more). A group is a range of the
    table's rows, one square; ``side`` is 0 in a block with itself, -1 and 1 in two blocks."""
    return materialize(_dealt(rows, heavy).repartition("square").sortWithinPartitions("square").mapInArrow(trimmed(_squares(work)), schema), label)
