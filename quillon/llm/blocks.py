"""Bounded blocks of integer vectors, and every pair of a block of one table with a block of another.

A stated set of queries against all rows is quadratic by its nature. Here both sides are cut
into blocks of a size that a task can hold; a row of ``pairs`` is one query block beside one data
block, brought together by an equality join on both blocks' numbers, so that Spark deals the
pairs out and no side is broadcast or collected.

Inner products are integers: by floating point where every partial sum stays under 2^53, in 64 bits
under 2^62, otherwise in Python's integers. A score leaves a task as ``high`` * 2^62 + ``low``.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.kernels import trimmed
from quillon.session import materialize

SHIFT = 62
BLOCK = "block int, rows int, dims int, width int, codes binary"


def quantised(x: Column, scale: int) -> tuple[Column, Column]:
    """(whether a vector takes part, its components floor(scale * x) as array<long>)."""
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return x.isNotNull() & finite, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a list<long> column, padded with zeros (or cut) to ``dims``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy()
    dims = int(size.max(initial=0)) if dims is None else dims
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(size), dims), np.int64)
    inside = place < dims
    out[row[inside], place[inside]] = column.flatten().to_numpy()[inside]
    return out


def narrow(codes: np.ndarray) -> np.ndarray:
    """``codes`` in the narrowest integers that hold them."""
    low, high = (int(codes.min()), int(codes.max())) if codes.size else (0, 0)
    return codes.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, as int64 or, where these might not hold them, objects."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    most = max(1, dims) * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    kind = np.int64 if most < 2.0**SHIFT else object
    return a.astype(kind) @ b.astype(kind).T


def cut(rows: DataFrame, extra: dict[str, str], per_block: int, label: str) -> tuple[DataFrame, int]:
    """(a row per block, their number) of ``rows`` (_row, code and the ``extra`` long columns, kept as binary columns)."""
    total = rows.count()
    blocks = max(1, -(-total // per_block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                number = batch.column("block")
                if held and held[0].column("block")[0] != number[0]:
                    yield packed(held)
                    held = []
                end = int(np.searchsorted(number.to_numpy(), number[0].as_py(), side="right"))
                held.append(batch.slice(0, end))
                batch = batch.slice(end)
        if held:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        codes = narrow(matrix(table.column("code")))
        values = {"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "rows": pa.array([codes.shape[0]], pa.int32()), "dims": pa.array([codes.shape[1]], pa.int32()), "width": pa.array([codes.itemsize], pa.int32()), "codes": pa.array([codes.tobytes()], pa.binary())}
        values |= {c: pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ["_row", *extra]}
        return pa.RecordBatch.from_arrays(list(values.values()), names=list(values))

    numbered = rows.select(F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("block"), "_row", "code", *(F.col(k).cast("long").alias(k) for k in extra))
    sorted_ = numbered.repartition("block").sortWithinPartitions("block", *([c for c in ("vec_id",) if c in extra]), "_row")
    schema = ", ".join([BLOCK, *(f"{c} binary" for c in ["_row", *extra])])
    return materialize(sorted_.mapInArrow(trimmed(run), schema), label), blocks


def pairs(queries: tuple[DataFrame, int], data: tuple[DataFrame, int]) -> DataFrame:
    """Every query block (columns q_*) beside every data block (d_*)."""
    (q, n_q), (d, n_d) = queries, data
    q = q.select(*(F.col(c).alias(f"q_{c}") for c in q.columns)).withColumn("d_block", F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))))
    d = d.select(*(F.col(c).alias(f"d_{c}") for c in d.columns)).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    return q.join(d, ["q_block", "d_block"])


class Block:
    """One side of a pair in a task: codes and the 64-bit columns."""

    def __init__(self, row: dict, side: str, extra: list[str]):
        self.codes = np.frombuffer(row[f"{side}_codes"], np.dtype(f"i{row[f'{side}_width']}")).reshape(row[f"{side}_rows"], row[f"{side}_dims"])
        for c in ["_row", *extra]:
            setattr(self, c, np.frombuffer(row[f"{side}_{c}"], np.int64))


def scores(values: list[int] | np.ndarray) -> list[pa.Array]:
    """``high`` and ``low`` of true scores."""
    values = [int(v) for v in values]
    return [pa.array([Decimal(v >> SHIFT) for v in values], pa.decimal128(38, 0)), pa.array([v & (1 << SHIFT) - 1 for v in values], pa.int64())]


def score() -> Column:
    """The score of ``high`` and ``low``, or the nearest 64-bit number."""
    high, low = F.col("high"), F.col("low")
    return F.when(high > 1, F.lit((1 << 63) - 1)).when(high < -2, F.lit(-(1 << 63))).otherwise(high.cast("long") * (1 << SHIFT) + low)
