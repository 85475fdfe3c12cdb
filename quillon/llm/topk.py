"""Exact top-k by inner product over an impact-ordered index, searched score at a time.

Vectors become integers, floor(1024 * x). The index cuts the rows into blocks of bounded
size; in a block each dimension's postings are ordered by value and cut into segments of one
quantised impact. A query takes a block's segments, all dimensions together, by descending
bound on what a posting in them adds to the score. After each share of the postings it knows
for every row the sum of what was seen plus, for each dimension not seen yet, the bound of the
next segment; rows whose bound is under the k-th best exact score so far cannot be members.
It stops only when few rows are left, and rescores all of these exactly in integers.

Queries are cut into blocks too; one join brings every block of queries to every block of the index
(``quillon.llm.blocks``), and the best k rows of each meet in a window by query.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part;
vectors of unequal length count as padded with zeros; equal scores go to the smaller vec_id; rows that
repeat a vec_id are queries and candidates each by itself, so that only the query's own row is left out; an empty table
gives an empty result. A component beyond 64 bits counts as the nearest 64-bit number; scores beyond 64 bits rank by
their true value and are returned as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import blocks
from quillon.llm.kernels import trimmed
from quillon.session import materialize

SCALE = 1024
#: Components in a block of the index and in a block of queries, quantised impacts of a dimension.
BLOCK, QUERY_BLOCK, LEVELS = 1 << 19, 1 << 18, 32
#: Shares of the postings after which the bounds are looked at.
ROUNDS = (0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0)

INDEX = f"{blocks.BLOCK}, _row binary, vec_id binary, postings binary, segments binary"
FOUND = "query_row long, query_id long, vec_id long, _row long, high decimal(38,0), low long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """_row, vec_id, code array<long>; rows that take no part are left out."""
    takes_part, code = blocks.quantised(F.col(vector_col), SCALE)
    rows = vectors.filter(takes_part & F.col(id_col).isNotNull())
    return rows.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("vec_id"), code.alias("code"))


def _impacts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(postings by dimension, segments) of a block. Segments: rows of (dimension, least, greatest value, first posting, end)."""
    rows, dims = codes.shape
    postings, segments = np.empty((dims, rows), np.int32), []
    for d in range(dims):
        order = np.argsort(codes[:, d], kind="stable")
        value = codes[order, d].astype(np.int64)
        step = max(1, -(-(int(value[-1]) - int(value[0]) + 1) // LEVELS)) if rows else 1
        # Differences as unsigned words: they fit, whatever the values are.
        level = (value.view(np.uint64) - value[:1].view(np.uint64)) // np.uint64(step)
        begin = np.flatnonzero(np.concatenate(([True], np.diff(level) != 0)))
        end = np.append(begin[1:], rows)
        postings[d] = order
        segments.append(np.stack((np.full(len(begin), d), value[begin], value[end - 1], begin + d * rows, end + d * rows), axis=1))
    return postings, np.concatenate(segments).astype(np.int64) if segments else np.zeros((0, 5), np.int64)


def build_index(codes: DataFrame) -> tuple[DataFrame, int]:
    """(a row per block of vectors, their number), written to the shared folder."""
    widest = codes.agg(F.max(F.size("code"))).first()[0]
    plain, n = blocks.cut(codes, {"vec_id": "long"}, max(1, BLOCK // max(1, widest or 1)), "topk-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                of = {c: row.column(c)[0].as_py() for c in ("rows", "dims", "width", "codes")}
                postings, segments = _impacts(np.frombuffer(of["codes"], np.dtype(f"i{of['width']}")).reshape(of["rows"], of["dims"]))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([postings.tobytes()], pa.binary()), pa.array([segments.tobytes()], pa.binary())], names=[*row.schema.names, "postings", "segments"])

    return materialize(plain.mapInArrow(trimmed(run), INDEX), "topk-index"), n


class Block:
    """One block of the index in a task."""

    def __init__(self, row: dict):
        held = blocks.Block(row, "d", ["vec_id"])
        self.ids, self.numbers, self.codes = held.vec_id, held._row, held.codes.astype(np.int64)
        rows, dims = self.codes.shape
        self.postings = np.frombuffer(row["d_postings"], np.int32).astype(np.int64)
        self.dim, self.low, self.high, self.begin, self.end = np.frombuffer(row["d_segments"], np.int64).reshape(-1, 5).T
        own = np.arange(dims).repeat(rows)
        self.values = self.codes[self.postings, own].astype(np.float64)
        self.first = np.searchsorted(self.dim, np.arange(dims + 1))
        self.least_few, self.enough = max(64, rows // 20), ROUNDS[0]
        self.largest = float(np.abs(self.codes.astype(np.float64)).max(initial=0))

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer inner products, as Python integers where 64 bits might not hold a sum."""
        if self.largest * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, len(q)) < 2.0**62:
            return self.codes[rows] @ q
        return self.codes[rows].astype(object) @ q.astype(object)

    def members(self, query: np.ndarray, query_row: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) among which are all of the block's rows in the query's top k.

        ``floor``: a score that k other rows are known to reach.
        """
        rows, dims = self.codes.shape
        q = np.zeros(dims, np.int64)
        q[: min(dims, len(query))] = query[:dims]
        weight = q[self.dim].astype(np.float64)
        bound = np.where(weight >= 0, weight * self.high.astype(np.float64), weight * self.low.astype(np.float64))
        order = np.argsort(-bound, kind="stable")
        size = np.cumsum((self.end - self.begin)[order])
        slack = 1e-9 * (np.abs(bound).sum() + 1)
        other = self.numbers != query_row
        used = np.flatnonzero(q).tolist()
        for share in [x for x in ROUNDS if x >= self.enough]:
            stop = int(np.searchsorted(size, share * size[-1])) + 1 if len(size) else 0
            left = order[stop:]
            rest = np.zeros(dims)
            rest[self.dim[left][::-1]] = bound[left][::-1]  # of a dimension's segments left, the first in order
            # What was seen of a dimension is one end of its postings: the high one for a positive weight.
            seen = np.bincount(self.dim[order[:stop]], minlength=dims)
            upper = np.full(rows, rest.sum() + slack)
            for d in used:
                if seen[d]:
                    a, b = (self.first[d + 1] - seen[d], self.first[d + 1] - 1) if q[d] > 0 else (self.first[d], self.first[d] + seen[d] - 1)
                    a, b = self.begin[a], self.end[b]
                    upper[self.postings[a:b]] += self.values[a:b] * float(q[d]) - rest[d]
            best = np.argpartition(-np.where(other, upper, -np.inf), min(k, rows) - 1)[:k]
            exact = np.sort(self.exact(best[other[best]], q))[::-1]
            least = max([x for x in (floor, int(exact[k - 1]) if len(exact) >= k else None) if x is not None], default=None)
            few = np.flatnonzero(other & (upper >= float(least))) if least is not None else np.flatnonzero(other)
            if len(few) <= self.least_few:
                break
        # The next query begins where this one ended, or a step before that.
        self.enough = ROUNDS[max(0, ROUNDS.index(share) - (len(few) <= self.least_few // 4))]
        return few, self.exact(few, q)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, best = None, None, []  # best of each query: (-score, vec_id, row) of the task's blocks so far
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["q_block"] != at:
                    if queries is not None:
                        yield _found(queries, best)
                    at, queries = row["q_block"], blocks.Block(row, "q", ["vec_id"])
                    codes, best = queries.codes.astype(np.int64), [[] for _ in queries._row]
                block = Block(row)
                for n, number in enumerate(queries._row.tolist()):
                    own = best[n]
                    rows, scores = block.members(codes[n], number, k, -own[k - 1][0] if len(own) >= k else None)
                    best[n] = sorted(own + list(zip((-scores).tolist(), block.ids[rows].tolist(), block.numbers[rows].tolist(), strict=True)))[:k]
        if queries is not None:
            yield _found(queries, best)

    return run


def _found(queries: blocks.Block, best: list[list[tuple]]) -> pa.RecordBatch:
    flat = [(q, i, v, r, -s) for q, i, own in zip(queries._row.tolist(), queries.vec_id.tolist(), best, strict=True) for s, v, r in own]
    columns = [pa.array([x[n] for x in flat], pa.int64()) for n in range(4)]
    return pa.RecordBatch.from_arrays([*columns, *blocks.scores([x[4] for x in flat])], names=["query_row", "query_id", "vec_id", "_row", "high", "low"])


def search(queries: DataFrame, index: tuple[DataFrame, int], k: int = 10) -> DataFrame:
    """``queries`` (_row, vec_id, code) against a whole index: query_id, rank, vec_id, score, for each query row."""
    widest = queries.agg(F.max(F.size("code"))).first()[0]
    asked = blocks.cut(queries, {"vec_id": "long"}, max(1, QUERY_BLOCK // max(1, widest or 1)), "topk-queries")
    found = materialize(blocks.pairs(asked, index).mapInArrow(trimmed(_search(k)), FOUND), "topk-found")
    order = W.partitionBy("query_row").orderBy(F.desc("high"), F.desc("low"), "vec_id", "_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", blocks.score().alias("score"))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The rows whose vec_id is divisible by ``every`` against all rows."""
    codes = materialize(quantised(vectors), "topk-codes")
    return search(codes.filter(F.col("vec_id") % every == 0), build_index(codes), k)


SQL = """
WITH codes AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS code FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), components AS (
  SELECT r, vec_id, generate_subscripts(code, 1) AS d, unnest(code) AS x FROM codes
), scores AS (
  SELECT q.r AS query_row, v.r AS r, any_value(q.vec_id) AS query_id, any_value(v.vec_id) AS vec_id, CAST(sum(q.x * v.x) AS BIGINT) AS score
  FROM components q JOIN components v ON q.d = v.d AND q.r <> v.r
  WHERE q.vec_id % 100 = 0 GROUP BY q.r, v.r
)
SELECT query_id, CAST(row_number() OVER g AS INTEGER) AS rank, vec_id, score FROM scores
WINDOW g AS (PARTITION BY query_row ORDER BY score DESC, vec_id, r)
QUALIFY row_number() OVER g <= 10
"""
