"""Hard negatives of anchors by a full sort of scores, block by block.

Vectors become integers, floor(256 * x). Anchors and rows meet in blocks (``quillon.llm.blocks``), twice:

1. Each anchor's rows of its own label in a block are sorted by score and id; the first five of
   each block meet in a window, which leaves the anchor's positives.
2. All scores of an anchor in a block are sorted by score and id. For each positive a binary
   search finds the upper limit, 90 hundredths of its score, and the first ten rows of another label
   from there on that are not under the lower limit, 30 hundredths, are read. The blocks' rows
   meet in a window, which leaves ten.

So no anchor's scores are in one place whole, and what leaves a task per anchor is bounded by the number of
positives and negatives asked for.

Defined results: rows with a null id, label or vector, or a null, NaN or infinite component take no part;
vectors of unequal length count as padded with zeros; a repeated vec_id is an anchor, positive or
negative row by row; an anchor without positives or without rows within the limits has no row; a component
beyond 64 bits counts as the nearest 64-bit number, scores beyond that rank by their
true value, give limits as far as 2^124 and are returned as the nearest 64-bit number; an empty table gives an empty result.
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
from quillon.session import discard, materialize

SCALE = 256
#: Rows of a data block and of an anchor block.
DATA_ROWS, ANCHOR_ROWS = 8192, 1024
#: Limits of a negative's score in hundredths of the positive's.
LOWER, UPPER = 30, 90
FOUND = "anchor_row long, place int, vec_id long, _row long, high decimal(38,0), low long"


def _ranked(score: np.ndarray) -> np.ndarray:
    """Order by descending score; equal scores keep their order, which is by id."""
    return np.argsort(-score, kind="stable")


def _emit(found: list[tuple]) -> pa.RecordBatch:
    """(anchor_row, place, vec_id, _row, score) rows of arrays."""
    columns = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(5)]
    arrays = [pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int32)), *(pa.array(columns[i].astype(np.int64)) for i in (2, 3)), *blocks.scores(columns[4].tolist())]
    return pa.RecordBatch.from_arrays(arrays, names=["anchor_row", "place", "vec_id", "_row", "high", "low"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            anchors, data = blocks.Block(row, "q", ["vec_id", "label"]), blocks.Block(row, "d", ["vec_id", "label"])
            score, found = blocks.products(anchors.codes, data.codes), []
            for i in range(len(anchors._row)):
                own = np.flatnonzero((data.label == anchors.label[i]) & (data._row != anchors._row[i]))
                best = own[_ranked(score[i, own])[:k]]
                found.append((np.full(len(best), anchors._row[i]), np.zeros(len(best), np.int64), data.vec_id[best], data._row[best], score[i, best]))
            yield _emit(found)

    return run


def _negatives(k: int, positives: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = ["vec_id", "label", *(f"{x}{p}" for p in range(positives) for x in ("h", "l"))]
        for row in _rows(batches):
            anchors, data = blocks.Block(row, "q", extra), blocks.Block(row, "d", ["vec_id", "label"])
            score, found = blocks.products(anchors.codes, data.codes), []
            for i in range(len(anchors._row)):
                order = _ranked(score[i])
                order = order[data.label[order] != anchors.label[i]]
                down = -score[i, order]
                for p in range(positives):
                    high = int(getattr(anchors, f"h{p}")[i])
                    if high == NONE:
                        break
                    of = (high << blocks.SHIFT) + int(getattr(anchors, f"l{p}")[i])
                    # 100 s <= 90 of, 100 s >= 30 of; the limits may lie beyond what the scores' type holds.
                    most, least = _within(UPPER * of // 100, down), _within(-(-LOWER * of // 100), down)
                    begin = int(np.searchsorted(down, -most))
                    taken = order[begin : begin + k]
                    taken = taken[score[i, taken] >= least]
                    if least <= most and len(taken):
                        found.append((np.full(len(taken), anchors._row[i]), np.full(len(taken), p), data.vec_id[taken], data._row[taken], score[i, taken]))
            yield _emit(found)

    return run


#: Stands for no positive.
NONE = -(1 << 63)


def _within(limit: int, scores: np.ndarray) -> int:
    return limit if scores.dtype == object else max(-(1 << 62) - 1, min((1 << 62) + 1, limit))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("high"), F.desc("low"), "vec_id", "_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(codes: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 10) -> DataFrame:
    """``codes`` (_row, vec_id, label, code) against ``anchors``, rows of them; the result has the columns of the query op13."""
    data = blocks.cut(codes, {"vec_id": "long", "label": "long"}, DATA_ROWS, "negatives-data")
    first = blocks.cut(anchors, {"vec_id": "long", "label": "long"}, ANCHOR_ROWS, "negatives-anchors")
    near = _first(blocks.pairs(first, data).mapInArrow(trimmed(_positives(positives)), FOUND), ["anchor_row"], positives)
    near = materialize(near.select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), "high", "low"), "negatives-positives")
    # A positive's score in two columns by its place. For its limits a score counts as 2^124 at most.
    bounded = lambda x: F.greatest(F.least(x, F.lit(1 << blocks.SHIFT).cast("decimal(38,0)")), F.lit(-(1 << blocks.SHIFT)).cast("decimal(38,0)")).cast("long")
    wide = near.groupBy("anchor_row").agg(*(F.max(F.when(F.col("place") == p, bounded(F.col(c)))).alias(f"{c[0]}{p}") for p in range(positives) for c in ("high", "low")))
    names = [f"{x}{p}" for p in range(positives) for x in ("h", "l")]
    wide = anchors.join(wide, F.col("_row") == F.col("anchor_row")).select("_row", "vec_id", "label", "code", *(F.coalesce(c, F.lit(NONE)).alias(c) for c in names))
    second = blocks.cut(materialize(wide, "negatives-wide"), {"vec_id": "long", "label": "long"} | dict.fromkeys(names, "long"), ANCHOR_ROWS, "negatives-anchors")
    far = _first(blocks.pairs(second, data).mapInArrow(trimmed(_negatives(k, positives)), FOUND), ["anchor_row", "place"], k)
    far = far.select("anchor_row", "place", "rank", F.col("vec_id").alias("negative_id"), blocks.score().alias("negative_score"))
    near = near.select("anchor_row", "place", "positive_id", blocks.score().alias("positive_score"))
    named = anchors.select(F.col("_row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    out = materialize(far, "negatives-found").join(near, ["anchor_row", "place"]).join(named, "anchor_row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(vectors: DataFrame, every: int = 100, spoilt: int = 7, classes: int = 10, positives: int = 5, k: int = 10) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by ``every``; labels of every ``spoilt``-th id are moved by one."""
    takes_part, code = blocks.quantised(F.col("embedding"), SCALE)
    label = F.when(F.col("vec_id") % spoilt == 0, (F.col("label").cast("long") + 1) % classes).otherwise(F.col("label").cast("long"))
    rows = vectors.filter(takes_part & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    codes = materialize(rows.select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), code.alias("code")), "negatives-codes")
    return hard_negatives(codes, codes.filter(F.col("vec_id") % every == 0), positives, k)


SQL = """
WITH codes AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS code
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), components AS (
  SELECT r, generate_subscripts(code, 1) AS d, unnest(code) AS x FROM codes
), sums AS (
  SELECT q.r AS a, v.r AS b, CAST(sum(q.x * v.x) AS BIGINT) AS score
  FROM components q JOIN components v ON q.d = v.d AND q.r <> v.r WHERE q.r IN (SELECT r FROM codes WHERE vec_id % 100 = 0) GROUP BY q.r, v.r
), scores AS (
  SELECT a, b, q.vec_id AS anchor_id, v.vec_id, q.label = v.label AS same, score
  FROM sums JOIN codes q ON q.r = a JOIN codes v ON v.r = b
), positives AS (
  SELECT a, b, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5
)
SELECT s.anchor_id, p.positive_id, CAST(row_number() OVER g AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.a = p.a AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW g AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id, s.b)
QUALIFY row_number() OVER g <= 10
"""
