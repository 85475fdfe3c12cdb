"""Near duplicates among vectors by cross-polytope hashing with multiprobe buckets and exact verification.

1. Equal vectors are folded into classes with their number of rows.
2. A class is rotated pseudo-randomly: three times a flip of signs and a fast Hadamard transform. Its code is the
   axis, with sign, of the largest coordinate; it also goes to the buckets of the next largest ones. Where one
   polytope has too few codes for the number of vectors, several make one key, the last with fewer
   axes, so that buckets stay at some hundreds of vectors whatever the size of the table.
3. How many tables are needed is computed from the collision rate of random pairs at the wanted cosine, measured
   for just these polytopes, so that a pair at the limit is missed by all tables with
   probability ``MISSES`` at most; closer pairs are missed less.
4. Buckets are cut into blocks, and the pairs of a bucket are compared in squares of blocks, exactly, in double
   precision. A pair that shares several buckets counts in the first of them. What leaves a task is a
   row per class and square: how many rows it links with, and the least class it hangs together with.

No bucket has a cap. Defined results: a vector that is null, zero or holds a null, NaN or infinite component links
with nothing and is its own component; vectors of unequal length count as padded with zeros; rows that repeat a vec_id
are judged each by its own vector; a row with a null vec_id takes part, and its component_id is the
least vec_id reachable, null if there is none; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.kernels import trimmed
from quillon.llm.squares import by_squares
from quillon.session import discard, materialize

#: Probability that a pair at the limit shares no bucket, vectors in a bucket about, probes by the number of polytopes.
MISSES, IN_BUCKET, PROBES = 1e-6, 512, (4, 3, 2)
#: Pairs with which collision rates are measured.
TRIALS = 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the row length is a power of two."""
    n, d = x.shape
    x = x.copy()
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


@lru_cache(maxsize=4096)
def _signs(d: int, number: int) -> np.ndarray:
    return np.random.default_rng((20, d, number)).choice([-1.0, 1.0], (3, d))


def tops(x: np.ndarray, number: int, axes: int, probes: int) -> np.ndarray:
    """The ``probes`` most likely codes of each row under rotation ``number``: axis * 2, plus 1 for the negative end."""
    for signs in _signs(x.shape[1], number):
        x = hadamard(x * signs)
    x = x[:, :axes]
    first = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :probes]
    return (first * 2 + (np.take_along_axis(x, first, 1) < 0)).astype(np.int16)


class Plan:
    """Polytopes of a key, probes of each and number of tables for ``n`` vectors of ``dims`` components."""

    def __init__(self, n: int, dims: int, limit: float):
        self.dims = 1 << max(0, math.ceil(math.log2(max(1, dims))))
        wanted = max(1.0, n / IN_BUCKET)
        full = 0
        while (2 * self.dims) ** (full + 1) < wanted:
            full += 1
        last = min(self.dims, 8)
        while last < self.dims and (2 * self.dims) ** full * 2 * last < wanted:
            last *= 2
        self.axes = [self.dims] * full + [last]
        self.probes = min(PROBES[min(len(self.axes), len(PROBES)) - 1], last)
        self.rate = math.prod(self._rate(axes, limit) for axes in self.axes)
        self.tables = max(1, math.ceil(math.log(MISSES) / math.log1p(-self.rate))) if self.rate < 1 else 1

    def _rate(self, axes: int, limit: float) -> float:
        """How often two vectors of the wanted cosine share a code, a little below what is measured."""
        r = np.random.default_rng(7)
        a, b = (r.normal(size=(TRIALS, self.dims)) for _ in range(2))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        b = limit * a + math.sqrt(max(0.0, 1 - limit * limit)) * b
        met = (tops(a, 0, axes, self.probes)[:, :, None] == tops(b, 0, axes, self.probes)[:, None, :]).any(axis=(1, 2)).mean()
        return max(0.01, float(met) - 3 * math.sqrt(float(met * (1 - met)) / TRIALS) - 1e-4)

    def signature(self, unit: np.ndarray) -> np.ndarray:
        """Codes (row, table, polytope, probe)."""
        k = len(self.axes)
        codes = [[tops(unit, t * k + p, axes, self.probes) for p, axes in enumerate(self.axes)] for t in range(self.tables)]
        return np.array(codes, np.int16).reshape(self.tables, k, len(unit), self.probes).transpose(2, 0, 1, 3)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """The buckets of each row: the table's number before one code of each polytope, as digits of a number."""
        n = len(signature)
        base = 2 * self.dims
        found = np.broadcast_to(np.arange(self.tables, dtype=np.int64)[None, :, None], (n, self.tables, 1))
        for p in range(len(self.axes)):
            found = (found[:, :, :, None] * base + signature[:, :, p, None, :]).reshape(n, self.tables, -1)
        return found.reshape(n, -1)

    def first_key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first bucket that the rows of two signatures share, -1 for none: the first table, the least code in each polytope."""
        base = 2 * self.dims
        n = len(a)
        key, open_ = np.full(n, -1, np.int64), np.ones(n, bool)
        for t in range(self.tables):
            least = np.full((n, len(self.axes)), base, np.int64)
            for x in range(self.probes):
                shared = (a[:, t, :, x, None] == b[:, t]).any(axis=2)
                least = np.where(shared, np.minimum(least, a[:, t, :, x]), least)
            here = np.full(n, t, np.int64)
            for p in range(len(self.axes)):
                here = here * base + least[:, p]
            new = open_ & (least < base).all(axis=1)
            key[new] = here[new]
            open_ &= ~new
            if not open_.any():
                break
        return key


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, which rows take part, components of those) of a list column of numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64(), safe=False)
    value = flat.to_numpy(zero_copy_only=False) if not flat.null_count else flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    good = np.bincount(row[~np.isfinite(value)], minlength=len(size)) == 0
    good &= np.bincount(row[value != 0], minlength=len(size)) > 0
    return size, good, value


def _packed(dims: int, kind: str):
    """vec_id and the vector as bytes, padded with zeros to ``dims``; null where it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, good, value = _rows(batch.column(1))
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            out = np.zeros((len(size), dims), kind)
            held = good[row]
            out[row[held], place[held]] = value[held]
            out += 0.0  # a negative zero is a zero
            raw, step = out.tobytes(), dims * out.itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[i * step : (i + 1) * step] if ok else None for i, ok in enumerate(good.tolist())], pa.binary())], names=["vec_id", "v"])

    return run


def unit_vectors(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if x.shape[1] < dims else x


def _hashed(plan: Plan, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                signature = plan.signature(unit_vectors(part.column(3), kind, plan.dims))
                keys, raw = plan.keys(signature), np.ascontiguousarray(signature).tobytes()
                step = len(raw) // part.num_rows
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                codes = pa.array([raw[i * step : (i + 1) * step] for i in range(part.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, codes, lists], names=[*part.schema.names, "codes", "keys"])

    return run


def _heads(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of n rows hangs together with by the links i, j."""
    head = np.arange(n)
    while True:
        least = np.minimum(head[i], head[j])
        new = head.copy()
        for side in (i, j, head[i], head[j]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == head).all():
            return head
        head = new


#: Cosines that a task looks at together.
_CELLS = 1 << 20


def _compare(plan: Plan, kind: str, limit: float):
    """Per class of a square: the rows it links with there, and the least class it hangs together with."""

    def work(table: pa.Table, groups) -> pa.RecordBatch:
        key, cid, copies, side = (table.column(c).to_numpy() for c in ("key", "cid", "copies", "side"))
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int16).reshape(len(cid), plan.tables, len(plan.axes), plan.probes)
        found = []
        for a, b in groups:
            left, right = np.flatnonzero(side[a:b] <= 0), np.flatnonzero(side[a:b] >= 0)
            if not len(left) or not len(right):
                continue
            unit, n = unit_vectors(table.column("v").slice(a, b - a), kind, plan.dims), b - a
            links, order = np.zeros(n), np.argsort(cid[a:b], kind="stable")
            rank, head = np.argsort(order), np.arange(n)  # head: by rank of the cid
            step = max(1, _CELLS // len(right))
            for at in range(0, len(left), step):
                i, j = np.nonzero(unit[left[at : at + step]] @ unit[right].T >= limit)
                i, j = left[at + i], right[j]
                if side[a] == 0:  # a block with itself: each pair once
                    i, j = i[i < j], j[i < j]
                first = plan.first_key(codes[a + i], codes[a + j]) == key[a]
                i, j = i[first], j[first]
                if len(i):
                    links += np.bincount(i, copies[a + j], n) + np.bincount(j, copies[a + i], n)
                    head = _heads(n, np.concatenate((np.arange(n), rank[i])), np.concatenate((head, rank[j])))
            rows = np.flatnonzero(links)
            found.append((cid[a + rows], links[rows].astype(np.int64), cid[a + order[head[rank[rows]]]]))
        columns = [np.concatenate([x[c] for x in found]) if found else np.zeros(0, np.int64) for c in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cid", "links", "head"])

    return work


def near_duplicates(vectors: DataFrame, limit: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other rows of cosine ``limit`` or more), component_id, kept."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
    found = source.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    dims = max(1, found[1] or 1)
    kind = "f4" if dict(source.dtypes)["x"] == "array<float>" else "f8"
    plan = Plan(found[0], dims, limit)
    rows = source.mapInArrow(trimmed(_packed(dims, kind)), "vec_id long, v binary")
    rows = materialize(rows.withColumn("same", F.unhex(F.md5("v"))), "vectors-rows")

    classes = rows.filter("v IS NOT NULL").groupBy("same").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"), F.any_value("v").alias("v"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors-classes")
    schema = "cid long, copies long, rep long, v binary, codes binary, keys array<long>"
    hashed = materialize(classes.select("cid", "copies", "rep", "v").mapInArrow(trimmed(_hashed(plan, kind)), schema), "vectors-hashed")

    entries = hashed.select("cid", F.explode("keys").alias("key"))
    shared = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key"), "vectors-keys")
    members = materialize(entries.join(shared, "key"), "vectors-members")
    full = materialize(members.join(hashed.select("cid", "copies", "v", "codes"), "cid"), "vectors-buckets")
    linked = by_squares(full, _compare(plan, kind, limit), "cid long, links long, head long", "vectors-linked", heavy="v")
    parts = materialize(components(linked.select(F.col("cid").alias("u"), F.col("head").alias("v"))), "vectors-parts")
    links = linked.groupBy("cid").agg(F.sum("links").alias("links"))

    own = classes.select("cid", "same", "copies", "rep").join(links, "cid", "left").join(parts, F.col("cid") == F.col("node"), "left")
    own = materialize(own.select("same", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "vectors-own")
    least = materialize(own.groupBy("component").agg(F.min("rep").alias("component_id")), "vectors-least")
    placed = materialize(own.join(least, "component").select("same", "n_links", "component_id"), "vectors-placed")
    discard(classes, hashed, shared, members, full, linked, parts, own, least)
    joined = rows.filter("same IS NOT NULL").select("vec_id", "same").join(placed, "same").select("vec_id", "n_links", "component_id")
    alone = rows.filter("same IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v,
         coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS takes_part
  FROM embeddings
), links AS (
  SELECT a.r AS a, b.r AS b FROM vectors a JOIN vectors b ON a.takes_part AND b.takes_part AND a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.9
), reached AS (
  SELECT r AS a, r AS b FROM vectors UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
), least AS (
  SELECT a, min(vec_id) AS component_id FROM reached JOIN vectors ON r = b GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = r) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM vectors JOIN least ON a = r
"""
