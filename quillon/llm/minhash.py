"""Near duplicates by MinHash bands, with odd sketches before exact verification.

1. Each text becomes its set of distinct k-word shingles (64-bit hashes), 128 MinHash
   values, 32 band keys of 4 values and an odd sketch: the values fold into a 256-bit
   parity map, in which the population count of two maps' XOR tells how many values
   differ.
2. Rows with the same set (its size and 128 hash bits) form a class, whatever their doc_ids;
   the graph is one of classes.
3. Each class is tested with the least class that shares a band key with it: pairs whose
   XOR count excludes the wanted similarity at five and a half standard deviations go, the
   others are verified on their full sets. Links give components.
4. A band key whose classes are still in different components is open. Within an open key the
   sketches of classes in different components are compared, in squares of bounded blocks;
   a pair counts under the first band key that it shares. Only classes with a promising
   partner go on with their full sets, and are verified in squares again, most similar first.
   What leaves a task is a row per class, then links that join components.

So no group is expanded into rows for its pairs, work grows with the sizes of open keys and
not with what chains of them tie together, and no link between two components is
passed over. Two texts of similarity 0.8 share no band with probability 5e-8.

Defined results: null, empty and blank texts have no shingle, link to nothing and are
their own component; fewer words than a shingle make one shingle of the whole; rows that
repeat a doc_id are judged each by its own text, so one doc_id can have several components;
a row with a null doc_id takes part, its component_id is the least doc_id reachable, null if
there is none, and ``kept`` is null-safe equality; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import bloom
from quillon.llm.components import components
from quillon.llm.kernels import U, mix64, slices, text_buffers, trimmed, word_hash, words
from quillon.llm.squares import by_squares
from quillon.session import discard, materialize

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
SKETCH_BITS = 256
SIGMAS = 5.5

_A = (mix64(np.arange(1, HASHES + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
_B = (mix64(np.arange(1001, HASHES + 1001, dtype=U)) >> U(32)).astype(np.uint32)
_C = mix64(np.arange(2001, HASHES + 2001, dtype=U))
_WORD = mix64(np.arange(3001, 3065, dtype=U)) | U(1)


def xor_bound(percent: int) -> int:
    """Most XOR bits that a pair of the wanted similarity shows, within SIGMAS deviations."""
    j = percent / 100
    differ = HASHES * (1 - j) + SIGMAS * math.sqrt(HASHES * j * (1 - j))
    differ = min(differ, HASHES)
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ))
    return math.ceil(mean + 2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents, offsets) of a slice."""
    n_docs = len(offsets) - 1
    starts, ends = words(data, offsets[:-1])
    if not len(starts):
        return np.zeros(0, U), np.zeros(n_docs + 1, np.int64)
    hashed = word_hash(data, starts, ends)
    first = np.searchsorted(starts, offsets[:-1])
    last = np.append(first[1:], len(starts))
    whole = np.zeros(max(0, len(hashed) - k + 1), dtype=U)
    for i in range(k):
        whole += hashed[i : i + len(whole)] * _WORD[i]
    whole = mix64(whole)
    found: list[np.ndarray] = []
    sizes = np.zeros(n_docs, np.int64)
    for d in range(n_docs):
        a, b = first[d], last[d]
        if b - a >= k:
            s = np.sort(whole[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif b > a:
            s = mix64(np.array([np.add.reduce(hashed[a:b] * _WORD[32 : 32 + b - a])], dtype=U))
        else:
            continue
        sizes[d] = len(s)
        found.append(s)
    return np.concatenate(found), np.concatenate(([0], np.cumsum(sizes)))


def signatures(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches) of non-empty sets: (n, BANDS) int64 and (n, 4) int64."""
    n = len(offsets) - 1
    high = (sets >> U(32)).astype(np.uint32)
    least = np.empty((HASHES, n), np.uint32)
    work = np.empty_like(high)
    for j in range(HASHES):
        np.bitwise_xor(high, _B[j], out=work)
        np.multiply(work, _A[j], out=work)
        least[j] = np.minimum.reduceat(work, offsets[:-1])
    wide = least.astype(U)
    bands = np.empty((n, BANDS), U)
    for b in range(BANDS):
        key = np.full(n, _C[b])
        for r in range(ROWS):
            key = mix64(key * U(0x9E3779B97F4A7C15) + wide[b * ROWS + r])
        bands[:, b] = key
    place = (mix64(wide * U(0xD1342543DE82EF95) + _C[:, None]) >> U(56)).astype(np.int64)
    odd = np.zeros(n * SKETCH_BITS, np.uint8)
    for j in range(HASHES):
        odd[np.arange(n) * SKETCH_BITS + place[j]] ^= 1
    sketch = np.packbits(odd.reshape(n, SKETCH_BITS), axis=1).view(np.int64)
    return bands.view(np.int64), sketch


KEYS = ["k1", "k2", "n_shingles"]


def _set_keys(sets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words that stand for each set."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.add.reduceat(mix64(x), begin).view(np.int64) for x in (sets + U(1), sets ^ U(0xA5A5A5A5A5A5A5A5)))


SIGNED = "doc_id long, _row long, n_shingles long, k1 long, k2 long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                own = offsets[a : b + 1]
                sets, at = shingle_sets(data[own[0] : own[-1]], own - own[0], k)
                n, sizes = b - a, np.diff(at)
                full = sizes > 0
                k1, k2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
                bands, sketch = np.zeros((n, BANDS), np.int64), np.zeros((n, 4), np.int64)
                if full.any():
                    begin = at[:-1][full]
                    k1[full], k2[full] = _set_keys(sets, begin)
                    bands[full], sketch[full] = signatures(sets, np.append(begin, len(sets)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))).astype(np.int32)), pa.array(bands[full].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(sizes), pa.array(k1), pa.array(k2), lists, *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(4))],
                    names=["doc_id", "_row", "n_shingles", "k1", "k2", "bands", "s0", "s1", "s2", "s3"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                own = offsets[a : b + 1]
                sets, at = shingle_sets(data[own[0] : own[-1]], own - own[0], k)
                full = np.diff(at) > 0
                begin, end = at[:-1][full], at[1:][full]
                k1, k2 = _set_keys(sets, begin)
                raw = sets.tobytes()
                held = pa.array([raw[8 * x : 8 * y] for x, y in zip(begin, end, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(end - begin), held], names=[*KEYS, "shingles"])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate((x, y)))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = _shared(x, y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(v.as_buffer(), U) for v in batch.column(c)] for c in ("sa", "sb")]
            linked = pa.array([_alike(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(linked)

    return run


def _xor(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)), F.lit(0))


class Square:
    """The columns of a table of squares that both comparisons need."""

    def __init__(self, table: pa.Table):
        self.key, self.cid, self.component, self.size, self.side = (table.column(c).to_numpy() for c in ("key", "cid", "component", "n_shingles", "side"))
        self.sketch = np.stack([table.column(f"s{i}").to_numpy() for i in range(4)], axis=1).view(U)
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.sets = table.column("shingles") if "shingles" in table.column_names else None

    def promising(self, low: int, high: int, percent: int, bound: int) -> np.ndarray:
        """(XOR bits, row, row) of the pairs to verify: of different components, not excluded by
        their sketches or sizes, and met under the first band that they share."""
        side = self.side[low:high]
        left, right = low + np.flatnonzero(side <= 0), low + np.flatnonzero(side >= 0)
        found = []
        for i in left.tolist():
            # Side 0: a block against itself, each pair once; otherwise -1 against 1.
            others = right[right > i] if self.side[i] == 0 else right
            others = others[(self.component[others] != self.component[i])]
            n, m = self.size[others], self.size[i]
            others = others[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
            bits = np.bitwise_count(self.sketch[others] ^ self.sketch[i]).sum(axis=1).astype(np.int64)
            others, bits = others[bits <= bound], bits[bits <= bound]
            if len(others):
                shared = self.bands[others] == self.bands[i]
                first = self.bands[i][shared.argmax(axis=1)] == self.key[i]
                found.append(np.stack((bits[first], np.full(int(first.sum()), i), others[first])))
        return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


def _flag(percent: int, bound: int):
    def work(table: pa.Table, groups) -> pa.RecordBatch:
        square = Square(table)
        rows = [np.unique(square.promising(a, b, percent, bound)[1:]) for a, b in groups]
        rows = np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array(square.key[rows]), pa.array(square.cid[rows])], names=["key", "cid"])

    return work


def _verify(percent: int, bound: int):
    """Links of promising pairs, most similar first; a link joins two components, so that
    pairs within them need no look any more."""

    def work(table: pa.Table, groups) -> pa.RecordBatch:
        square, links = Square(table), []
        for a, b in groups:
            tests = square.promising(a, b, percent, bound)
            head: dict[int, int] = {}

            def top(c, head=head):
                while (up := head.get(c, c)) != c:
                    head[c] = head.get(up, up)
                    c = head[c]
                return c

            for _, i, j in tests[:, np.argsort(tests[0], kind="stable")].T.tolist():
                x, y = top(int(square.component[i])), top(int(square.component[j]))
                if x != y and _alike(*(np.frombuffer(square.sets[n].as_buffer(), U) for n in (i, j)), percent):
                    head[max(x, y)] = min(x, y)
                    links.append((int(square.cid[i]), int(square.cid[j])))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["u", "v"])

    return work


def classes_of(signed: DataFrame) -> DataFrame:
    """A row per distinct set: its keys, the number ``cid``, least doc_id ``rep``, bands and sketch."""
    of = [F.any_value(c).alias(c) for c in ("bands", "s0", "s1", "s2", "s3")]
    found = signed.filter("n_shingles > 0").groupBy(*KEYS).agg(F.min("doc_id").alias("rep"), *of)
    return materialize(found.withColumn("cid", F.monotonically_increasing_id()), "near-classes")


def linked(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Components of the classes: node, component (both cid); classes without a link have no row."""
    bound = xor_bound(percent)
    banded = classes.select("cid", F.explode("bands").alias("key"))
    # Written, so that the join is of two plain shuffles: Spark splits those where a key is frequent.
    shared = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("cid").alias("leader")).filter("_n > 1"), "near-keys")
    members = materialize(banded.join(shared.select("key", "leader"), "key"), "near-members")

    # The full sets of these, from rows with the doc_ids of theirs.
    wanted = materialize(members.select("cid").distinct().join(classes.select("cid", *KEYS, F.col("rep").alias("doc_id")), "cid"), "near-wanted")
    some = bloom.only_known(docs, "doc_id", wanted, wanted.count()).select("text").mapInArrow(trimmed(_sets(k)), "k1 long, k2 long, n_shingles long, shingles binary")
    sets = some.join(wanted.select("cid", *KEYS), KEYS).groupBy("cid").agg(F.any_value("shingles").alias("shingles"))
    sets = materialize(sets, "near-sets")

    # One test each: with the least leader of the keys.
    sketch = classes.select("cid", F.struct("s0", "s1", "s2", "s3").alias("s"))
    pairs = members.groupBy("cid").agg(F.min("leader").alias("a")).filter("a <> cid").select("a", F.col("cid").alias("b"))
    pairs = pairs.join(sketch.toDF("a", "x"), "a").join(sketch.toDF("b", "y"), "b").filter(_xor("x", "y") <= bound)
    pairs = materialize(pairs.select("a", "b"), "near-pairs")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    links = materialize(both.mapInArrow(trimmed(_confirm(percent)), "u long, v long"), "near-links")
    parts = materialize(components(links), "near-parts")

    # Keys whose classes are still in different components.
    placed = members.join(parts, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("component", "cid").alias("component"))
    placed = materialize(placed, "near-placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last")).filter("first <> last").select("key")
    open_ = placed.join(materialize(open_, "near-open"), "key")
    signs = classes.select("cid", "n_shingles", "bands", "s0", "s1", "s2", "s3")
    flagged = by_squares(open_.join(signs, "cid"), _flag(percent, bound), "key long, cid long", "near-flagged").distinct()
    exact = flagged.join(placed, ["key", "cid"]).join(signs, "cid").join(sets, "cid")
    more = by_squares(materialize(exact, "near-exact"), _verify(percent, bound), "u long, v long", "near-more")
    stars = parts.select(F.col("node").alias("u"), F.col("component").alias("v"))
    parts = components(stars.union(more))
    discard(shared, members, wanted, sets, pairs, links, placed)
    return parts


def _placed(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Each of ``rows`` (doc_id, text, _row): doc_id, _row, n_shingles, component; null for rows without a shingle."""
    signed = materialize(rows.mapInArrow(trimmed(_sign(k)), SIGNED), "near-signed")
    classes = classes_of(signed)
    parts = materialize(linked(rows, classes, k, percent), "near-parts")
    own = classes.join(parts, F.col("cid") == F.col("node"), "left").select(*KEYS, F.coalesce("component", "cid").alias("component"))
    own = materialize(own, "near-own")
    placed = materialize(signed.select("doc_id", "_row", *KEYS).join(own, KEYS, "left").drop("k1", "k2"), "near-rows")
    discard(signed, classes, parts, own)
    return placed


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    placed = _placed(docs.select("doc_id", "text", F.lit(0).cast("long").alias("_row")), k, percent)
    least = materialize(placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-least")
    out = placed.join(least, "component", "left")
    out = out.withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def survivors(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, whole with all its columns: the one of least doc_id.

    A null doc_id comes after all others, and of the rows that repeat the least doc_id one
    stays. Rows without a shingle (null, empty and blank texts) are no copies and all stay.
    Of the others only those that may go shuffle.
    """
    rows = materialize(bloom.packed(docs).withColumn("_row", F.monotonically_increasing_id()), "near-docs")
    placed = _placed(rows.select("row.doc_id", "row.text", "_row"), k, percent).filter("component IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    keepers = materialize(placed.groupBy("component").agg(first.alias("first")).select("first._row"), "near-keepers")
    gone = materialize(placed.select("_row").join(keepers, "_row", "left_anti"), "near-gone")
    blocks, hashed = bloom.block_count(gone.count()), F.xxhash64("_row")
    probed = bloom.probe(rows, hashed, blocks, bloom.build(gone, hashed, blocks), "_maybe")
    checked = probed.filter("_maybe").join(gone, "_row", "left_anti")
    return probed.filter("NOT _maybe").select("row.*").unionByName(checked.select("row.*"))
