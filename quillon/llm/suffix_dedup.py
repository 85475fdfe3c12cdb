"""Substring dedup by a distributed sparse suffix array, sorted deep-shallow.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too.

1. Anchors. Of the KGRAM-byte strings in a window of LENGTH bytes the one of least hash is the
   window's anchor, so equal windows have equal anchors at equal offsets. The windows of one
   anchor start next to each other, one place in some 80 bytes; the bytes that they cover are
   the anchor's context. Anchors met once settle their windows; the rest go on, found by a
   Bloom filter of repeated anchors.
2. Classes. Occurrences with equal anchor and equal context (128 hash bits) are one class. A
   class of two or more has all its windows repeated.
3. Suffix arrays. Where one anchor has different contexts, one context of each class goes to a
   task, which sorts the suffixes from the anchors to the right and the reversed prefixes to the
   left. Two windows are equal if the common prefixes in both orders reach to their ends.
4. An anchor with more than CLASSES contexts is split: by halves of the windows' offsets, each
   half grouped by the bytes that all its windows share, until every group is small. Equal
   windows always stay together, so nothing is missed, and no key is too large for a task.

Defined results: a null text counts as empty; texts shorter than LENGTH lose nothing;
repeated rows are repeats of each other and go whole if long enough; matches overlap
freely, also within one document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bloom
from quillon.llm.kernels import U, prefix_hash, range_hash, slices, text_buffers, trimmed
from quillon.llm.suffix_sort import deep_shallow_sort
from quillon.session import materialize

LENGTH = 200
#: Most classes of one anchor in a task, and about so many of all anchors.
CLASSES, BUCKET = 512, 8192


def anchor_length(length: int) -> int:
    return max(8, length // 4)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Of a slice: doc, start (first window), n (windows), at (anchor), key, ctx."""
    k = anchor_length(length)
    wide, n = length - k + 1, len(data)
    if n < length:
        return {x: np.zeros(0, np.int64) for x in ("doc", "start", "n", "at", "key", "ctx")}
    prefix = prefix_hash(data)
    hashed = range_hash(prefix, np.arange(n - k + 1), np.arange(k, n + 1))
    # Hash and place in one word: the least is the leftmost of those with the least hash.
    least = (hashed >> U(31) << U(31)) | np.arange(len(hashed), dtype=U)
    done = 1
    while 2 * done <= wide:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if wide > done:
        least = np.minimum(least[: len(least) - (wide - done)], least[wide - done :])
    at = (least & U((1 << 31) - 1)).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int64)
    first, last = offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])
    np.add.at(inside, np.minimum(first, len(at)), 1)
    np.add.at(inside, np.minimum(last, len(at)), -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    doc = np.searchsorted(offsets, start, side="right") - 1
    at = at[start]
    begin = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))) if len(start) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(start)))
    start, doc, at = start[begin], doc[begin], at[begin]
    return {"doc": doc, "start": start, "n": count, "at": at, "key": hashed[at].view(np.int64), "ctx": range_hash(prefix, start, start + count - 1 + length).view(np.int64)}


def _found(batches: Iterator[pa.RecordBatch], length: int):
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for a, b in slices(offsets):
            own = offsets[a : b + 1]
            part = data[own[0] : own[-1]]
            yield batch, a, part, own - own[0], anchors(part, own - own[0], length)


def _first_pass(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, f in _found(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(f["key"]), pa.array(f["ctx"])], names=["key", "ctx"])

    return run


class _Filter:
    """A Bloom filter of anchors in the tasks' memory; 32 MiB at most (bloom.MAX_BLOCKS)."""

    def __init__(self, keys: DataFrame):
        blocks = bloom.block_count(keys.count())
        bits = np.zeros((blocks, bloom.BLOCK_BITS // 8), np.uint8)
        for row in bloom.build(keys, F.col("key"), blocks).toLocalIterator():
            bits[row["_block"]] = np.frombuffer(row["_bits"], np.uint8)
        self.bits = bits

    def holds(self, keys: np.ndarray) -> np.ndarray:
        block, u, found = np.mod(keys, len(self.bits)), keys.view(U), np.ones(len(keys), bool)
        for shift in (19, 34, 49):
            bit = ((u >> U(shift)) & U(bloom.BLOCK_BITS - 1)).astype(np.int64)
            found &= (self.bits[block, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
        return found


HITS = "doc_id long, t long, key long, ctx long, start long, a int, w int, bytes binary"


def _second_pass(length: int, repeated, mixed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, data, offsets, f in _found(batches, length):
            keep = np.flatnonzero(repeated.value.holds(f["key"]))
            doc, start, count, at, key = (f[x][keep] for x in ("doc", "start", "n", "at", "key"))
            raw = data.tobytes()
            known = mixed.value.holds(key).tolist()
            held = [raw[s : s + n - 1 + length] if yes else None for s, n, yes in zip(start.tolist(), count.tolist(), known, strict=True)]
            ids, t = (batch.column(x).take(pa.array(doc + row)) for x in ("doc_id", "t"))
            yield pa.RecordBatch.from_arrays(
                [ids, t, pa.array(key), pa.array(f["ctx"][keep]), pa.array(start - offsets[doc]), pa.array((at - start).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(held, pa.binary())],
                names=["doc_id", "t", "key", "ctx", "start", "a", "w", "bytes"],
            )

    return run


def _repeated_windows(length: int):
    """Of the classes in a table: which windows of a class of one occur in another class."""
    k = anchor_length(length)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        text = table.column("bytes").to_pylist()
        a, w = table.column("a").to_numpy(), table.column("w").to_numpy()
        n, alone = len(text), table.column("n").to_numpy() == 1
        right, right_lcp = deep_shallow_sort([s[x:] for s, x in zip(text, a.tolist(), strict=True)], k // 8 * 8)
        left, left_lcp = deep_shallow_sort([s[: x + k][::-1] for s, x in zip(text, a.tolist(), strict=True)], k // 8 * 8)
        right_rank, left_rank = np.empty(n, np.int64), np.empty(n, np.int64)
        right_rank[right], left_rank[left] = np.arange(n), np.arange(n)
        seen = np.zeros((n, length - k + 2), bool)
        for o in range(length - k + 1):  # windows that start o bytes before the anchor
            has = np.flatnonzero((o <= a) & (o > a - w))
            run_left, run_right = np.cumsum(left_lcp < k + o), np.cumsum(right_lcp < length - o)
            both = run_left[left_rank[has]] * (n + 1) + run_right[right_rank[has]]
            _, which, count = np.unique(both, return_inverse=True, return_counts=True)
            seen[has[count[which] > 1], o] = True
        seen &= alone[:, None]
        edge = np.diff(np.pad(seen, ((0, 0), (1, 0))).astype(np.int8), axis=1)
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return pa.table({"key": table.column("key").take(pa.array(row)), "ctx": table.column("ctx").take(pa.array(row)), "lo": pa.array((a[row] - high + 1).astype(np.int32)), "hi": pa.array((a[row] - low + 1).astype(np.int32))})

    return run


def _covered(classes: DataFrame, length: int) -> DataFrame:
    """Repeated windows lo <= i < hi of each class: key, ctx, lo, hi. ``classes``: key, ctx, n, a, w, bytes."""
    found = [classes.filter("n > 1").select("key", "ctx", F.lit(0).alias("lo"), F.col("w").alias("hi"))]
    pieces = classes.filter("bytes IS NOT NULL").withColumns({"root_key": F.col("key"), "root_ctx": F.col("ctx"), "base": F.lit(0)})
    size = 1 << (length - 1).bit_length()
    top = length - anchor_length(length)
    while True:
        if size < 1 << (length - 1).bit_length():
            # Halves of the offsets; a half's key is what all of its windows cover.
            low, high = F.greatest(F.col("b") * size, F.col("a") - F.col("w") + 1), F.least((F.col("b") + 1) * size - 1, F.col("a"))
            begin, last = F.col("b") * size, F.least((F.col("b") + 1) * size - 1, F.lit(top))
            half = pieces.withColumn("b", F.explode(F.sequence(F.floor((F.col("a") - F.col("w") + 1) / size), F.floor(F.col("a") / size))))
            half = half.withColumns({"low": low.cast("int"), "high": high.cast("int")})
            half = half.withColumns({"base": F.col("base") + F.col("a") - F.col("high"), "w": F.col("high") - F.col("low") + 1, "bytes": F.substring("bytes", F.col("a") - F.col("high") + 1, F.col("high") - F.col("low") + length), "a": F.col("high")})
            core = F.substring("bytes", (F.col("a") - begin + 1).cast("int"), (length - last + begin).cast("int"))
            pieces = half.withColumns({"key": F.xxhash64("key", "b", core), "ctx": F.xxhash64("bytes", "low", "high")}).drop("b", "low", "high")
            pieces = materialize(pieces, "suffix-pieces")
            own = materialize(pieces.groupBy("key", "ctx").agg(F.sum("n").alias("n"), *(F.any_value(x).alias(x) for x in ("a", "w", "bytes"))), "suffix-classes")
        else:
            own = pieces.select("key", "ctx", "n", "a", "w", "bytes")
        counts = materialize(own.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "suffix-keys")
        total = counts.filter(f"c <= {CLASSES}").agg(F.sum("c")).first()[0] or 0
        dealt = own.join(counts.filter(f"c <= {CLASSES}").select("key"), "key").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(-(-total // BUCKET) or 1)))
        ranges = dealt.groupBy("bucket").applyInArrow(_repeated_windows(length), "key long, ctx long, lo int, hi int")
        if size == 1 << (length - 1).bit_length():
            found.append(materialize(ranges, "suffix-ranges"))
        else:
            ranges = materialize(ranges.union(own.filter("n > 1").select("key", "ctx", F.lit(0), "w")), "suffix-ranges")
            found.append(pieces.join(ranges, ["key", "ctx"]).select(F.col("root_key").alias("key"), F.col("root_ctx").alias("ctx"), F.col("base") + F.col("lo"), F.col("base") + F.col("hi")))
        hot = counts.filter(f"c > {CLASSES}").select("key")
        if size == 1 or hot.isEmpty():
            return reduce(DataFrame.union, found)
        pieces, size = pieces.join(F.broadcast(hot) if hot.count() <= 10_000 else hot, "key"), size // 2


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Byte ranges to remove, per distinct (doc_id, t = xxhash64 of the text): spans array<struct<s:long,e:long>>, which may overlap."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    seen = texts.select("text").mapInArrow(trimmed(_first_pass(length)), "key long, ctx long")
    seen = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).filter("n > 1")
    seen = materialize(seen.select("key", (F.col("lo") != F.col("hi")).alias("mixed")), "suffix-repeated")
    share = docs.sparkSession.sparkContext.broadcast
    hits = texts.mapInArrow(trimmed(_second_pass(length, share(_Filter(seen)), share(_Filter(seen.filter("mixed"))))), HITS)
    hits = materialize(hits, "suffix-hits")
    counted = hits.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.min("w").alias("w"))
    one = hits.filter("bytes IS NOT NULL").select("key", "ctx", "bytes").dropDuplicates(["key", "ctx"])
    classes = materialize(counted.join(one, ["key", "ctx"], "left"), "suffix-classes")
    ranges = materialize(_covered(classes, length), "suffix-covered")
    spans = hits.select("doc_id", "t", "key", "ctx", "start").join(ranges, ["key", "ctx"])
    spans = spans.select("doc_id", "t", F.struct((F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi") - 1 + length).alias("e")).alias("span"))
    return materialize(spans.groupBy("doc_id", "t").agg(F.collect_list("span").alias("spans")), "suffix-spans")


def merged(spans: np.ndarray, size: int) -> np.ndarray:
    """Overlapping and touching (s, e) rows as maximal runs, in order."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(np.minimum(spans[:, 1], size))
    begin = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[begin, 0], reach[np.append(begin[1:], len(spans)) - 1]), axis=1)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row's doc_id, text and spans (null if none); rows without spans do not shuffle."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    blocks = bloom.block_count(spans.count())
    hashed = F.xxhash64("doc_id", "t")
    probed = bloom.probe(texts, hashed, blocks, bloom.build(spans, hashed, blocks), "_maybe")
    own = spans.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "spans")
    joined = probed.filter("_maybe").join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    none = F.lit(None).cast("array<struct<s:bigint,e:bigint>>").alias("spans")
    return joined.select("doc_id", "text", "spans").unionByName(probed.filter("NOT _maybe").select("doc_id", "text", none))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    data, offsets = text_buffers(batch.column("text"))
    lists = batch.column("spans")
    flat = lists.flatten()
    flat = np.stack((flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)), axis=1) if len(flat) else np.zeros((0, 2), np.int64)
    sizes = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    for i in range(batch.num_rows):
        raw = data[offsets[i] : offsets[i + 1]].tobytes()
        yield raw, merged(flat[ends[i] - sizes[i] : ends[i]], len(raw))


def _rest(raw: bytes, runs: np.ndarray) -> bytes:
    cuts = [0, *runs.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(_rest(raw, runs)).hexdigest()) for raw, runs in _runs(batch)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs, repeated_bytes(docs, length)).mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, kept (the remaining bytes; a cut may part a character)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_rest(raw, runs) for raw, runs in _runs(batch)], pa.binary())], names=["doc_id", "kept"])

    return with_spans(docs, repeated_bytes(docs, length)).mapInArrow(trimmed(run), "doc_id long, kept binary")
