"""Substring dedup on sentences: every run of several consecutive sentences, hashed and joined globally.

A sentence ends with a word that ends in a stop of its script (closing quotes or brackets may
follow), and at line ends. Where ``WINDOW`` words in a row have no such end, the one with the
least hash ends a piece, so that no piece is longer; the pieces count as sentences. An end is set by
at most ``WINDOW`` - 1 words on either side of it, so a passage has the same ends wherever it stands, in
mid-sentence too, but for that many words at its edges. In scripts that are written without
blanks each character is a word.

From each sentence starts the run of the fewest sentences, ``RUN`` at least, that
has ``LEAST_WORDS`` words or ``MOST`` sentences, and with each ends the run of the fewest that has them; so
every run of ``MOST`` sentences is looked at, however short they are, and runs are set by their own text. Any passage
of 50 words has a full run: its common ends begin within its first 15 words and reach to its last 15, and the 20
words between them hold a run, which has 19 at most. Runs compare by their words, A-Z as a-z. Of equal
runs the first, by doc_id and then by place, stays; every sentence that any other covers goes.

Runs are counted with map-side sums, so that a frequent run is one row per task; only runs
that a Bloom filter of the repeated ones passes go through the join.

Defined results: a null text counts as empty; a text without a full run loses nothing;
rows that repeat doc_id and text are the same document and no repeats of each other; rows that share a
doc_id, or have none, are documents by their texts (those without an id come last); an empty table gives an empty
result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bloom
from quillon.llm.kernels import U, mix64, powers, slices, text_buffers, trimmed, word_hash, words
from quillon.session import materialize

RUN, LEAST_WORDS, MOST, WINDOW = 2, 12, 3, 8
_STOPS = np.array(sorted(map(ord, ".!?\u2026\u203c\u2047\u2048\u2049\u3002\uff0e\uff01\uff1f\uff61\u0589\u061f\u06d4\u0964\u0965\u0f0d\u0f0e\u104a\u104b\u1362\u1367\u1368\u17d4\u17d5")))
_CLOSING = np.array(sorted(map(ord, "\"')]\u00bb\u2019\u201d\u203a\u3009\u300b\u300d\u300f\u3011\u3015\uff09\uff3d\uff63")))
#: Thai to Tibetan, Myanmar, Khmer, Tai Le to Khmer symbols, Tai Tham, kana and bopomofo, Han. Beyond the BMP: planes 2 and 3.
_BLANKLESS = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D))


@lru_cache(maxsize=1)
def _alone() -> np.ndarray:
    """Of each code point of the BMP: is it a word by itself? Marks and punctuation stay with what they follow."""
    table = np.zeros(1 << 16, bool)
    for lo, hi in _BLANKLESS:
        table[lo : hi + 1] = [unicodedata.category(chr(c))[0] in "LN" for c in range(lo, hi + 1)]
    return table


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a slice's words; those of blankless scripts are cut into characters."""
    starts, ends = words(data, offsets[:-1])
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + 2 < len(data)]
    if not len(at):
        return starts, ends
    lead, second = data[at].astype(np.int64), data[at + 1].astype(np.int64)
    code = (lead & 15) << 12 | (second & 63) << 6 | data[at + 2] & 63
    at = at[np.where(lead < 0xF0, _alone()[code], (lead == 0xF0) & (second >= 0xA0))]
    more = at[starts[np.searchsorted(starts, at, side="right") - 1] != at] if len(at) else at
    return (np.sort(np.concatenate((starts, more))), np.sort(np.concatenate((ends, more)))) if len(more) else (starts, ends)


def _last_char(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code point before each end, and where it begins; 0 and the end at a start."""
    byte = lambda n: data[np.maximum(ends - n, 0)].astype(np.int64)
    code, size = byte(1), np.ones(len(ends), np.int64)
    wide = code >= 0x80
    if wide.any():
        b1, b2, b3 = code, byte(2), byte(3)
        size = np.where(~wide, 1, np.where(b2 >= 0xC0, 2, np.where(b3 >= 0xE0, 3, 4)))
        three = (b3 & 15) << 12 | (b2 & 63) << 6 | b1 & 63
        code = np.where(size == 2, (b2 & 31) << 6 | b1 & 63, np.where(size == 3, three, np.where(size == 4, 0, code)))
    empty = ends <= starts
    return np.where(empty, 0, code), np.where(empty, ends, ends - size)


def _ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Does the word end with a stop, which may stand before two closing quotes or brackets?"""
    code, at = _last_char(data, starts, ends)
    for _ in range(2):
        closing = np.flatnonzero(np.isin(code, _CLOSING))
        if not len(closing):
            break
        code[closing], at[closing] = _last_char(data, starts[closing], at[closing])
    return np.isin(code, _STOPS)


def _least(hashed: np.ndarray, stops: np.ndarray, window: int) -> np.ndarray:
    """Which words have the least hash of some ``window`` words in a row without a stop? All of several equal ones."""
    n = len(hashed)
    if n < window:
        return np.zeros(n, bool)
    h = np.where(stops, U(0), hashed | U(1))
    least = h[: n - window + 1].copy()
    for i in range(1, window):
        np.minimum(least, h[i : n - window + 1 + i], out=least)
    of = np.zeros(n, U)
    for i in range(window):
        np.maximum(of[i : n - window + 1 + i], least, out=of[i : n - window + 1 + i])
    return (of == h) & ~stops


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """What ``sentences`` returns, and the words' hashes."""
    starts, ends = units(data, offsets)
    if not len(starts):
        return starts, ends, starts, starts, np.zeros(0, U)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    over = _ends(data, starts, ends)
    over[:-1] |= (lines[starts[1:]] > lines[ends[:-1]]) | (doc[1:] != doc[:-1])
    over[-1] = True
    hashed = word_hash(data, starts, ends)
    first = np.concatenate(([0], np.flatnonzero((over | _least(hashed, over, WINDOW))[:-1]) + 1))
    return starts, ends, first, doc[first], hashed


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: (word starts, word ends, each sentence's first word, each sentence's document)."""
    return _split(data, offsets)[:4]


def runs(data: np.ndarray, offsets: np.ndarray, run: int = RUN, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """Of a slice's full runs: (document, hash, first sentence and one past the last in the document, seen before in it)."""
    starts, _, first, doc, hashed = _split(data, offsets)
    n = len(first)
    if n == 0:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool))
    upto = np.append(first, len(starts))
    place = np.arange(n)
    end = np.maximum(np.minimum(np.searchsorted(upto, first + least_words), place + max(run, MOST)), place + run)
    full = np.flatnonzero(end <= np.searchsorted(doc, doc, side="right"))
    back = np.minimum(np.maximum(np.searchsorted(upto, upto[1:] - least_words, side="right") - 1, place + 1 - max(run, MOST)), place + 1 - run)
    whole = np.flatnonzero(back >= np.searchsorted(doc, doc))
    whole = whole[end[back[whole]] != whole + 1]  # that run is there
    full, end = np.concatenate((full, back[whole])), np.concatenate((end[full], whole + 1))
    base = np.searchsorted(doc, doc[full])
    total = np.zeros(len(hashed) + 1, U)
    np.cumsum(hashed * powers(len(hashed)), out=total[1:])
    key = mix64((total[upto[end]] - total[first[full]]) * powers(len(total), inverse=True)[first[full]]).view(np.int64)
    own = doc[full]
    order = np.lexsort((end, full, key, own))
    again = np.zeros(len(full), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    return own, key, full - base, end - base, again


def _emit(run: int, least_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                doc, key, a, b, again = runs(data[part[0] : part[-1]], part - part[0], run, least_words)
                at = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(key), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(again)],
                    names=["doc_id", "t", "key", "a", "b", "again"],
                )

    return work


def repeated_sentences(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per (doc_id, t = xxhash64 of the text) with any: spans array<struct<s:int,e:int>> of sentence numbers to remove."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = materialize(texts.mapInArrow(trimmed(_emit(run, least_words)), "doc_id long, t long, key long, a int, b int, again boolean"), "spans-runs")
    # The first by doc_id, null last, then by text: rows that share an id, or have none, are documents by their texts.
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    first = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f")).filter("n > 1")
    first = materialize(first.select("key", F.col("f.doc_id").alias("first_doc"), F.col("f.t").alias("first_t")), "spans-repeated")
    some = bloom.only_known(found, "key", first, first.count())
    later = some.join(first, "key").filter("again OR NOT (doc_id <=> first_doc AND t = first_t)")
    return later.groupBy("doc_id", "t").agg(F.collect_set(F.struct(F.col("a").alias("s"), F.col("b").alias("e"))).alias("spans"))


def _cut(raw: bytes, begin: np.ndarray, spans: list[dict]) -> tuple[list[tuple[int, int]], bytes]:
    """(removed sentence ranges as maximal runs, kept bytes); ``begin``: where each sentence starts."""
    gone = np.zeros(len(begin) + 1, bool)
    for s in spans:
        gone[s["s"] : s["e"]] = True
    edge = np.diff(np.concatenate(([False], gone)).astype(np.int8))
    ranges = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
    kept, at = [], 0
    for a, b in ranges:
        kept.append(raw[at : begin[a]])
        at = int(begin[b]) if b < len(begin) else len(raw)
    return ranges, b"".join([*kept, raw[at:]])


def dedup(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per document: doc_id, n_sentences, n_removed (sentences), removed (list of "first:end"), kept_text."""
    spans = materialize(repeated_sentences(docs, run, least_words), "spans-removed")
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    blocks = bloom.block_count(spans.count())
    hashed = F.xxhash64("doc_id", "t")
    probed = bloom.probe(texts, hashed, blocks, bloom.build(spans, hashed, blocks), "_maybe")
    own = spans.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "spans")
    joined = probed.filter("_maybe").join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left").select("doc_id", "text", "spans")
    rest = probed.filter("NOT _maybe").select("doc_id", "text", F.lit(None).cast("array<struct<s:int,e:int>>").alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            spans = batch.column(2).to_pylist()
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1] - offsets[lo]
                own = data[offsets[lo] : offsets[hi]]
                starts, _, first, doc = sentences(own, part)
                raw, begin = own.tobytes(), starts[first]
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                rows = []
                for i in range(hi - lo):
                    text, n = raw[part[i] : part[i + 1]], int(at[i + 1] - at[i])
                    ranges, kept = _cut(text, begin[at[i] : at[i + 1]] - part[i], spans[lo + i]) if spans[lo + i] else ([], text)
                    rows.append((n, sum(b - a for a, b in ranges), ",".join(f"{a}:{b}" for a, b in ranges), kept.decode()))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=["doc_id", "n_sentences", "n_removed", "removed", "kept_text"])

    return joined.unionByName(rest).mapInArrow(trimmed(work), "doc_id long, n_sentences long, n_removed long, removed string, kept_text string")


def report(deduped: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed, kept_sha256."""
    return deduped.select("doc_id", "n_sentences", "n_removed", "removed", F.sha2("kept_text", 256).alias("kept_sha256"))
