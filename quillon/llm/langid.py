"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 code points, lower case) of every labelled text in
hash buckets: each task sums its own texts into one vector per language, and Spark adds
these by language and bucket. The log-probability matrix goes to all tasks, AT_ONCE
languages (16 MiB) at a time; with more languages the texts are scored once per slice of
them, which finds the same best language and posterior. A text's scores are the sums of its n-grams' rows.

Defined results: a null text or one without a letter is ``und`` with score 0; rows with
null labels are not learned from; without any training row every prediction is ``und``;
ties go to the first language in code point order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.kernels import trimmed
from quillon.session import materialize

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Languages in a broadcast, and in a task's counts before it hands them on.
AT_ONCE = 128
_SLICE = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str], most: int = _SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, one past the last, buckets, first gram of each text, has a letter), by slices.

    Each text stands between zero characters; n-grams that reach into a neighbour have two
    of these in a row and count for bucket 0, which is not used.
    """
    at, n = 0, len(texts)
    while at < n:
        end, size = at, 0
        while end < n and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end]) + 2
            end += 1
        part = texts[at:end]
        lower = [t.lower() for t in part]
        code = np.frombuffer(("\0" + "\0\0".join(lower) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(t) + 2 for t in lower])))[:-1]
        letter = np.add.reduceat(_letters()[code], starts) > 0
        found = []
        for k in ORDERS:
            h = np.full(len(code) - k + 1, 2166136261 + k, np.uint32)
            for i in range(k):
                h ^= code[i : i + len(h)]
                h *= np.uint32(2654435761)
                h ^= h >> np.uint32(15)
            bucket = (h % np.uint32(BUCKETS - 1)).astype(np.int32) + 1
            zero = code == 0
            for i in range(k - 1):
                both = zero[i : i + len(h)] & zero[i + 1 : i + 1 + len(h)]
                bucket[both] = 0
            if k == 1:
                bucket[zero] = 0
            found.append(np.pad(bucket, (0, k - 1)))
        yield at, end, np.stack(found), starts, letter
        at = end


def count_grams(labelled: DataFrame) -> DataFrame:
    """Of columns text, lang: lang, bucket, n. Bucket 0 counts the language's texts."""

    def counted(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in total.items():
            bucket = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(counts[bucket])], names=["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, buckets, starts, _ in _grams(texts):
                ends = np.append(starts[1:], buckets.shape[1])
                own = np.array(langs[a:b], dtype=object)
                owner = np.repeat(np.arange(b - a), ends - starts)
                for lang in set(langs[a:b]):
                    if lang not in total and len(total) >= AT_ONCE:
                        yield from counted(total)
                        total = {}
                    counts = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    chosen = own == lang
                    picked = buckets if chosen.all() else buckets[:, chosen[owner]]
                    found = np.bincount(picked.ravel(), minlength=BUCKETS)
                    found[0] = chosen.sum()
                    counts += found
        yield from counted(total)

    known = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = known.mapInArrow(trimmed(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return materialize(counts, "langid-counts")


def matrix(counts: DataFrame, langs: list[str], total_rows: int) -> np.ndarray:
    """float32, buckets x ``langs``, of log-probabilities; the last row holds the priors."""
    got = counts.filter(F.col("lang").isin(langs)).toArrow()
    grams = np.zeros((BUCKETS, len(langs)))
    column = got.column("lang").combine_chunks().dictionary_encode()
    place = np.array([langs.index(x) for x in column.dictionary.to_pylist()], np.int64)[column.indices.to_numpy()]
    grams[got.column("bucket").to_numpy(), place] = got.column("n").to_numpy()
    prior = np.log(np.maximum(grams[0], 1)) - np.log(max(1, total_rows))
    smooth = grams[1:] + 0.5
    logp = np.vstack([np.zeros(len(langs)), np.log(smooth / smooth.sum(axis=0))])
    return np.vstack([logp, prior]).astype(np.float32)


STATE = "doc_id long, text string, best string, top double, mass double"


def _score(rows: DataFrame, langs: list[str], table: np.ndarray, with_text: bool) -> DataFrame:
    """``rows`` (STATE; returned without the text after the last slice) after one more slice of languages: the best so far, its log-score, and
    the sum of all scores as a multiple of the best one's. ``best`` is ``und`` without a letter."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        prior = table[-1].astype(np.float64)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            name, top, mass = (batch.column(c).to_pylist() for c in ("best", "top", "mass"))
            for a, b, buckets, starts, letter in _grams(texts, max(1 << 13, (1 << 21) // len(langs))):
                total = prior + sum(np.add.reduceat(table[buckets[i]], starts, axis=0, dtype=np.float64) for i in range(len(ORDERS)))
                best = total.argmax(axis=1)
                high = total[np.arange(b - a), best]
                own = np.exp(total - high[:, None]).sum(axis=1)
                for i in range(a, b):
                    h, m = float(high[i - a]), float(own[i - a])
                    if not letter[i - a]:
                        name[i], top[i], mass[i] = "und", 0.0, math.inf
                    elif top[i] is None or h > top[i]:
                        name[i], top[i], mass[i] = langs[best[i - a]], h, m + (mass[i] * math.exp(top[i] - h) if top[i] is not None else 0.0)
                    else:
                        mass[i] += m * math.exp(h - top[i])
            kept = ["doc_id", "text"] if with_text else ["doc_id"]
            columns = [pa.array(name, pa.string()), pa.array(top, pa.float64()), pa.array(mass, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, "best", "top", "mass"])

    return rows.mapInArrow(trimmed(run), STATE if with_text else STATE.replace("text string, ", ""))


def predict(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document: doc_id, lang_pred, score (the posterior of the predicted language)."""
    langs = sorted(r.lang for r in counts.filter("bucket = 0").select("lang").collect())
    if not langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    total_rows = counts.filter("bucket = 0").agg(F.sum("n")).first()[0]
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("mass"))
    for i in range(0, len(langs), AT_ONCE):
        part = langs[i : i + AT_ONCE]
        rows = _score(materialize(rows, "langid-scores") if i else rows, part, matrix(counts, part, total_rows), i + AT_ONCE < len(langs))
    return rows.select("doc_id", F.col("best").alias("lang_pred"), (1 / F.col("mass")).alias("score"))


def identify(docs: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 4 = 2") -> DataFrame:
    """Train on the rows that are not held out, predict for all: doc_id, held_out, lang_pred, score."""
    return predict(docs, count_grams(docs.filter(f"NOT coalesce({held_out}, false)"))).select("doc_id", F.expr(f"coalesce({held_out}, false)").alias("held_out"), "lang_pred", "score")
