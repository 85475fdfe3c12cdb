"""Toxicity by a classifier chain of linear models.

The chain predicts the label categories one after the other; each model sees the text's
features and the probabilities of the categories before it. In training these are
out-of-fold predictions, so that a later model meets the same kind of probability as in
use. Features are the presence of hashed words and word stems (prefixes of 3 to 6
letters), kept where their count among positive rows stands out (|z| >= 4) and weighted
by their smoothed log-count ratio; the models are logistic regressions on these.

The models are fitted on a bounded sample of labelled rows (``SAMPLE``, least hash of the
doc_id first). Which features stand out is counted in Spark, over the sample and without each
fold, so that the driver gets no other (their number is bounded by the sample's vocabulary); all texts are scored whole. The decision threshold is the one of best F1 on
the out-of-fold predictions.

The categories are those that ``labels`` has. One, low quality, is no kind of toxicity; it stands
first because the chain needs an earlier category, and ``toxic`` alone decides.

Defined results: a text without a word (null and empty ones too) has no feature, gets the model's
base rate and is never called toxic; rows with null doc_id or null labels are not learned from; if a label
repeats, the larger counts; of rows that repeat a doc_id the one of least text hash is learned from, and all are
scored; without labels of both kinds nothing is toxic.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quillon.llm.bloom import packed
from quillon.llm.kernels import trimmed
from quillon.session import materialize

SAMPLE = 20_000
FOLDS = 4
DIMENSIONS = 1 << 20
STEMS = (3, 4, 5, 6)
LEAST_ROWS, LEAST_Z, SMOOTHING = 5, 4.0, 5.0
#: Categories in chain order, as SQL over the columns of ``labels``.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
_WORD = re.compile(r"[^\W\d_]+")
_KEPT_WORDS = 300_000


def word_features(word: str) -> tuple[int, ...]:
    stems = [word[:k] + "*" for k in STEMS if len(word) > k]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMENSIONS for x in (word, *stems))


def text_features(text: str | None, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """``known``: the caller's memo of words, cleared when it is large."""
    found: set[int] = set()
    if len(known) >= _KEPT_WORDS:
        known.clear()
    for word in set(_WORD.findall((text or "").lower())):
        own = known.get(word)
        if own is None:
            own = known[word] = word_features(word)
        found.update(own)
    return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass
class Linear:
    """Weights of chosen features, of the earlier categories' probabilities, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logit(self, total: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return total + earlier @ self.earlier + self.bias


@dataclass
class Rows:
    """Sparse presence rows: the features of row i are flat[at[i]:at[i + 1]], each under ``dims``."""

    flat: np.ndarray
    at: np.ndarray
    dims: int

    def parts(self, rows: int = 1000) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, one past the last, their features), a bounded part at a time."""
        for i in range(0, len(self.at) - 1, rows):
            j = min(i + rows, len(self.at) - 1)
            yield i, j, self.flat[self.at[i] : self.at[j]]

    def sums(self, model: Linear) -> np.ndarray:
        dense, out = np.zeros(self.dims), np.zeros(len(self.at) - 1)
        dense[model.features] = model.weights
        for i, j, flat in self.parts():
            out[i:j] = np.bincount(np.repeat(np.arange(j - i), np.diff(self.at[i : j + 1])), dense[flat], j - i)
        return out

    def take(self, rows: np.ndarray) -> "Rows":
        sizes = np.diff(self.at)[rows]
        flat = np.concatenate([self.flat[self.at[i] : self.at[i + 1]] for i in rows]) if len(rows) else self.flat[:0]
        return Rows(flat, np.concatenate(([0], np.cumsum(sizes))), self.dims)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: Rows, y: np.ndarray, earlier: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Linear:
    n, pos = len(y), y.sum()
    base = np.clip(pos / max(1, n), 1e-4, 1 - 1e-4)
    none = Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(base / (1 - base))))
    if n == 0 or pos == 0 or pos == n:
        return none
    c1, count = np.zeros(rows.dims), np.zeros(rows.dims, np.int64)
    for i, j, flat in rows.parts():
        count += np.bincount(flat, minlength=rows.dims)
        c1 += np.bincount(flat, np.repeat(y[i:j], np.diff(rows.at[i : j + 1])), rows.dims)
    expected = count * base
    z = (c1 - expected) / np.sqrt(np.maximum(expected * (1 - base), 1e-9))
    chosen = np.flatnonzero((count >= LEAST_ROWS) & (np.abs(z) >= LEAST_Z))
    ratio = np.log((c1[chosen] + SMOOTHING * base) / pos / ((count[chosen] - c1[chosen] + SMOOTHING * (1 - base)) / (n - pos)))
    place = np.full(rows.dims, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    small = np.int16 if len(chosen) < 1 << 15 else np.int32
    # Of some rows each: the first, one past the last; by row the entries' features, by feature the entries' rows.
    parts = []
    for i, j, flat in rows.parts():
        column, row = place[flat], np.repeat(np.arange(j - i, dtype=np.int16), np.diff(rows.at[i : j + 1]))
        row, column = row[column >= 0], column[column >= 0]
        starts, order = np.flatnonzero(np.diff(row, prepend=-1)), np.argsort(column, kind="stable")
        begin = np.flatnonzero(np.diff(column[order], prepend=-1))
        parts.append((i, j, column.astype(small), starts, row[starts], row[order], begin, column[order][begin]))
    w, e, b = np.zeros(len(chosen)), np.zeros(earlier.shape[1]), none.bias
    gw, ge, gb = np.full(len(w), 1e-8), np.full(len(e), 1e-8), 1e-8
    for _ in range(steps):  # full-batch Adagrad
        weights, dw, error = (w * ratio).astype(np.float32), np.zeros(len(chosen)), np.empty(n)
        for i, j, column, starts, filled, row, begin, own in parts:
            total = earlier[i:j] @ e + b
            if len(starts):
                total[filled] += np.add.reduceat(weights[column], starts)
            error[i:j] = (_sigmoid(total) - y[i:j]) / n
            if len(starts):
                dw[own] += np.add.reduceat(error[i:j].astype(np.float32)[row], begin)
        dw = dw * ratio + decay * w / n
        de, db = error @ earlier, error.sum()
        gw += dw * dw
        ge += de * de
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        e -= rate * de / np.sqrt(ge)
        b -= rate * db / np.sqrt(gb)
    return Linear(chosen, w * ratio, e, float(b))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    threshold: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(features that any model chose, their weights in all models)."""
        features = np.unique(np.concatenate([m.features for m in self.models]).astype(np.int64))
        weights = np.zeros((len(features), len(self.models)))
        for i, m in enumerate(self.models):
            weights[np.searchsorted(features, m.features), i] = m.weights
        return features, weights


def fit_chain(rows: Rows, labels: np.ndarray, names: list[str], fold: np.ndarray, folds: int = FOLDS) -> Chain:
    """labels: a row per text, a column per category; NaN where unknown. fold: each text's."""
    n = len(labels)
    earlier, models = np.zeros((n, 0)), []
    for c in range(len(names)):
        known = ~np.isnan(labels[:, c])
        out = np.zeros(n)
        for k in range(folds):
            train, test = np.flatnonzero(known & (fold != k)), np.flatnonzero(fold == k)
            model = fit_linear(rows.take(train), labels[train, c], earlier[train])
            out[test] = _sigmoid(model.logit(rows.take(test).sums(model), earlier[test]))
        chosen = np.flatnonzero(known)
        models.append(fit_linear(rows.take(chosen), labels[chosen, c], earlier[chosen]))
        earlier = np.column_stack((earlier, out))
    known = ~np.isnan(labels[:, -1])
    return Chain(names, models, best_threshold(out[known], labels[known, -1]) if n else 1.0)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1, halfway to the next lower score; 0.5 at least."""
    if not y.sum():
        return 1.0
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    i = int(np.argmax(f1))
    return max(0.5, float((p[i] + p[min(i + 1, len(p) - 1)]) / 2))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories: dict[str, str] = CATEGORIES) -> Chain:
    """Fit the chain on at most ``sample`` labelled documents."""
    names = list(categories)
    known = labels.filter("doc_id IS NOT NULL").select("doc_id", *[F.expr(f"cast({sql} as double)").alias(f"_y{i}") for i, sql in enumerate(categories.values())])
    known = known.filter(" AND ".join(f"_y{i} IS NOT NULL" for i in range(len(names))))
    known = known.groupBy("doc_id").agg(*[F.max(f"_y{i}").alias(f"_y{i}") for i in range(len(names))])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # One row of each id, so that the sample bounds rows: the text of least hash.
    labelled = [f"_y{i}" for i in range(len(names))]
    texts = texts.groupBy("doc_id", *labelled).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            yield _with_lists(batch, [text_features(t, known) for t in batch.column("text").to_pylist()])

    schema = "doc_id long, fold int, " + ", ".join(f"_y{i} double" for i in range(len(names))) + ", features array<int>"
    rows = materialize(texts.select("doc_id", fold, *labelled, "text").mapInArrow(trimmed(features), schema), "toxicity-rows")
    telling = _telling(rows, len(names))
    shared = docs.sparkSession.sparkContext.broadcast(telling)

    def only_telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features as places among the telling ones, the others left out."""
        telling = shared.value
        for batch in batches:
            lists = batch.column("features")
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            place = np.minimum(np.searchsorted(telling, flat), max(0, len(telling) - 1)).astype(np.int32)
            keep = telling[place] == flat if len(telling) else np.zeros(len(flat), bool)
            upto = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], np.cumsum(size)))].astype(np.int32)
            kept = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(upto), pa.array(place[keep]))], names=[*kept, "features"])

    got = rows.mapInArrow(trimmed(only_telling), schema).toArrow().sort_by("doc_id").combine_chunks()
    lists = got.column("features").combine_chunks()
    flat = lists.flatten().to_numpy().astype(np.int16 if len(telling) < 1 << 15 else np.int32)
    sparse = Rows(flat, np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))), len(telling)) if got.num_rows else Rows(flat, np.zeros(1, np.int64), len(telling))
    y = np.column_stack([got.column(f"_y{i}").to_numpy() for i in range(len(names))])
    fold_of = got.column("fold").to_numpy()
    del got, lists
    chain = fit_chain(sparse, y, names, fold_of)
    for m in chain.models:
        m.features = telling[m.features]
    return chain


def _with_lists(batch: pa.RecordBatch, lists: list[np.ndarray]) -> pa.RecordBatch:
    """The batch with its last column replaced by ``features``."""
    at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    kept = batch.schema.names[:-1]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32)))], names=[*kept, "features"])


def _telling(rows: DataFrame, categories: int) -> np.ndarray:
    """Features that stand out in any category, over all rows or without any one fold; no fit can choose another."""
    ones = lambda of: [F.count(F.lit(1)).alias("n"), *(F.sum(f"_y{c}").alias(f"p{c}") for c in range(categories))] if of is None else [F.count_if(F.col("fold") == of).alias(f"n_{of}"), *(F.sum(F.when(F.col("fold") == of, F.col(f"_y{c}"))).alias(f"p{c}_{of}") for c in range(categories))]
    parts = [a for of in (None, *range(FOLDS)) for a in ones(of)]
    all_ = {k: v or 0 for k, v in rows.agg(*parts).first().asDict().items()}
    counts = rows.select("fold", *[f"_y{c}" for c in range(categories)], F.explode("features").alias("f")).groupBy("f").agg(*parts)
    strength = []
    for of in (None, *range(FOLDS)):
        less = lambda name: F.col(name) - F.coalesce(F.col(f"{name}_{of}"), F.lit(0)) if of is not None else F.col(name)  # noqa: B023, E731
        n = all_["n"] - (all_[f"n_{of}"] if of is not None else 0)
        for c in range(categories):
            p = all_[f"p{c}"] - (all_[f"p{c}_{of}"] if of is not None else 0)
            base = min(max(p / max(1, n), 1e-4), 1 - 1e-4)
            expected = less("n") * base
            z = F.abs((less(f"p{c}") - expected) / F.sqrt(F.greatest(expected * (1 - base), F.lit(1e-9))))
            strength.append(F.when((less("n") >= LEAST_ROWS) & (z >= LEAST_Z - 1e-6), z))
    strong = counts.filter(F.coalesce(*strength).isNotNull()).select("f")
    return np.sort(materialize(strong, "toxicity-strong").toArrow().column(0).to_numpy().astype(np.int32))


def scorer(chain: Chain):
    """A vectorised UDF: text -> struct of the categories' probabilities and the decision."""
    features, weights = chain.table()
    names, models, threshold = chain.names, chain.models, chain.threshold
    schema = ", ".join(f"p_{n} double" for n in names) + f", {names[-1]} boolean"

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept: dict[str, tuple[int, ...]] = {}
        place = {f: i for i, f in enumerate(features.tolist())}
        for texts in batches:
            said, flat, sizes = np.zeros(len(texts), bool), [], []
            for i, text in enumerate(texts.to_pylist()):
                found: set[int] = set()
                words = set(_WORD.findall((text or "").lower()))
                said[i] = bool(words)
                if len(kept) >= _KEPT_WORDS:
                    kept.clear()
                for word in words:
                    own = kept.get(word)
                    if own is None:
                        own = kept[word] = tuple(place[f] for f in word_features(word) if f in place)
                    if own:
                        found.update(own)
                flat += sorted(found)
                sizes.append(len(found))
            total, filled = np.zeros((len(texts), len(models))), np.flatnonzero(sizes)
            if len(filled):
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                total[filled] = np.add.reduceat(weights[np.array(flat)], starts[filled], axis=0)
            earlier = np.zeros((len(texts), 0))
            for c, m in enumerate(models):
                earlier = np.column_stack((earlier, _sigmoid(m.logit(total[:, c], earlier))))
            columns = [pa.array(np.ascontiguousarray(earlier[:, c])) for c in range(len(names))] + [pa.array(said & (earlier[:, -1] > threshold))]
            yield pa.StructArray.from_arrays(columns, names=[*(f"p_{n}" for n in names), names[-1]])

    return arrow_udf(trimmed(score), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, p_low_quality, p_toxic, toxic."""
    chain = train(docs, labels, sample)
    return docs.select("doc_id", scorer(chain)("text").alias("_s")).select("doc_id", "_s.*")


def survivors(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those judged toxic, rows whole; fitted on ``training`` (default: ``docs``)."""
    chain = train(docs if training is None else training, labels, sample)
    scored = packed(docs).withColumn("score", scorer(chain)(F.col("row.text")))
    return scored.filter(~F.col(f"score.{chain.names[-1]}")).select("row.*")
