"""Secret scans: fixed patterns, and a randomness test battery for what they miss.

Patterns give the base spans ``assign``, ``access`` and ``hex``. Besides, every run of
20 or more characters of ``[A-Za-z0-9+/_-]`` that holds a letter, with up to two ``=`` after it, is a
candidate, so the name and the value of NAME=VALUE are two; of a run that a base span covers
in part, what lies outside is. A candidate is of the narrowest encoding that fits it (hex, letters
of one case, base32, base36, letters, base62, base64). Three tests ask
whether it could be random in that encoding: chi-squared for equal use of the alphabet,
runs above and below the alphabet's middle, and the serial correlation of neighbours. Their
p-values combine by Fisher's method. Written text and counters fail; keys do not.

Which failures count is decided over the whole corpus: within each length class (a short
candidate's tests are weak, so it must not share a threshold with long ones) the
Benjamini-Hochberg rule finds the p-value up to which candidates are called structured.
The rule needs only how many p-values lie below each; these are counted in logarithmic
bins, so the global step is one small aggregate. Candidates that are not structured
become ``random`` spans.

Defined results: a null text counts as empty and has no span; repeated rows are judged
alike; an empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.kernels import trimmed
from quillon.session import materialize

# Fixed values of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS = 6, 20

LEAST_CANDIDATE = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_HINTS = ("passw", "secret", "token", "api")
#: Alphabets from narrow to wide.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
FALSE_DISCOVERY_RATE = 0.01
#: p-value bins of a tenth of a decade, and upper ends of the length classes.
_BINS_A_DECADE, _BINS = 10, 300
LENGTHS = (24, 32, 48, 64, 128)

SPAN = "array<struct<kind:int,start:long,`end`:long>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def _upper_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees > x), by the Wilson-Hilferty normal approximation."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(value: str) -> str | None:
    """The alphabet of the narrowest encoding, or None if there is no letter."""
    chars = set(value.rstrip("="))
    if not any(c.isalpha() for c in chars):
        return None
    if chars <= set("0123456789ABCDEF"):
        value, chars = value.lower(), {c.lower() for c in chars}
    return next((alphabet for _, alphabet in ENCODINGS if chars <= set(alphabet)), None)


def randomness(value: str) -> float | None:
    """Combined p-value of the battery; None for what no encoding fits."""
    alphabet = infer_encoding(value)
    if alphabet is None:
        return None
    value = value.rstrip("=")
    if alphabet is ENCODINGS[0][1]:
        value = value.lower()
    x = [alphabet.index(c) for c in value]
    n, m = len(x), len(alphabet)
    expected = n / m
    chi = sum((c - expected) ** 2 for c in Counter(x).values()) / expected + (m - len(set(x))) * expected
    # Upper tail for uneven use; a sequence that uses its alphabet too evenly is a counter.
    high = _chi_squared_tail(chi, m - 1)
    uniform = min(1.0, 2 * min(high, 1 - high)) if n >= 2 * m else high
    above = [v >= m / 2 for v in x]
    ups = sum(above)
    downs = n - ups
    runs = 1 + sum(a != b for a, b in zip(above, above[1:], strict=False))
    if ups and downs:
        mean = 2 * ups * downs / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        run = _upper_normal((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        run = 2.0 ** (1 - n)
    mid = (m - 1) / 2
    power = (m * m - 1) / 12
    serial = sum((a - mid) * (b - mid) for a, b in zip(x, x[1:], strict=False)) / (power * math.sqrt(n - 1))
    correlated = _upper_normal(serial)
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, run, correlated))
    half = fisher / 2
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2)) if half < 700 else 0.0


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidates, outside the base spans."""
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        for _, a, b in base:  # by start
            if a < end and at < b:
                if a - at >= LEAST_CANDIDATE:
                    yield at, a
                at = b
        if at == m.start():
            yield at, end
        elif end - at >= LEAST_CANDIDATE and (rest := CANDIDATE.match(text, at, end)):
            yield rest.span()


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base and candidate spans; candidates with their length class and p-value bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        candidate = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("size", pa.int32()), ("bin", pa.int32())]))
        for batch in batches:
            base, more = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                own = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                found = []
                for start, end in candidates(text, own):
                    if (p := randomness(text[start:end])) is None:
                        continue
                    size = next((i for i, top in enumerate(LENGTHS) if end - start <= top), len(LENGTHS))
                    place = min(_BINS, int(-math.log10(max(p, 1e-300)) * _BINS_A_DECADE))
                    found.append({"start": start, "end": end, "size": size, "bin": place})
                more.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(more, candidate)], names=["doc_id", "base", "candidates"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id long, base {SPAN}, candidates array<struct<start:long,`end`:long,size:int,bin:int>>")


def structured_from(scanned: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """Per length class the least bin (largest p) at which Benjamini-Hochberg rejects randomness: size, cut.

    A bin counts with its largest p-value, which is on the safe side.
    """
    bins = scanned.select(F.explode("candidates").alias("c")).groupBy("c.size", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    below = W.partitionBy("size").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy("size")
    ranked = bins.select("size", "bin", F.sum("n").over(below).alias("rank"), F.sum("n").over(every).alias("total"))
    largest_p = F.pow(F.lit(10.0), -F.col("bin") / float(_BINS_A_DECADE))
    return ranked.filter(largest_p <= rate * F.col("rank") / F.col("total")).groupBy("size").agg(F.min("bin").alias("cut"))


def _listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """Per document: doc_id, base (array of spans), found (all spans)."""
    scanned = materialize(scan(docs), "secrets")
    cuts = structured_from(scanned, rate).collect()  # a row per length class at most
    of = {r["size"]: r["cut"] for r in cuts}
    limit = lambda c: F.element_at(F.array(*[F.lit(of.get(i, _BINS + 1)) for i in range(len(LENGTHS) + 1)]), c["size"] + 1)
    kept = F.filter("candidates", lambda c: c["bin"] < limit(c))
    random = F.transform(kept, lambda c: F.struct(F.lit(3).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    by_start = F.transform(
        F.array_sort(F.transform(F.concat("base", random.cast(SPAN)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return scanned.select("doc_id", "base", by_start.alias("found"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    count = lambda column, k: F.size(F.filter(column, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count("base", i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        count("found", 3).alias("n_random"),
    )
