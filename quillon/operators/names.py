"""Which of a list of names a message holds: one pass over its texts by a multi-pattern automaton.

A list that fits one broadcast goes to the tasks, where a worker builds its automaton once. A longer one stays a table,
which what texts hold between their words is joined with. A hit counts if it stands between characters that are no letters
or digits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.senders import ROLE_WORDS, employer
from quillon.session import materialize

#: Names and bytes of one broadcast at most, and of one name.
MOST_NAMES, MOST_BYTES, LONGEST_NAME = 100_000, 8 << 20, 200
#: Shorter names are no names; single words shorter than the second count in a body for nothing.
LEAST, TELLING = 3, 8

_BUILT: dict[str, tuple] = {}


def _automata(token: str, names: list[str]) -> tuple:
    """(of the names, of their forms without blanks that an address may hold)."""
    if token not in _BUILT:
        plain, squashed = ahocorasick.Automaton(), ahocorasick.Automaton()
        short: dict[str, str] = {}
        for name in names:
            plain.add_word(name, name)
            form = name.replace(" ", "")
            if form not in ROLE_WORDS:
                short[form] = _longer(short.get(form), name)
        for form, name in short.items():
            squashed.add_word(form, (len(form), name))
        for a in (plain, squashed):
            if len(a):
                a.make_automaton()
        _BUILT.clear()  # one list at a time is in use
        _BUILT[token] = plain, squashed
    return _BUILT[token]


def _longer(a: str | None, b: str | None) -> str | None:
    """The longer in bytes, of equal ones the first by name."""
    if a is None or b is None:
        return b if a is None else a
    return min(a, b, key=lambda x: (-len(x.encode()), x))


def _whole(text: str, begin: int, end: int) -> bool:
    return not (begin and text[begin - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def longest(text: str | None, automaton, squashed: bool = False) -> str | None:
    best = None
    if not text or not len(automaton):
        return best
    for at, value in automaton.iter(text):
        size, name = value if squashed else (len(value), value)
        if (best is None or len(name.encode()) >= len(best.encode())) and _whole(text, at + 1 - size, at + 1):
            best = _longer(best, name)
    return best


#: Bits of the filter for each name, bits of it at most (32 MiB), bits of a block of it, and phrases that are tested at once.
BITS, MOST_BITS, BLOCK, AT_ONCE = 16, 1 << 28, 32768, 200_000
_PIECES = re.compile(r"[^\W_]+|[\W_]")


def _places(texts, bits: int) -> np.ndarray:
    """Three bits of the filter for each text."""
    hashed = pd.util.hash_array(np.asarray(texts, dtype=object), categorize=True)
    low, high = hashed & np.uint64(0xFFFFFFFF), hashed >> np.uint64(32)
    return np.stack([(low + np.uint64(i) * high) % np.uint64(bits) for i in range(3)], axis=1).astype("int64")


def _shape(name: str) -> int:
    """How many runs of letters or digits and single other characters, doubled; odd if it begins with a run."""
    return 2 * len(_PIECES.findall(name)) + name[:1].isalnum()


def _phrases(text: str | None, shapes: tuple[list[int], list[int]]) -> Iterator[str]:
    """All that stands whole in a text and has one of the shapes: numbers of pieces, of what begins with no run and with one."""
    pieces = _PIECES.findall(text or "")
    run = [x.isalnum() for x in pieces]
    for i, begins in enumerate(run):
        if i and run[i - 1]:
            continue
        for k in shapes[begins]:
            if i + k > len(pieces):
                break
            if i + k == len(pieces) or not run[i + k]:
                yield pieces[i] if k == 1 else "".join(pieces[i : i + k])


class Finder:
    """A list of names to look for."""

    def __init__(self, spark: SparkSession, names: DataFrame, column: str = "name", stoplist: tuple[str, ...] = ()):
        clean = names.select(F.lower(F.trim(F.col(column))).alias("n")).filter((F.octet_length("n") >= LEAST) & (F.length("n") <= LONGEST_NAME) & F.col("n").rlike(r"\p{L}") & ~F.col("n").isin(list(stoplist)))
        clean = clean.distinct()
        found = clean.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("n")), F.lit(0))).first()
        self.parts = max(1, -(-found[0] // MOST_NAMES), -(-found[1] // MOST_BYTES))
        self.spark, self.clean = spark, clean

    @cached_property
    def shared(self) -> list[tuple]:
        held = [[r.n for r in self.clean.filter(F.pmod(F.xxhash64("n"), F.lit(self.parts)) == p).orderBy("n").collect()] for p in range(self.parts)]
        return [(uuid.uuid4().hex, self.spark.sparkContext.broadcast(x)) for x in held]

    @cached_property
    def table(self) -> DataFrame:
        """key, plain, short: the name that is the key, and the longest that is the key without its blanks."""
        form = F.replace("n", F.lit(" "), F.lit(""))
        size = F.struct((-F.octet_length("n")).alias("k"), F.col("n"))
        plain = self.clean.select(F.col("n").alias("key"), F.col("n").alias("plain"), F.lit(None).cast("struct<k: int, n: string>").alias("short"))
        short = self.clean.filter(~form.isin(list(ROLE_WORDS))).select(form.alias("key"), F.lit(None).cast("string").alias("plain"), size.alias("short"))
        keyed = plain.union(short).groupBy("key").agg(F.max("plain").alias("plain"), F.min("short")["n"].alias("short"))
        return materialize(keyed, "names")

    def _filter(self) -> tuple[int, object, tuple[list[int], list[int]]]:
        """(bits, broadcast bits, shapes) of the keys; what passes the filter is tested by the join."""
        bits = BLOCK * max(1, min(MOST_BITS, BITS * self.table.count()) // BLOCK)

        @F.pandas_udf("array<long>")
        def places(keys: pd.Series) -> pd.Series:
            return pd.Series(list(_places(keys, bits)))

        @F.pandas_udf("int")
        def shape(keys: pd.Series) -> pd.Series:
            return keys.map(_shape)

        hits = self.table.select(F.explode(places("key")).alias("p")).select(F.floor(F.col("p") / BLOCK).alias("block"), F.pmod("p", F.lit(BLOCK)).alias("p"))
        packed = np.zeros(bits // 8, dtype="uint8")
        for r in hits.groupBy("block").agg(F.bitmap_construct_agg("p").alias("b")).toLocalIterator():
            packed[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.b, dtype="uint8")[: BLOCK // 8]
        shapes: tuple[list[int], list[int]] = ([], [])
        for r in self.table.select(shape("key").alias("s")).distinct().orderBy("s").collect():
            shapes[r.s % 2].append(r.s // 2)
        return bits, self.spark.sparkContext.broadcast(packed), shapes

    def find(self, rows: DataFrame, sender: Column, headline: Column, text: Column, into: str = "found") -> DataFrame:
        """``rows`` with the column of ``found``, for a list of any length."""
        if self.parts == 1:
            return rows.withColumn(into, self.found(sender, headline, text))
        bits, packed, shapes = self._filter()

        def known(texts: list[str]) -> Iterator[tuple[str, list[str]]]:
            """Each text with what it holds that passes the filter."""
            held, of = [], []
            for at, t in enumerate(texts):
                found = set(_phrases(t, shapes))
                held.extend(found)
                of.extend([t] * len(found))
                if held and (len(held) >= AT_ONCE or at + 1 == len(texts)):
                    p = _places(held, bits)
                    passed: dict[str, list[str]] = {}
                    for k in ((packed.value[p >> 3] >> (p & 7).astype("uint8")) & 1).all(axis=1).nonzero()[0]:
                        passed.setdefault(of[k], []).append(held[k])
                    yield from passed.items()
                    held, of = [], []

        def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                held = dict(known(list(set().union(*(batch[c] for c in "abc")))))
                out = []
                for h1, h2, *texts in batch.itertuples(index=False, name=None):
                    seen: dict[str, int] = {}
                    for place, t in enumerate(texts):
                        for phrase in held.get(t, ()):
                            seen[phrase] = seen.get(phrase, 0) | 1 << place
                    out.extend([(h1, h2, phrase, where) for phrase, where in seen.items()])
                yield pd.DataFrame(out, columns=["_h1", "_h2", "key", "_in"])

        texts = [F.coalesce(x, F.lit("")) for x in (sender, headline, text)]
        same = [F.xxhash64(F.lit(seed), *texts) for seed in (1, 2)]  # 128 bits stand for the texts
        asked = rows.select(same[0].alias("_h1"), same[1].alias("_h2"), *(t.alias(c) for t, c in zip(texts, "abc", strict=True)))
        met = asked.mapInPandas(phrases, "_h1 long, _h2 long, key string, _in int").join(self.table.hint("merge"), "key")
        name = lambda bit, c: F.min(F.when((F.col("_in").bitwiseAND(F.lit(bit)) != 0) & F.col(c).isNotNull(), F.struct((-F.octet_length(c)).alias("k"), F.col(c).alias("n"))))["n"]
        best = met.groupBy("_h1", "_h2").agg(name(1, "short").alias("sender"), name(2, "plain").alias("headline"), name(4, "plain").alias("text"))
        best = best.select(F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"), F.struct("sender", "headline", "text").alias("_best"))
        none = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("sender", "headline", "text")))
        joined = rows.withColumns({"_h1": same[0], "_h2": same[1]}).join(best, (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2")), "left")
        return joined.withColumn(into, F.coalesce("_best", none)).drop("_h1", "_h2", "_g1", "_g2", "_best")

    def _scan(self, token: str, shared, sender: Column, headline: Column, text: Column) -> Column:
        @F.pandas_udf("sender string, headline string, text string")
        def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            plain, squashed = _automata(token, shared.value)
            for a, b, c in batches:
                yield pd.DataFrame({"sender": [longest(x, squashed, True) for x in a], "headline": [longest(x, plain) for x in b], "text": [longest(x, plain) for x in c]})

        return scan(sender, headline, text)

    def found(self, sender: Column, headline: Column, text: Column) -> Column:
        """struct<sender, headline, text>: the longest name in each of the folded texts. Select it before use: it is one pass."""
        each = [self._scan(token, shared, sender, headline, text) for token, shared in self.shared]
        return F.struct(*(longer(*(x[c] for x in each)).alias(c) for c in ("sender", "headline", "text")))


def longer(*names: Column) -> Column:
    """The longest in bytes, of equal ones the first by name; null of none."""
    best = F.array_min(F.array_compact(F.array(*(F.when(n.isNotNull(), F.struct((-F.octet_length(n)).alias("k"), n.alias("n"))) for n in names))))
    return best["n"]


def _telling(name: Column) -> Column:
    return F.when(name.contains(" ") | (F.octet_length(name) >= TELLING), name)


def named_in(found: Column) -> Column:
    """Where a known name stands: sender, subject, or body if it is telling enough for prose; null for nowhere."""
    return F.when(found["sender"].isNotNull(), "sender").when(found["headline"].isNotNull(), "subject").when(_telling(found["text"]).isNotNull(), "body")


def company_guess(found: Column, sender: Column, subject: Column, platforms: tuple[str, ...], machine: str) -> Column:
    """The longest known name in sender and subject, else a telling one in the body, else what the sender says of itself."""
    head = longer(found["sender"], found["headline"])
    return F.coalesce(head, _telling(longer(found["sender"], found["text"])), employer(sender, subject, platforms, machine))
