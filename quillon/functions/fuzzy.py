"""Edit similarity and suggestion scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def edit_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions."""
    last_in_a: dict[str, int] = {}
    far = len(a) + len(b)
    rows = {-1: [far] * (len(b) + 2), 0: [far, *range(len(b) + 1)]}
    for i, x in enumerate(a, 1):
        row, last_match = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last_in_a.get(y, 0), last_match
            if x == y:
                last_match = j
            swap = rows[k - 1][m] + (i - k - 1) + 1 + (j - m - 1) if k and m else far
            row.append(min(rows[i - 1][j] + (x != y), row[j] + 1, rows[i - 1][j + 1] + 1, swap))
        rows[i] = row
        last_in_a[x] = i
    return rows[len(a)][-1]


def _similarity(a: str, b: str) -> float:
    most = max(len(a), len(b))
    return 1.0 - edit_distance(a, b) / most if most else 1.0


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - distance / length of the longer; 1 for two empty strings; null with null."""
    known: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = _similarity(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def suggestion_score(query: Column, name: Column, token_similarity: Column) -> Column:
    """Exact, prefix of the name or of a word, substring, similar word; null below these."""
    fill = F.octet_length(query) / F.octet_length(name)
    return (
        F.when(name == query, F.lit(1.0))
        .when(name.startswith(query) | F.contains(F.concat(F.lit(" "), name), F.concat(F.lit(" "), query)), 0.8 + 0.09 * fill)
        .when(name.contains(query), 0.6 + 0.09 * fill)
        .when(token_similarity > 0.7, 0.3 + 0.2 * token_similarity)
    )
