"""The text of a mail out of its tree of parts."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: Characters of a body that are kept.
MOST = 4000
_SKIPPED = str.maketrans("", "", "=\r\n")


def decoded(data: str) -> str | None:
    """Text of unpadded base64 for URLs; null if a letter is none of its own. Broken UTF-8 is replaced."""
    data = data.translate(_SKIPPED)
    if not data.isascii() or not all(c.isalnum() or c in "-_" for c in data):
        return None
    data = data[: len(data) - 1] if len(data) % 4 == 1 else data  # six bits make no byte
    return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")


def first_part(tree: dict, kind: str) -> str | None:
    """The first part of a kind that can be decoded, depth first; a part of that kind with data is not entered."""
    todo = [tree]
    while todo:
        part = todo.pop()
        if not isinstance(part, dict):
            continue
        body = part.get("body")
        data = body.get("data") if isinstance(body, dict) else None
        if part.get("mimeType") == kind and isinstance(data, str):
            if (text := decoded(data)) is not None:
                return text
            continue
        inner = part.get("parts")
        todo += reversed(inner) if isinstance(inner, list) else []
    return None


@F.pandas_udf(StructType([StructField("html", BooleanType()), StructField("raw", StringType())]))
def _chosen(payloads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The plain part if it says something, else the HTML part."""
    for batch in payloads:
        rows = []
        for payload in batch:
            try:
                tree = json.loads(payload) if payload else None
            except ValueError:
                tree = None
            plain = first_part(tree, "text/plain") if tree else None
            rows.append((False, plain) if plain and plain.strip() else (True, first_part(tree, "text/html") if tree else None))
        yield pd.DataFrame(rows, columns=["html", "raw"])


def without_tags(c: Column) -> Column:
    """No scripts and styles (to the end if they do not close), tags as blanks."""
    bare = F.regexp_replace(c, r"(?is)<(script.*?(</script>|\z)|style.*?(</style>|\z))", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*(>|\z)", " "), ">", " ")


def body_text(payload: Column, most: int = MOST) -> Column:
    """The text of a mail's payload (JSON: mimeType, body.data, parts): the first plain part, else the first HTML part
    without its tags; white space collapsed, cut to ``most`` characters; null if there is none."""

    def clean(part: Column) -> Column:
        text = F.when(part["html"], without_tags(part["raw"])).otherwise(part["raw"])
        return F.nullif(F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""), 1, most), F.lit(""))

    # One call of the function, whatever names the result.
    return F.get(F.transform(F.array(_chosen(payload)), clean), F.lit(0))
