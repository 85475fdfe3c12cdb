"""Several sources fetched at once, none of which can end the run.

A source is a partition of a Python data source: Spark fetches them side by side, and each yields what it delivers and
one row about itself. A source that raises is a row that says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.session import materialize

SCHEMA = "source string, body string, outcome string, fetched long, error string"
LONGEST_ERROR = 500


class _Source(InputPartition):
    def __init__(self, name: str, fetch: Callable[[], Iterable[str]] | None):
        self.name, self.fetch = name, fetch


class _Reader(DataSourceReader):
    def __init__(self, sources: list[_Source]):
        self.sources = sources

    def partitions(self) -> list[InputPartition]:
        return self.sources

    def read(self, partition: _Source) -> Iterator[tuple]:
        if partition.fetch is None:
            yield partition.name, None, "skipped", 0, "disabled by configuration"
            return
        fetched, error = 0, None
        try:
            for body in partition.fetch():
                yield partition.name, body, None, None, None
                fetched += 1
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:LONGEST_ERROR]
        yield partition.name, None, "success" if error is None else "partial" if fetched else "failed", fetched, error


def fetch_all(spark: SparkSession, sources: dict[str, Callable[[], Iterable[str]]], disabled: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(payloads: source, body; outcomes: source, outcome, fetched, error) of ``sources``, functions that yield payloads.

    Every source has one outcome: success, partial (it raised after it had delivered some), failed or skipped. They are
    fetched once: the result is written before it is read.
    """
    off, parts = set(disabled), []
    for name, fetch in sources.items():
        parts.append(_Source(name, None if name in off else fetch))

    class Sources(DataSource):
        @classmethod
        def name(cls) -> str:
            return "quillon_sources"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(parts)

    spark.dataSource.register(Sources)
    found = materialize(spark.read.format("quillon_sources").load(), "sources")
    return found.filter("outcome IS NULL").select("source", "body"), found.filter("outcome IS NOT NULL").select("source", "outcome", "fetched", "error")
