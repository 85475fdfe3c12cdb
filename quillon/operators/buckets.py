"""Tables kept in hash buckets, so that a small batch rewrites its own buckets and no more.

A bucket is a folder, the partition ``_bucket`` of a Parquet table. A merge reads the buckets that the batch's keys fall
into, joins them with the batch and overwrites just these; all other files stay as they are. The number of buckets
is fixed when the table is made; what the driver learns of a batch is which buckets it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import discard, materialize

BUCKET = "_bucket"


class BucketedTable:
    """A table below ``path`` with unique ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 256):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0))
        whole = self.spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0)).schema
        return self.spark.read.schema(whole).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def merge(self, batch: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the buckets that ``batch`` touches by ``fold(stored rows of these, batch)``; returns their numbers.

        A merge that is lost half way can be run again with the same batch, if the fold of a batch into
        rows that hold it changes nothing.
        """
        batch = materialize(batch.withColumn(BUCKET, self.bucket()), "buckets-batch")
        touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())  # as many as there are buckets at most
        if touched:
            old = self._stored().filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
            merged = materialize(fold(old, batch.drop(BUCKET)).select(*self.schema.names), "buckets-merged")
            out = merged.withColumn(BUCKET, self.bucket()).repartition(BUCKET)
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
            discard(merged)
        discard(batch)
        return touched


SIGHTINGS = "source string, external_id string, posting_id string, url string, first_seen timestamp, last_seen timestamp, run long, misses long"


def seen_again(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sightings (``SIGHTINGS``) after a batch (source, external_id, posting_id, url, at, run): of a source's listing the last in the
    batch points it to its posting, dates it and clears its misses; when it was first seen stays."""
    last = new.groupBy("source", "external_id").agg(F.max(F.struct("at", "run", "posting_id", "url")).alias("n"), F.min("at").alias("_begun"))
    joined = old.join(last, ["source", "external_id"], "full_outer")
    newer = lambda c, of: F.when(F.col("n").isNotNull(), F.col(f"n.{of}")).otherwise(F.col(c)).alias(c)
    misses = F.when(F.col("n").isNotNull(), F.lit(0)).otherwise(F.col("misses")).cast("long")
    return joined.select(
        "source", "external_id", newer("posting_id", "posting_id"), newer("url", "url"), F.coalesce("first_seen", "_begun").alias("first_seen"),
        newer("last_seen", "at"), newer("run", "run"), misses.alias("misses"),
    )
