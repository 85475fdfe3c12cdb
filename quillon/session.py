"""Session settings and the shared scratch area of multi-step jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder of
    this process stands in on a local master (tests, a laptop), gone at its end; on any other
    master that is an error, since no executor would see what another wrote.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillon-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage: what follows survives the loss of executors and
    nothing before it runs twice.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quillon/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._quillon_path = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._quillon_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def reread(*written: DataFrame) -> DataFrame:
    """Tables of one schema that ``materialize`` wrote, as one table."""
    return written[0].sparkSession.read.schema(written[0].schema).parquet(*(df._quillon_path for df in written))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only the columns that a plan uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
