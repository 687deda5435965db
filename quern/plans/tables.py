"""Reading inputs and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ROOT: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; a file or a folder of parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_machine(master: str) -> bool:
    """Whether driver and executors are one process, so that a temporary folder is shared."""
    return master.partition("[")[0] == "local"


def named_folder(spark: SparkSession) -> str | None:
    """The folder in `spark.checkpoint.dir`, or that of `setCheckpointDir`."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
    return by_call.get() if by_call.isDefined() else None


def shared_root(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`, or by `setCheckpointDir`.

    Where neither is set, a temporary folder if everything runs in one process, and an
    error on a cluster, whose executors would each write to a disk of their own.
    """
    named = named_folder(spark)
    if named:
        return named.rstrip("/")
    if not one_machine(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOT:
        _ROOT[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _ROOT[app]


def _file_system(spark: SparkSession, path: str):
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    Cuts the lineage, makes generated ids stable and survives the loss of any
    executor.  The table goes when the application ends, or with `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/quern/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """`written(df)` and metrics over its rows, taken while they are written."""
    seen = Observation()
    out = written(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), name)
    return out, {k: v or 0 for k, v in seen.get.items()}


def discard(df: DataFrame) -> None:
    """Remove a table made by `written` before the application ends: nothing may read it any more."""
    if path := getattr(df, "_written_to", None):
        fs, at = _file_system(df.sparkSession, path)
        fs.delete(at, True)


def with_ids(df: DataFrame, name: str, column: str = "kid") -> DataFrame:
    """`df` as a written table with a unique integer id for each row.

    Ids are dense within each written partition, so `id >> 15` makes full ranges.
    """
    return written(df.withColumn(column, F.monotonically_increasing_id()), name)


def utc_month(ts: Column) -> Column:
    """Months since the year 0; null for null."""
    return F.year(ts) * 12 + F.month(ts) - 1


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)
