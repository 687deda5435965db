"""Running a stream over what is there and reading the result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.tables import shared_root


def read_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 100) -> DataFrame:
    """One of the test tables as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]")


def run_once(stream: DataFrame, mode: str = "append", one_batch: bool = False) -> DataFrame:
    """Everything the stream has now, as rows with `batch_id`; in complete mode only the last batch.

    `one_batch` takes it all in a single batch, as folds with processing-time timers need: else their timers keep the stream running.

    Checkpoints and output lie in the shared folder; each batch has its own folder, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    base = f"{shared_root(spark)}/quern/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")
        last[:] = [batch_id]

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(**({"once": True} if one_batch else {"availableNow": True})).foreachBatch(write).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    out = spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out") if last else spark.createDataFrame([], schema)
    return out.where(F.col("batch_id") == (last[0] if last else 0)).drop("batch_id") if mode == "complete" else out
