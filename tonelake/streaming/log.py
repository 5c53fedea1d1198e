"""A table written one micro-batch at a time, and running a stream over what is there.

Each micro-batch owns the folder `batch_id=<n>`. A batch that is run again after a failure
overwrites its own folder and reads only earlier ones, so every job here is exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchLog:
    def __init__(self, path: str, schema: str) -> None:
        self.path = path
        self.schema = schema

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one; each with its `batch_id`."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        schema = f"{self.schema}, batch_id bigint"
        if not files.exists(folder):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(self.path)
        return rows if before is None else rows.where(F.col("batch_id") < before)


def run_available(
    stream: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Process everything available, in as many micro-batches as the source gives, then stop."""
    query = (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
