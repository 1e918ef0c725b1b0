"""Incremental runs: new files only, new keys only, each batch appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append_new(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Reads the files that came since the last call, drops rows whose key the target has, appends the rest, and ends.

    A batch that is retried writes its own partition again, so rows never double.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = transform(batch).dropDuplicates([key])
        try:
            new = new.join(spark.read.parquet(target).where(F.col("batch") != number).select(key), key, "left_anti")
        except Exception as e:  # the target does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
