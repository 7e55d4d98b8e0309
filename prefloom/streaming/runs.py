"""Run a streaming query over the files available now and read its output back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.session import checkpoint_dir


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/streams/{name}-{uuid.uuid4().hex[:8]}"


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Append-mode run into parquet; returns everything it wrote."""
    spark = stream.sparkSession
    folder = _scratch(spark, name)
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_each_batch(stream: DataFrame, name: str, sink_of: Callable[[Callable, Callable], Callable], schema: str) -> DataFrame:
    """Update-mode run through a ``foreachBatch`` sink that writes parquet; returns its rows.

    ``sink_of`` gets a function that writes an epoch's rows and one that reads those of earlier epochs.
    """
    spark = stream.sparkSession
    folder = _scratch(spark, name)

    def write(rows: DataFrame, epoch: int) -> None:
        # one folder per epoch: a repeated batch replaces its own output
        rows.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    def earlier(epoch: int) -> DataFrame | None:
        return spark.read.schema(f"{schema}, epoch bigint").parquet(f"{folder}/rows").filter(F.col("epoch") < epoch).drop("epoch") if epoch else None

    query = (
        stream.writeStream.outputMode("update").foreachBatch(sink_of(write, earlier))
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows").drop("epoch")
