"""Results as they arrive: a file stream into a table of one folder a batch, and the same summary as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str) -> None:
    """Take in all files that are new since the checkpoint, each batch once: a batch that is run again replaces its folder."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key."""
    rows = spark.read.parquet(table)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "batch")
