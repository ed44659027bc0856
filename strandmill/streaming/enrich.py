"""Extension: stateless enrichment of arriving events, and windowed counts with late data dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def enriched(stream: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Each event with its row of a static table; Spark chooses the join from the table's size."""
    return stream.join(table, keys, "left")


def windowed(stream: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per key and tumbling window, final once ``late`` has passed."""
    counted = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("window.start").alias("start"), key, "n", "total")
