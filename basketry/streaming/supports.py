"""Item supports kept up to date over a stream of baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_supports(occ: DataFrame, time_col: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window, item, support of a streaming (tid, item, time); rows later than ``late`` are dropped by the watermark."""
    seen = occ.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["tid", "item"])
    return seen.groupBy(F.window(time_col, width), "item").agg(F.count("*").alias("support"))


def maintain_supports(occ: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch's counts (batch, item, n) to Parquet under ``path``; current_supports() sums them.

    A batch that is run again after a failure overwrites its own folder, so no count is added twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.select("tid", "item").distinct().groupBy("item").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = occ.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_supports(spark, path: str) -> DataFrame:
    """item, support over all batches; each basket comes in one batch."""
    return spark.read.parquet(path).groupBy("item").agg(F.sum("n").alias("support"))
