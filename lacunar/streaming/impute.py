"""Imputation of bins as they arrive. Solving and predicting a bin needs that bin alone, so each micro-batch of packed or
long cells is handled by the batch operators; bins must arrive whole, or pass through gather.whole_bins() first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lacunar.operators import model, tensor
from lacunar.operators.tensor import KEYS


def impute_stream(cells: DataFrame, axes: model.Axes, train: list[tuple[int, int]], ridge: float, path: str, checkpoint: str, keys: list[str] = KEYS) -> StreamingQuery:
    """Writes predictions of all cells of every arriving bin to Parquet, a folder per batch, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        bins = model.solve_bins(tensor.centered(tensor.scrub(batch), axes.mean), axes, train, ridge, keys)
        rows, cols = axes.frames(batch.sparkSession)
        model.predicted(bins, rows, cols, axes.mean, keys=keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(events: DataFrame, time_col: str, value_col: str, by: list[str], size: str, late: str) -> DataFrame:
    """Means per window of `size` and group, for data up to `late` behind."""
    t = events.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    return t.groupBy(F.window("_t", size).alias("window"), *by).agg(F.avg(value_col).alias("value"))
