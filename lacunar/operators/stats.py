"""Means, biases, errors and penalties over the tensor. splits: (row_id, col_id, split)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacunar.functions.scalar import sum_of_squares
from lacunar.sources.shared import cut

from .tensor import CELL, KEYS, plane


def in_split(t: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Observed cells of one split. The table of splits is as long as the plane."""
    return t.join(plane(splits.where(F.col("split") == split).select(*CELL)), CELL, "left_semi")


def in_bin_split(t: DataFrame, bin_splits: DataFrame, split: str, keys: list[str] = KEYS) -> DataFrame:
    """As in_split(), for splits that differ from bin to bin: (keys, row_id, col_id, split), as long as the tensor."""
    return t.join(bin_splits.where(F.col("split") == split).select(*keys, *CELL), [*keys, *CELL], "left_semi")


def global_mean(t: DataFrame, splits: DataFrame | None = None, split: str = "train") -> DataFrame:
    return (t if splits is None else in_split(t, splits, split)).agg(F.avg("value").alias("mean"))


def row_bias(train: DataFrame) -> DataFrame:
    return train.groupBy("row_id").agg(F.avg("value").alias("row_bias"))


def col_bias(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Column means of what the row means leave."""
    return train.join(plane(cut(rows)), "row_id").groupBy("col_id").agg(F.avg(F.col("value") - F.col("row_bias")).alias("col_bias"))


def bin_bias(train: DataFrame, rows: DataFrame, cols: DataFrame, bins: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Bin means of what both leave; with `bins`, 0 for the bins that have no training cell."""
    left = train.join(plane(cut(rows)), "row_id").join(plane(cut(cols)), "col_id").groupBy(*keys).agg(F.avg(F.col("value") - F.col("row_bias") - F.col("col_bias")).alias("bin_bias"))
    return left if bins is None else bins.select(*keys).join(left, keys, "left").withColumn("bin_bias", F.coalesce("bin_bias", F.lit(0.0)))


def mse_by_split(t: DataFrame, predicted: DataFrame, splits: DataFrame, n_bins: int | None = None, keys: list[str] = KEYS) -> DataFrame:
    """(split, sse, n, mse): squared error over the observed cells of a split, divided by all its cells in all bins,
    observed or not. predicted: keys, row_id, col_id, predicted."""
    per = splits.groupBy("split").agg(F.count(F.lit(1)).alias("plane"))
    bins = t.select(*keys).distinct().agg(F.count(F.lit(1)).alias("bins")) if n_bins is None else None
    sse = t.join(predicted, [*keys, *CELL]).join(plane(splits), CELL).groupBy("split").agg(F.sum(F.pow(F.col("predicted") - F.col("value"), 2)).alias("sse"))
    out = per.join(sse, "split", "left")
    out = out.crossJoin(F.broadcast(bins)) if bins is not None else out.withColumn("bins", F.lit(n_bins))
    n = F.col("plane") * F.col("bins")
    return out.select("split", F.coalesce("sse", F.lit(0.0)).alias("sse"), n.cast("long").alias("n"), (F.coalesce("sse", F.lit(0.0)) / n).alias("mse"))


def mse_split_loci(train_bins: DataFrame, valid_bins: DataFrame, predicted: DataFrame, splits: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Errors when validation uses bins of its own: train over the first tensor's bins, the other splits over the second's."""
    a = mse_by_split(train_bins, predicted, splits.where("split = 'train'"), keys=keys)
    return a.unionByName(mse_by_split(valid_bins, predicted, splits.where("split <> 'train'"), keys=keys))


def mse_per_experiment(t: DataFrame, predicted: DataFrame, n_bins: int, keys: list[str] = KEYS) -> DataFrame:
    """(row_id, col_id, mse): mean over all bins; a cell missing from either side reads 0."""
    joined = predicted.join(t, [*keys, *CELL], "left")
    return joined.groupBy(*CELL).agg((F.sum(F.pow(F.col("predicted") - F.coalesce("value", F.lit(0.0)), 2)) / n_bins).alias("mse"))


def penalty(factors: DataFrame, vector: str = "factors", bias: str = "bias") -> DataFrame:
    """Sums of squares of an axis: (factors2, bias2)."""
    return factors.agg(F.sum(sum_of_squares(F.col(vector))).alias("factors2"), F.sum(F.pow(F.col(bias), 2)).alias("bias2"))


def objective(sse: DataFrame, rows: DataFrame, cols: DataFrame, bins: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(objective): training error and weighted penalties. sse: one row (sse); the others are penalty() of an axis;
    weights are rc, rbc, ra, rba, ri, rbi."""
    out, total = sse.select("sse"), F.col("sse")
    for axis, part in (("c", rows), ("a", cols), ("i", bins)):
        out = out.crossJoin(F.broadcast(part.select(F.col("factors2").alias(f"f{axis}"), F.col("bias2").alias(f"b{axis}"))))  # a row each
        total = total + weights[f"r{axis}"] * F.col(f"f{axis}") + weights[f"rb{axis}"] * F.col(f"b{axis}")
    return out.select(total.alias("objective"))


def trace_windows(trace: DataFrame, win: int, spacing: int, shift: float) -> DataFrame:
    """(iter, z): for every point of an error trace (iter from 0 without gaps, error) that ends two windows of `win`
    points with `spacing` between them, the rank-sum statistic of the first against the second plus `shift`."""
    need = 2 * win + spacing
    ends = trace.where(F.col("iter") >= need - 1).select(F.col("iter").alias("end"))
    span = F.sequence(F.lit(0), F.lit(need - 1))
    points = ends.withColumn("k", F.explode(span)).where((F.col("k") < win) | (F.col("k") >= win + spacing)).withColumn("iter", F.col("end") - need + 1 + F.col("k"))
    x = points.join(trace, "iter").withColumn("e", F.col("error") + F.when(F.col("k") < win, F.lit(0.0)).otherwise(F.lit(shift)))
    rank = F.rank().over(Window.partitionBy("end").orderBy("e")) + (F.count(F.lit(1)).over(Window.partitionBy("end", "e")) - 1) / F.lit(2.0)
    w = x.withColumn("r", rank).where(F.col("k") < win).groupBy("end").agg(F.sum("r").alias("w"))
    return w.select(F.col("end").alias("iter"), ((F.col("w") - win * (2 * win + 1) / 2) / (win * win * (2 * win + 1) / 12) ** 0.5).alias("z"))
