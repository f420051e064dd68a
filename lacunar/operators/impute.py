"""Requests for cells, and averages over several models.

Model outputs are long frames (keys, row_id, col_id, predicted); averages are one union and one partial aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacunar.sources.shared import cut

from .tensor import CELL, KEYS, plane


def requested_cells(rows: DataFrame, cols: DataFrame, row_names: list[str] | None = None, col_names: list[str] | None = None) -> DataFrame:
    """(row_id, col_id, row_name, col_name) of the named rows and columns that the model has, all of a side by default.
    Raises if a side has none of the names. rows: (row_name, row_id); cols: (col_name, col_id)."""

    def side(axis: DataFrame, name: str, wanted: list[str] | None) -> DataFrame:
        some = axis if wanted is None else axis.where(F.col(name).isin(wanted))
        if wanted is not None and some.isEmpty():
            raise ValueError(f"no requested {name} present in model")
        return some

    return side(rows, "row_name", row_names).crossJoin(plane(side(cols, "col_name", col_names))).select(*CELL, "row_name", "col_name")


def missing_only(predicted: DataFrame, t: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Predictions of the cells that were not observed."""
    return predicted.join(t, [*keys, *CELL], "left_anti")


def united(models: list[DataFrame]) -> DataFrame:
    """All models' predictions, with their number."""
    return reduce(DataFrame.unionByName, (m.withColumn("model", F.lit(i)) for i, m in enumerate(models)))


def model_sum(models: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    return united(models).groupBy(*keys, *CELL).agg(F.sum("predicted").alias("predicted"))


def model_average(models: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Sum over the models divided by their number, whether or not each has the cell."""
    return model_sum(models, keys).withColumn("predicted", F.col("predicted") / len(models))


def heldout_average(predicted: DataFrame, splits: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean over the models that neither trained nor validated on the cell; 0 if there is none.

    predicted: united(); splits: (model, row_id, col_id, split)."""
    used = splits.where("split in ('train', 'valid')").select("model", *CELL).distinct().withColumn("used", F.lit(True))
    out = predicted.join(plane(used), ["model", *CELL], "left")
    return out.groupBy(*keys, *CELL).agg(F.coalesce(F.avg(F.when(F.col("used").isNull(), F.col("predicted"))), F.lit(0.0)).alias("predicted"))


def fold_aware_average(predicted: DataFrame, test_of: DataFrame, observed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean over models by test fold: a cell in a test set takes the models of that fold, an unobserved cell all models,
    any other observed cell the models of its own fold value.

    predicted: united() with a column test_fold; test_of: (row_id, col_id, fold); observed: (row_id, col_id)."""
    known = observed.select(*CELL).distinct().withColumn("seen", F.lit(True)).join(test_of.select(*CELL, "fold"), CELL, "full")
    out = predicted.join(plane(cut(known)), CELL, "left")
    counts = F.col("seen").isNull() & F.col("fold").isNull() | (F.col("fold") == F.col("test_fold"))
    return out.groupBy(*keys, *CELL).agg(F.coalesce(F.avg(F.when(counts, F.col("predicted"))), F.lit(0.0)).alias("predicted"))
