"""Balanced train, validation and test splits of a catalogue's cells. Catalogues are planes of a few thousand cells."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tensor import CELL


def formula_split(row: Column, col: Column) -> Column:
    """A fixed split in tenths: 7 train, 2 valid, 1 test."""
    x = (row * 7 + col * 3) % 10
    return F.when(x < 7, F.lit("train")).when(x < 9, F.lit("valid")).otherwise(F.lit("test"))


def all_train(cells: DataFrame) -> DataFrame:
    return cells.select(*CELL, F.lit("train").alias("split"))


def load_split(folds: DataFrame, test_fold: int, valid_fold: int, train_on_all: bool = False) -> DataFrame:
    """One fold's (row_id, col_id, split) out of a fold table; with train_on_all every cell trains."""
    one = folds.where((F.col("test_fold") == test_fold) & (F.col("valid_fold") == valid_fold)).select(*CELL, "split")
    return all_train(one) if train_on_all else one


def round_robin(cells: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Cells dealt to n folds in the given order, which must be total."""
    return cells.withColumn("fold", F.pmod(F.row_number().over(Window.orderBy(*order)) - 1, F.lit(n)).cast("int"))


def fold_quality(folds: DataFrame) -> DataFrame:
    """Sum over rows and columns of the most cells any fold has of each; the smaller, the better balanced."""

    def side(name: str) -> DataFrame:
        return folds.groupBy(name, "fold").agg(F.count(F.lit(1)).alias("n")).groupBy(name).agg(F.max("n").alias("most")).agg(F.sum("most").alias("s"))

    return side("row_id").unionAll(side("col_id")).agg(F.sum("s").cast("long").alias("quality"))


def _qualities(cells: np.ndarray, fold_of: np.ndarray, n: int) -> np.ndarray:
    """fold_quality() of many deals at once. fold_of: (deal, cell)."""
    total, deal = np.zeros(len(fold_of), np.int64), np.arange(len(fold_of))[:, None]
    for axis in cells.T:
        names, at = np.unique(axis, return_inverse=True)
        seen = np.bincount(((deal * len(names) + at) * n + fold_of).ravel(), minlength=len(fold_of) * len(names) * n)
        total += seen.reshape(len(fold_of), len(names), n).max(2).sum(1)
    return total


def best_split(cells: list[tuple[int, int]], n: int, tries: int, rng: random.Random) -> list[int]:
    """Of `tries` random deals of the cells to n folds the best balanced one, the first of equals, as a fold per cell."""
    places, draw = np.array(cells).reshape(-1, 2), np.random.default_rng(rng.getrandbits(64))
    best, low, most = np.arange(len(cells)) % n, None, max(1, (1 << 20) // max(1, len(cells)))
    for at in range(0, tries if cells else 0, most):
        order = draw.random((min(most, tries - at), len(cells))).argsort(1)
        fold_of = order.argsort(1) % n
        quality = _qualities(places, fold_of, n)
        if low is None or quality.min() < low:
            best, low = fold_of[quality.argmin()], quality.min()
    return best.tolist()


def patched(splits: DataFrame) -> DataFrame:
    """Rows without a training cell get their validation cells for training, then columns likewise."""
    for axis in CELL:
        train = F.max((F.col("split") == "train").cast("int")).over(Window.partitionBy(axis))
        splits = splits.withColumn("_t", train).withColumn("split", F.when((F.col("_t") == 0) & (F.col("split") == "valid"), F.lit("train")).otherwise(F.col("split"))).drop("_t")
    return splits


def _patch(split: dict[tuple[int, int], str], take_test: bool, rng: random.Random, given: set[tuple[int, int]]) -> None:
    for axis in (0, 1):
        for name in sorted({c[axis] for c in split}):
            own = [c for c in split if c[axis] == name]
            if any(split[c] == "train" for c in own):
                continue
            if valid := [c for c in own if split[c] == "valid"]:
                for c in valid:
                    split[c] = "train"
            elif take_test:
                c = rng.choice(sorted(own))
                split[c] = "train"
                given.add(c)
            else:
                raise ValueError(f"no training data for {CELL[axis]} {name}")


def nested_folds(spark: SparkSession, cells: list[tuple[int, int]], n_test: int = 5, n_valid: int = 8, tries: int = 10_000, seed: int = 0, take_test: bool = False, fixed_test: list[list[tuple[int, int]]] | None = None) -> DataFrame:
    """(test_fold, valid_fold, row_id, col_id, split): for each test fold the rest split into validation folds.

    Rows and columns left without a training cell are patched from validation, with `take_test` from one random test
    cell, else it is an error. `fixed_test` gives the test folds instead of drawing them."""
    rng, cells = random.Random(seed), sorted(cells)
    if fixed_test is None:
        fold_of = best_split(cells, n_test, tries, rng)
        fixed_test = [[c for c, f in zip(cells, fold_of, strict=True) if f == k] for k in range(n_test)]
    out = []
    for k, test in enumerate(fixed_test):
        held, given = set(test), set()
        rest = [c for c in cells if c not in held]
        valid_of = best_split(rest, n_valid, tries, rng)
        for v in range(n_valid):
            split = dict.fromkeys(test, "test") | {c: "valid" if f == v else "train" for c, f in zip(rest, valid_of, strict=True)} | dict.fromkeys(given, "train")
            _patch(split, take_test, rng, given)
            out += [(k, v, r, c, s) for (r, c), s in sorted(split.items())]
    return spark.createDataFrame(out, "test_fold int, valid_fold int, row_id int, col_id int, split string")


def bin_subsets(t: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Each bin's observed cells cut, in order, into n contiguous subsets of nearly equal size."""
    return t.withColumn("subset", (F.ntile(n).over(Window.partitionBy(*keys).orderBy(*CELL)) - 1).cast("int"))
