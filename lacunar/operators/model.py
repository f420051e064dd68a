"""The factor model: x = mean + sum_k row_k col_k bin_k + row_bias + col_bias + bin_bias.

Row and column factors are as long as the plane's axes and live on the driver as arrays; bin factors are a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.functions.scalar import clamp
from lacunar.sources.shared import cut

from .tensor import CELL, KEYS, PLANE_ROWS, packed


@dataclass
class Axes:
    """Factors and biases of rows and columns, and the mean that was taken off."""

    rows: np.ndarray
    row_bias: np.ndarray
    cols: np.ndarray
    col_bias: np.ndarray
    mean: float = 0.0

    @property
    def rank(self) -> int:
        return self.rows.shape[1]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(id, factors, bias) of rows and columns."""
        make = lambda x, b: spark.createDataFrame([(i, v.tolist(), float(w)) for i, (v, w) in enumerate(zip(x, b, strict=True))], "id int, factors array<double>, bias double")
        return make(self.rows, self.row_bias), make(self.cols, self.col_bias)


def init_axes(n_rows: int, n_cols: int, rank: int, seed: int, row_bias=None, col_bias=None, mean: float = 0.0, spread: float = 0.33) -> Axes:
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.uniform(-spread, spread, (n, rank))
    return Axes(draw(n_rows), np.zeros(n_rows) if row_bias is None else np.asarray(row_bias, float), draw(n_cols), np.zeros(n_cols) if col_bias is None else np.asarray(col_bias, float), mean)


def init_bins(bins: DataFrame, rank: int, seed: int, keys: list[str] = KEYS, spread: float = 0.33) -> DataFrame:
    """Bin factors drawn from the bin's own hash: the same for a bin wherever it is computed."""
    draw = F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda k: (F.pmod(F.xxhash64(F.lit(seed), k, *keys), F.lit(1 << 40)) / (1 << 40) * 2 - 1) * spread)
    return bins.select(*keys).withColumn("factors", draw).withColumn("bias", F.lit(0.0))


def with_noise(bins: DataFrame, seed: int, scale: float, keys: list[str] = KEYS) -> DataFrame:
    """Bin factors with uniform noise of at most `scale` added, drawn from the bin's hash; scale 0 changes nothing."""
    draw = lambda k: (F.pmod(F.xxhash64(F.lit(seed), k, *keys), F.lit(1 << 40)) / (1 << 40) * 2 - 1) * scale
    return bins.withColumn("factors", F.transform("factors", lambda x, k: x + draw(k)))


#: The most cells of a plane that are sent to the executors at once. A larger plane is predicted block by block.
PLANE_CELLS = 1 << 17


def predicted(bins: DataFrame, rows: DataFrame, cols: DataFrame, mean: float = 0.0, cells: DataFrame | None = None, keys: list[str] = KEYS, unrolled: int = 8, block: int = PLANE_CELLS) -> DataFrame:
    """(keys, row_id, col_id, predicted) for the requested cells of every bin, all cells by default.

    The products of row and column factors are formed once per cell of the plane. Ranks up to `unrolled` are written out
    as a sum, which Spark compiles; higher ranks are matrix products of an Arrow batch of bins with some thousand cells.
    The output is bins times cells by its nature. A plane of more than `block` cells is cut into blocks of about so many,
    each of which reads the bins again."""
    n = rows.count() * cols.count() if cells is None else cells.count()
    blocks = max(1, -(-n // block))
    rank = (rows.select(F.size("factors")).first() or [0])[0]
    part = lambda df, k: df.where(F.pmod(F.xxhash64(*CELL), F.lit(blocks)) == k) if blocks > 1 else df
    if rank > unrolled and cells is None:
        return _predicted_in_batches(bins, rows, cols, mean, None, keys)
    if rank > unrolled:
        return reduce(DataFrame.unionByName, (_predicted_in_batches(bins, rows, cols, mean, part(cells, k), keys) for k in range(blocks)))
    whole = rows.select(F.col("id").alias("row_id"), F.col("factors").alias("_r"), F.col("bias").alias("_rb")).crossJoin(cols.select(F.col("id").alias("col_id"), F.col("factors").alias("_c"), F.col("bias").alias("_cb")))
    if cells is not None:
        whole = whole.join(F.broadcast(cells.select(*CELL)) if blocks == 1 else cells.select(*CELL), CELL, "left_semi")
    whole = whole.select(*CELL, *((F.get("_r", F.lit(k)) * F.get("_c", F.lit(k))).alias(f"_z{k}") for k in range(rank)), (F.col("_rb") + F.col("_cb") + F.lit(mean)).alias("_b"))
    total = F.col("_b") + F.col("bias")
    if rank:
        total = sum((F.col(f"_z{k}") * F.col(f"_f{k}") for k in range(1, rank)), F.col("_z0") * F.col("_f0")) + total
    flat = bins.select(*keys, "bias", *(F.get("factors", F.lit(k)).alias(f"_f{k}") for k in range(rank)))
    made = (flat.crossJoin(F.broadcast(part(whole, k))).select(*keys, *CELL, total.alias("predicted")) for k in range(blocks))
    return reduce(DataFrame.unionByName, made)


def _axis(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, factors, biases) of an axis, as arrays on the driver."""
    t = df.select("id", "factors", "bias").toArrow()
    return t.column("id").to_numpy(), np.array(t.column("factors").to_pylist(), float).reshape(len(t), -1), t.column("bias").to_numpy()


def _predicted_in_batches(bins: DataFrame, rows: DataFrame, cols: DataFrame, mean: float, cells: DataFrame | None, keys: list[str], at_once: int = 1 << 12, out_cells: int = 1 << 18) -> DataFrame:
    """predicted() by matrix products of bins with `at_once` cells of the plane, formed on the executors from the two
    axes; about `out_cells` cells of output at a time."""
    (row_ids, r, rb), (col_ids, c, cb) = _axis(rows), _axis(cols)
    n, chosen, kinds = len(row_ids) * len(col_ids), None, dict(bins.dtypes)
    if cells is not None:
        t = cells.select(*CELL).toArrow()
        place = [{int(i): k for k, i in enumerate(ids)} for ids in (row_ids, col_ids)]
        known = [(place[0][x], place[1][y]) for x, y in zip(*(t.column(k).to_pylist() for k in range(2)), strict=True) if x in place[0] and y in place[1]]
        chosen, n = np.array(sorted(set(known)), np.int64).reshape(-1, 2), len(set(known))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in filter(len, batches):
            f = whole.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(whole.num_rows, -1)
            bias = whole.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            for begin in range(0, n, at_once):
                at = np.arange(begin, min(n, begin + at_once))
                i, j = np.divmod(at, len(col_ids)) if chosen is None else chosen[at].T
                z, b = (r[i] * c[j]).T, rb[i] + cb[j] + mean
                step = max(1, out_cells // len(at))
                for first in range(0, whole.num_rows, step):
                    own = slice(first, min(first + step, whole.num_rows))
                    out = f[own] @ z + b + bias[own, None]
                    take = pa.array(np.repeat(np.arange(own.start, own.stop), len(at)))
                    ids = (pa.array(np.tile(x, own.stop - own.start).astype(np.int32)) for x in (row_ids[i], col_ids[j]))
                    yield pa.RecordBatch.from_arrays([*(whole.column(k).take(take) for k in range(len(keys))), *ids, pa.array(out.ravel())], [*keys, *CELL, "predicted"])

    return bins.select(*keys, "factors", "bias").mapInArrow(each, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row_id int, col_id int, predicted double")


def clamped(p: DataFrame) -> DataFrame:
    return p.withColumn("predicted", clamp(F.col("predicted")))


def design(axes: Axes, train: list[tuple[int, int]], ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the training cells, design matrix, and the matrix that takes residuals to (factors, bias).

    The bias is not regularised. One inverse serves all bins, since a missing training cell counts as the mean."""
    r, c = np.array(train).T
    z = np.vstack([(axes.rows[r] * axes.cols[c]).T, np.ones(len(train))])
    weight = np.diag(np.r_[np.full(axes.rank, ridge), 0.0])
    return axes.row_bias[r] + axes.col_bias[c], z, z.T @ np.linalg.inv(z @ z.T + weight)


def solve_bins(t: DataFrame, axes: Axes, train: list[tuple[int, int]], ridge: float, keys: list[str] = KEYS) -> DataFrame:
    """(keys, factors, bias): closed-form ridge solution of every bin of the centered tensor.

    Cells are packed per bin, then whole Arrow batches of bins are multiplied at once."""
    offset, _, solve = design(axes, train, ridge)
    place = np.full((len(axes.rows), len(axes.cols)), -1)
    place[tuple(np.array(train).T)] = np.arange(len(train))
    kinds = dict(t.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bin_of, r, c, v = cell_arrays(b.column(len(keys)))
            inside = (r < place.shape[0]) & (c < place.shape[1])
            k = np.full(len(r), -1)
            k[inside] = place[r[inside], c[inside]]
            d = np.zeros((b.num_rows, len(train)))
            d[bin_of[k >= 0], k[k >= 0]] = v[k >= 0]
            g = (d - offset) @ solve
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * axes.rank)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.ListArray.from_arrays(ends, pa.array(g[:, :-1].ravel())), pa.array(g[:, -1])], [*keys, "factors", "bias"])

    return packed(t, keys).select(*keys, "cells").mapInArrow(each, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", factors array<double>, bias double")


def cell_arrays(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, row, column, value) of packed cells as four long arrays; null is no cell."""
    n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(cells), 0))
    flat = cells.flatten()
    part = lambda i, kind: flat.field(i).to_numpy(zero_copy_only=False).astype(kind)
    return np.repeat(np.arange(len(cells)), n), part(0, int), part(1, int), part(2, float)


def solve_bins_rank1(t: DataFrame, plane: DataFrame, ridge: float, keys: list[str] = KEYS) -> DataFrame:
    """(keys, g, gb): the same for rank one, by sums alone. plane: (row_id, col_id, z, offset) of the training cells.

    The sums over all training cells are those over the observed ones and, for the missing, over the plane once."""
    plane = cut(plane)
    small = plane.count() <= PLANE_ROWS
    flat = plane.agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum("z").alias("z"), F.count(F.lit(1)).alias("n"), F.sum(-F.col("z") * F.col("offset")).alias("ze0"), F.sum(-F.col("offset")).alias("e0"))
    seen = t.join(F.broadcast(plane) if small else plane, CELL).groupBy(*keys).agg(F.sum(F.col("z") * F.col("value")).alias("zd"), F.sum("value").alias("d"))
    s = t.select(*keys).distinct().join(seen, keys, "left").crossJoin(F.broadcast(flat))
    szz, sze, se = F.col("zz") + ridge, F.coalesce("zd", F.lit(0.0)) + F.col("ze0"), F.coalesce("d", F.lit(0.0)) + F.col("e0")
    det = szz * F.col("n") - F.col("z") * F.col("z")
    return s.select(*keys, ((sze * F.col("n") - F.col("z") * se) / det).alias("g"), ((szz * se - F.col("z") * sze) / det).alias("gb"))
