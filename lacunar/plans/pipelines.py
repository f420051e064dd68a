"""Whole runs: training one model, bags of models, a new row for a trained model, and hyper-parameter search."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import asdict, replace
from math import exp

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.operators import impute, model, stats, tensor
from lacunar.operators import train as tr
from lacunar.operators.tensor import KEYS
from lacunar.sources import sinks
from lacunar.sources.shared import cut, exists, forget


def splits_of(splits: DataFrame) -> dict[tuple[int, int], str]:
    return {(r["row_id"], r["col_id"]): r["split"] for r in splits.collect()}  # the plane's cells


def train_model(t: DataFrame, splits: DataFrame, o: tr.Options, fraction: float = 1.0, n_workers: int | None = None, keys: list[str] = KEYS, valid_on_other_bins: bool = False, out: str | None = None, command: dict | None = None, checkpoint: str | None = None, restart: bool = False, slice_bins: int = 1000) -> tuple[model.Axes, DataFrame, tr.Fit]:
    """(axes, bin factors of all bins, fit): centers, starts from biases, trains on a fraction of the bins, then solves all
    bins in closed form.

    Workers are slices of `slice_bins` training bins, 20 at least; `n_workers` asks for so many, one a bucket, instead.
    With `valid_on_other_bins` twice the fraction is drawn; the first half in order trains and the second is validated
    on. With `out`, a folder, the command is recorded there first, and the trace and the model are saved at the end."""
    spark = t.sparkSession
    if out:
        sinks.record_run(spark, f"{out}/command", command or {}, restart)
    n_rows, n_cols = t.select("row_id", "col_id").unionByName(splits.select("row_id", "col_id")).agg(F.max("row_id") + 1, F.max("col_id") + 1).first()
    mine = stats.in_split(t, splits, "train")
    mean = mine.agg(F.avg("value")).first()[0] or 0.0
    c, mine = tensor.centered(t, mean), tensor.centered(mine, mean)
    rows = cut(stats.row_bias(mine))
    cols = cut(stats.col_bias(mine, rows))
    rb, cb = np.zeros(n_rows), np.zeros(n_cols)
    for r in rows.collect():
        rb[r["row_id"]] = r["row_bias"]
    for r in cols.collect():
        cb[r["col_id"]] = r["col_bias"]
    share = fraction * (2 if valid_on_other_bins else 1)
    some, other = tensor.sampled(c, share, o.seed, keys) if share < 1 else c, None
    if valid_on_other_bins:
        halves = tensor.halves(some.select(*keys).distinct(), keys)
        some, other = (tensor.in_bins(some, halves.where(F.col("half") == k), keys) for k in (0, 1))
    some = cut(some)
    bins = model.init_bins(some.select(*keys).distinct(), o.rank, o.seed, keys)
    bias = stats.bin_bias(stats.in_split(some, splits, "train"), rows, cols, bins, keys)
    bins = cut(bins.drop("bias").join(bias.withColumnRenamed("bin_bias", "bias"), keys))
    n_bins = bins.count()
    o = o.scaled(n_rows, n_cols, n_bins)
    known = splits_of(splits)
    state = tr.State.of(model.init_axes(n_rows, n_cols, o.rank, o.seed, rb, cb))
    if o.burn_in_epochs and not restart:
        state = tr.burn_in(stats.in_split(some, splits, "train"), bins, state, o, n_bins, sum(v == "train" for v in known.values()), keys)
    buckets, per_slice = (n_workers, None) if n_workers else tr.laid_out(n_bins, slice_bins)
    fit = tr.train(some, known, bins, state, o, buckets, keys, checkpoint, restart=restart, valid_bins=other, slice_bins=per_slice)
    axes = fit.state.axes(mean)
    solved = model.solve_bins(c, axes, sorted(k for k, v in known.items() if v == "train"), o.ri2, keys)
    if out:
        sinks.write_trace(spark, fit.trace, f"{out}/trace")
        sinks.save_model(axes, solved, asdict(o), f"{out}/model")
    return axes, solved, fit


def predict_model(axes: model.Axes, bins: DataFrame, cells: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    rows, cols = axes.frames(bins.sparkSession)
    return model.predicted(bins, rows, cols, axes.mean, cells, keys)


def solve_saved(spark: SparkSession, path: str, t: DataFrame, train: list[tuple[int, int]], cells: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Predictions of the asked cells by a saved model for the bins of a tensor, which it may never have seen: their
    factors are solved from the cells in `train`."""
    m = sinks.load_model(spark, path)
    bins = model.solve_bins(tensor.centered(t, m["axes"].mean), m["axes"], sorted(train), m["settings"]["ri2"], keys)
    return predict_model(m["axes"], bins, cells, keys)


def bagged(t: DataFrame, folds: DataFrame, test_fold: int, o: tr.Options, bags: int, seed: int, keys: list[str] = KEYS, path: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(predictions of all models, their splits) of `bags` models on validation folds drawn without replacement.

    With `path` each model is saved there, and a run that starts again trains only those that are not there yet."""
    spark = t.sparkSession
    known = sorted(r[0] for r in folds.where(F.col("test_fold") == test_fold).select("valid_fold").distinct().collect())
    outs, used = [], None
    for i, v in enumerate(random.Random(seed).sample(known, bags)):
        one = folds.where((F.col("test_fold") == test_fold) & (F.col("valid_fold") == v)).select("row_id", "col_id", "split")
        where = f"{path}/bag-{test_fold}-{v}-{i}"
        if path and exists(spark, f"{where}/manifest/_SUCCESS"):  # written last
            m = sinks.load_model(spark, where)
            axes, bins = m["axes"], m["bins"]
        else:
            axes, bins, _ = train_model(t, one, replace(o, seed=o.seed + i), keys=keys, **options)
            if path:
                forget(spark, where)
                sinks.save_model(axes, bins, {**asdict(o), "seed": o.seed + i, "valid_fold": v}, where)
                bins = spark.read.parquet(f"{where}/bins")
        outs.append(predict_model(axes, bins, keys=keys))
        part = one.withColumn("model", F.lit(i))
        used = part if used is None else used.unionByName(part)
    return impute.united(outs), used


def add_row(t: DataFrame, new: DataFrame, a_cols: DataFrame, b_cols: DataFrame, splits: DataFrame, axes: model.Axes, o: tr.Options, n_workers: int | None = None, keys: list[str] = KEYS, slice_bins: int = 1000) -> tuple[model.Axes, tr.Fit]:
    """A new row entity for a trained model: its cells are stacked under the tensor's and train; columns stay as they are,
    rows and bins are fitted."""
    n = len(axes.rows)
    both = tensor.merged(t, new, a_cols, b_cols, n, keys)
    cells = both.where(F.col("row_id") >= n).select((F.col("row_id") - n).alias("row_id"), "col_id").distinct()
    all_splits = tensor.merged_splits(splits, cells, n)
    extra = model.init_axes(cells.agg(F.max("row_id") + 1).first()[0] or 0, len(axes.cols), axes.rank, o.seed)
    grown = model.Axes(np.vstack([axes.rows, extra.rows]), np.r_[axes.row_bias, extra.row_bias], axes.cols, axes.col_bias, axes.mean)
    c = tensor.centered(both, axes.mean)
    bins = model.init_bins(c.select(*keys).distinct(), axes.rank, o.seed, keys)
    n_bins = bins.count()
    o = replace(o, cols=False).scaled(len(grown.rows), len(axes.cols), n_bins)
    buckets, per_slice = (n_workers, None) if n_workers else tr.laid_out(n_bins, slice_bins)
    fit = tr.train(c, splits_of(all_splits), bins, tr.State.of(grown), o, buckets, keys, slice_bins=per_slice)
    return fit.state.axes(axes.mean), fit


def search_options(base: tr.Options, params: dict[str, float]) -> tr.Options:
    """Options with the given values. A name that ends in zzzexp, a fixed convention of parameter files, stands for the
    exponential of its value."""
    return replace(base, **{k.removesuffix("zzzexp"): exp(v) if k.endswith("zzzexp") else v for k, v in params.items()})


def search(base: tr.Options, candidates: list[dict[str, float]], score: Callable[[tr.Options], float]) -> list[tuple[dict, float]]:
    """Candidates with their scores, best (lowest) first. The score of a training run is its last validation error."""
    return sorted(((c, score(search_options(base, c))) for c in candidates), key=lambda x: x[1])


def halving(t: DataFrame, splits: DataFrame, base: tr.Options, candidates: list[dict[str, float]], rungs: tuple[int, ...] = (3, 9, 27), keep: float = 1 / 3, n_workers: int | None = None, keys: list[str] = KEYS, slice_bins: int = 1000) -> list[tuple[dict, int, float]]:
    """(candidate, iterations, validation error) by successive halving, best first: all candidates are trained for the first
    rung's iterations, the best share `keep` of them goes on to the next rung, one at least.

    The cells are centered, dealt to buckets and written once for all candidates and rungs; a candidate that goes on does
    so from its own state. Those that reached a later rung stand before those that did not; equal errors and errors that
    aren't numbers (last) keep the order of `candidates`. Biases start from zero, as every candidate draws its own factors."""
    known = splits_of(splits)
    n_rows, n_cols = (1 + max(k[i] for k in known) for i in (0, 1))
    mean = stats.in_split(t, splits, "train").agg(F.avg("value")).first()[0] or 0.0
    c = cut(tensor.centered(t, mean))
    names = cut(c.select(*keys).distinct())
    n_bins = names.count()
    buckets, per_slice = (n_workers, None) if n_workers else tr.laid_out(n_bins, slice_bins)
    full, mine = tr.bin_cells(c, buckets, keys), tr.bin_cells(stats.in_split(c, splits, "train"), buckets, keys)
    held: dict[int, tuple] = {}
    alive, done, out = list(range(len(candidates))), 0, {}
    try:
        for rung in rungs:
            found = []
            for k in alive:
                o = search_options(base, candidates[k]).scaled(n_rows, n_cols, n_bins)
                if k not in held:
                    held[k] = (tr.bin_states(model.init_bins(names, o.rank, o.seed, keys), buckets, keys), tr.State.of(model.init_axes(n_rows, n_cols, o.rank, o.seed)))
                states, s = held[k]
                for i in range(done, rung):
                    last = states
                    states, s = tr.step(last, mine, s, o, i, buckets, keys, per_slice)
                    forget(t.sparkSession, last)
                    held[k] = (states, s)
                error = tr.errors(states, s, known, full, o, keys)[2]
                found.append((error != error, error, k))
                out[k] = (rung, error)
            done = rung
            alive = [k for *_, k in sorted(found, key=lambda x: (x[0], 0.0 if x[0] else x[1], x[2]))][: max(1, round(len(alive) * keep))]
            for k in [k for k in held if k not in alive]:
                forget(t.sparkSession, held.pop(k)[0])
    finally:
        for table in (full, mine, *(x[0] for x in held.values())):
            forget(t.sparkSession, table)
    order = sorted(out, key=lambda k: (-out[k][0], out[k][1] != out[k][1], 0.0 if out[k][1] != out[k][1] else out[k][1], k))
    return [(candidates[k], *out[k]) for k in order]


def random_candidates(ranges: dict[str, tuple[float, float]], n: int, seed: int) -> list[dict[str, float]]:
    rng = random.Random(seed)
    return [{k: rng.uniform(*r) for k, r in ranges.items()} for _ in range(n)]
