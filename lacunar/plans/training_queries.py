"""Registered queries of the training operators. SQL can't express them; tests compare them with brute force."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.operators import folds, impute, model, tensor
from lacunar.operators.tensor import KEYS
from lacunar.operators.train import ROWS_BINS, ROWS_ONLY, Options, State, bin_cells, bin_states, errors, train_bins
from lacunar.sources.shared import cut

from . import fixtures as fx
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SMALL = Options(rank=3, batch=400, max_iters=4, per_mse=2, burn_in_epochs=0.0, rc=0.01, ra=0.01, ri=0.01, rate=0.02)


def query(f):
    QUERIES[f.__name__] = f
    return f


TRACE = "iter int, objective double, train double, valid double, test double"


def trace(spark: SparkSession, o: Options, d: str, **options) -> DataFrame:
    return spark.createDataFrame(pipelines.train_model(fx.e(spark, d), fx.splits(spark, 20, 5), o, n_workers=4, **options)[2].trace, TRACE)


@query
def nadam_train_small(spark, d):
    """Error trace of a short training run on all three axes."""
    return trace(spark, SMALL, d)


@query
def nadam_nonneg(spark, d):
    return trace(spark, replace(SMALL, nonneg=True), d)


@query
def rows_only_train(spark, d):
    """Rows alone, on half of the bins; the other half, solved in closed form each time, is validated on."""
    return trace(spark, replace(SMALL, **{**ROWS_ONLY, "burn_in_epochs": 0.02}), d, fraction=0.5, valid_on_other_bins=True)


@query
def rows_bins_train(spark, d):
    return trace(spark, replace(SMALL, **{**ROWS_BINS, "burn_in_epochs": 0.02}), d)


@query
def bins_only_train(spark, d):
    """Bins alone, each worker until its own validation error stops falling; the errors before and after."""
    t, splits = fx.e(spark, d), fx.splits(spark, 20, 5)
    known = pipelines.splits_of(splits)
    mean = t.agg(F.avg("value")).first()[0]
    c = tensor.centered(t, mean)
    bins = model.init_bins(c.select(*KEYS).distinct(), 3, 1)
    state = State.of(model.init_axes(20, 5, 3, 1))
    fitted = train_bins(c, known, bins, state, replace(SMALL, max_iters=12, searches=1), 4, per_eval=200, win=4, spacing=1)
    full = bin_cells(c, 4)
    rows = [(i, *errors(bin_states(b, 4), state, known, full, SMALL)) for i, b in enumerate((bins, cut(fitted)))]
    return spark.createDataFrame(rows, TRACE)


@query
def bag_train(spark, d):
    """Two models on validation folds of one test fold, averaged over the models that held a cell out."""
    f = folds.nested_folds(spark, [(r, c) for r in range(20) for c in range(5)], 5, 8, 5, seed=7)
    pred, used = pipelines.bagged(fx.e(spark, d), f, 0, replace(SMALL, max_iters=2), 2, 3, n_workers=4)
    return impute.heldout_average(pred, used).select(*KEYS, "row_id", "col_id", F.round("predicted", 6).alias("predicted"))


@query
def search_grid(spark, d):
    """Candidates of a hyper-parameter search with the validation error each reaches."""
    t, s = fx.e(spark, d), fx.splits(spark, 20, 5)
    score = lambda o: pipelines.train_model(t, s, o, n_workers=4)[2].trace[-1][3]
    found = pipelines.search(replace(SMALL, max_iters=2), [{"ratezzzexp": -4.0}, {"ratezzzexp": -3.0, "ri": 0.1}], score)
    return spark.createDataFrame([(str(sorted(c.items())), e) for c, e in found], "candidate string, valid double")


@query
def search_halving(spark, d):
    """Successive halving of four candidates on the cells of E: iterations each got, and the validation error it reached."""
    candidates = [{"ratezzzexp": -9.0}, {"ratezzzexp": -3.0}, {"ratezzzexp": -4.0, "ri": 0.1}, {"ratezzzexp": -7.0}]
    found = pipelines.halving(fx.e(spark, d), fx.splits(spark, 20, 5), SMALL, candidates, rungs=(1, 3), keep=0.5, n_workers=4)
    return spark.createDataFrame([(str(sorted(c.items())), n, e) for c, n, e in found], "candidate string, iterations int, valid double")
