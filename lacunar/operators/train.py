"""Training of the factor model: partition-parallel Nadam-style steps with parameter averaging.

The cells of the training bins and the state of the bins are two tables, both dealt by the same hash into one bucket per
worker, so that they meet without a shuffle, and the cells are written once for all iterations. A step is a DataFrame
job: each bucket is one worker that draws observed training cells and updates its bins and its own copy of the row and
column parameters. The new bin states and the parameters come out as rows of one table, told apart by `kind`, so a task
that runs twice counts once; nothing travels through accumulators. Tables that no later step needs are removed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field, replace
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.sources.shared import dealt, forget

from .model import Axes, cell_arrays, design
from .tensor import KEYS, packed, plane


@dataclass(frozen=True)
class Options:
    """Settings of a run. The defaults are fixed values. Iterations are counted by min_iters and max_iters, evaluations of
    the error by win, spacing and wait_from."""

    rank: int = 100
    rate: float = 0.005
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    batch: int = 5000
    rc: float = 3.66
    ra: float = 1.23e-7
    ri: float = 1.23e-5
    ri2: float = 2.9
    rbc: float = 0.0
    rba: float = 0.0
    rbi: float = 0.0
    win: int = 15
    spacing: int = 5
    shift: float = 1e-5
    p_value: float = 0.05
    min_iters: int | None = None
    max_iters: int | None = None
    per_mse: int = 3
    searches: int = 3
    burn_in_epochs: float = 0.5
    burn_in_bins: int = 8000
    nonneg: bool = False
    rows: bool = True
    cols: bool = True
    bins: bool = True
    bail_at: int = 1000
    bail_gain: float = 0.005
    wait_from: str = "halving"  # or "minimum": what the evaluations before a convergence test are counted from
    seed: int = 5

    def scaled(self, n_rows: int, n_cols: int, n_bins: int) -> Options:
        """Factor penalties per entry of their axis; the bias penalties and ri2 are used as they are."""
        return replace(self, rc=self.rc / (self.rank * n_rows), ra=self.ra / (self.rank * n_cols), ri=self.ri / (self.rank * n_bins))


#: What the trainers of rows and bins, and of rows alone, set otherwise. Fixed values.
ROWS_BINS = {"cols": False, "burn_in_epochs": 1.05, "bail_gain": 0.02, "wait_from": "minimum"}
ROWS_ONLY = {"cols": False, "bins": False, "burn_in_epochs": 1.05}


class Moments:
    """Moments and update counts of a parameter table, one line per entity."""

    def __init__(self, shape: tuple[int, ...]):
        self.m, self.v, self.t, self.prod = np.zeros(shape), np.zeros(shape), np.zeros(shape[0], int), np.ones(shape[0])


def nadam(theta: np.ndarray, grad: np.ndarray, m: np.ndarray, v: np.ndarray, t, prod, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One update of one entity, or of several, a line each, with t and prod as columns. t counts from 1; prod is the
    product of the first-moment decays up to t - 1."""
    fade = (1 - 1e-6) ** (t - 1)
    b, after, rate = o.beta1 * fade, o.beta1 * fade * (1 - 1e-6), o.rate * fade
    prod = prod * b
    m = b * m + (1 - b) * grad
    v = o.beta2 * v + (1 - o.beta2) * (grad * grad)
    look = (1 - b) / (1 - prod) * grad + after / (1 - prod * after) * m
    theta = theta - rate * look / (np.sqrt(v) / (1 - o.beta2**t) ** 0.5 + o.epsilon)
    return (np.maximum(theta, 0) if o.nonneg else theta), m, v, prod


@dataclass
class State:
    """Row and column parameters with their moments. The last column of a table is the bias."""

    rows: np.ndarray
    cols: np.ndarray
    row_m: Moments = None
    col_m: Moments = None

    def __post_init__(self):
        self.row_m = self.row_m or Moments(self.rows.shape)
        self.col_m = self.col_m or Moments(self.cols.shape)

    @classmethod
    def of(cls, a: Axes) -> State:
        return cls(np.c_[a.rows, a.row_bias], np.c_[a.cols, a.col_bias])

    def axes(self, mean: float) -> Axes:
        return Axes(self.rows[:, :-1], self.rows[:, -1], self.cols[:, :-1], self.cols[:, -1], mean)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.rows, self.cols, self.row_m.m, self.row_m.v, self.row_m.t, self.row_m.prod, self.col_m.m, self.col_m.v, self.col_m.t, self.col_m.prod)]).astype(float)

    def from_flat(self, x: np.ndarray) -> State:
        """A state like this one with averaged numbers; update counts are rounded."""
        out, at = State(self.rows.copy(), self.cols.copy()), 0

        def take(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return x[at - like.size : at].reshape(like.shape)

        out.rows, out.cols = take(self.rows), take(self.cols)
        for m, old in ((out.row_m, self.row_m), (out.col_m, self.col_m)):
            m.m, m.v, m.t, m.prod = take(old.m), take(old.v), np.rint(take(old.t)).astype(int), take(old.prod)
        return out


def conflict_free(draws: np.ndarray) -> list[np.ndarray]:
    """Draws, each a line of entities, dealt to batches in which no entity stands twice: each goes to the first batch that
    is still free for it. A batch is the numbers of its draws, ascending. Entities are numbers from 0, other axes apart."""
    taken = [[0] * (int(c.max()) + 1) for c in draws.T] if len(draws) else []  # per entity a bit for each batch that has it
    batches: list[list[int]] = []
    for k, line in enumerate(draws.tolist()):
        used = 0
        for axis, e in zip(taken, line, strict=True):
            used |= axis[e]
        bit = ~used & (used + 1)
        for axis, e in zip(taken, line, strict=True):
            axis[e] |= bit
        if bit >> len(batches):
            batches.append([])
        batches[bit.bit_length() - 1].append(k)
    return [np.array(b) for b in batches]


def sgd_partition(cells: np.ndarray, values: np.ndarray, bins: np.ndarray, bin_m: Moments, s: State, o: Options, rng: np.random.Generator) -> None:
    """`batch` updates in place. cells: (bin, row, column) of the observed training cells; bins: factors and bias.

    The draws are dealt to batches without conflicts, and a batch is one update of whole matrices, the same as its draws
    one after another. Axes that stay as they are make no conflict."""
    if not len(cells):
        return
    axes = [(o.rows, 1, s.rows, s.row_m, o.rc, o.rbc), (o.cols, 2, s.cols, s.col_m, o.ra, o.rba), (o.bins, 0, bins, bin_m, o.ri, o.rbi)]
    moving = [x for x in axes if x[0]]
    if not moving:
        return
    # the moving tables one above the other, so that a batch is one update
    base = np.cumsum([0, *(len(x[2]) for x in moving)])
    theta, m, v = (np.concatenate(x) for x in ([x[2] for x in moving], [x[3].m for x in moving], [x[3].v for x in moving]))
    t, prod = (np.concatenate(x)[:, None] for x in ([x[3].t for x in moving], [x[3].prod for x in moving]))
    weight = [np.r_[np.full(theta.shape[1] - 1, x[4]), x[5]] for x in moving]
    place = {axis: k for k, (_, axis, *_) in enumerate(moving)}
    picked = rng.integers(0, len(cells), o.batch)
    drawn, wanted = cells[picked], values[picked]
    at = drawn[:, [x[1] for x in moving]] + base[:-1]
    fixed = {1: s.rows, 2: s.cols, 0: bins}
    for batch in conflict_free(drawn[:, [x[1] for x in moving]]):
        own, ids = at[batch], drawn[batch]
        part = {a: theta.take(own[:, place[a]], 0) if a in place else fixed[a].take(ids[:, a], 0) for a in (0, 1, 2)}
        g, rows, cols = part[0], part[1], part[2]
        pairs = {1: cols[:, :-1] * g[:, :-1], 2: rows[:, :-1] * g[:, :-1], 0: rows[:, :-1] * cols[:, :-1]}
        err = (pairs[0] * g[:, :-1]).sum(1) + rows[:, -1] + cols[:, -1] + g[:, -1] - wanted[batch]
        lines = own.T.ravel()
        grad = np.empty((len(lines), theta.shape[1]))
        for k, (_, axis, *_) in enumerate(moving):
            mine = slice(k * len(batch), (k + 1) * len(batch))
            np.multiply(pairs[axis], err[:, None], out=grad[mine, :-1])
            grad[mine, -1] = err
            grad[mine] += weight[k] * part[axis]
        t[lines] += 1
        theta[lines], m[lines], v[lines], prod[lines] = nadam(theta.take(lines, 0), grad, m.take(lines, 0), v.take(lines, 0), t.take(lines, 0), prod.take(lines, 0), o)
    for k, x in enumerate(moving):
        mine = slice(base[k], base[k + 1])
        x[2][:], x[3].m[:], x[3].v[:], x[3].t[:], x[3].prod[:] = theta[mine], m[mine], v[mine], t[mine, 0], prod[mine, 0]


#: Columns of a bin's state next to its keys.
STATE = "theta array<double>, m array<double>, v array<double>, t bigint, prod double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of its own."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).copy()


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def bin_states(bins: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Fresh states of bins (keys, factors, bias), dealt to n workers."""
    zeros = F.transform("theta", lambda _: F.lit(0.0))
    theta = bins.select(*keys, F.concat("factors", F.array("bias")).alias("theta"))
    return dealt(theta.select(*keys, "theta", zeros.alias("m"), zeros.alias("v"), F.lit(0).cast("long").alias("t"), F.lit(1.0).alias("prod"), F.lit("state").alias("kind")), n, keys)


def bin_cells(t: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Centered cells packed per bin, dealt to n workers as their states are."""
    return dealt(packed(t, keys), n, keys)


def together(states: DataFrame, cells: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """States with their bins' cells. Both are in buckets, so nothing is shuffled; a broadcast would lose the buckets."""
    own = states.where("kind = 'state'").select(*keys, "theta", "m", "v", "t", "prod")
    return own.hint("merge").join(cells.hint("merge").select(*keys, "cells"), keys, "left").sortWithinPartitions(*keys)


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """A bucket's rows cut into slices of about `size` rows, between half and one and a half times as many unless the
    bucket itself has fewer. No more than that is held."""
    held, n = [], 0
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            part = whole.slice(at, size + (size + 1) // 2 - n)
            at, n = at + part.num_rows, n + part.num_rows
            held.append(part)
            if n >= size + (size + 1) // 2:
                x = pa.Table.from_batches(held)
                yield x.slice(0, size)
                rest = x.slice(size).combine_chunks()  # a copy, so that the slice before can go
                held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)


def vector_sum(rows: DataFrame, vector: str, fan: int = 64) -> np.ndarray | None:
    """The sum of a column of equally long vectors, as a tree: `fan` at a time are added up in a task as Arrow batches,
    the last of them too, so one vector reaches the driver. Null without a row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = _matrix(b.column(0)).sum(0)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([_lists(total[None])], ["x"])

    part = rows.select(F.col(vector).alias("x")).mapInArrow(add, "x array<double>")  # one row a partition at most
    n = rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan)
        part = part.repartition(n).mapInArrow(add, "x array<double>")
    out = part.toArrow().column("x")
    return np.array(out[0].as_py()) if len(out) else None


def step(states: DataFrame, cells: DataFrame, s: State, o: Options, iteration: int, n: int, keys: list[str] = KEYS, slice_bins: int | None = None) -> tuple[DataFrame, State]:
    """One parallel iteration: new bin states, and the average of the workers' parameters.

    A worker is a slice of `slice_bins` bins (by default a whole bucket); a task goes through its bucket slice by slice and
    holds one at a time. Of the parameters a task leaves their sum over its slices and how many there were."""
    kinds = dict(states.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, total, last = [*keys, "theta", "m", "v", "t", "prod", "kind", "params"], None, None
        for x in slices(batches, slice_bins or 1 << 40):
            own = State(s.rows.copy(), s.cols.copy()).from_flat(s.flat())
            bins = _matrix(x["theta"])
            bm = Moments(bins.shape)
            bm.m, bm.v, bm.t, bm.prod = _matrix(x["m"]), _matrix(x["v"]), x["t"].to_numpy().copy(), x["prod"].to_numpy().copy()
            at, r, c, value = cell_arrays(x["cells"].combine_chunks())
            # the draw depends on the iteration and the worker's first bin, not on where the task runs
            first = zlib.crc32("|".join(str(x[k][0].as_py()) for k in keys).encode())
            sgd_partition(np.c_[at, r, c], value, bins, bm, own, o, np.random.default_rng([o.seed, iteration + 1, first]))
            none = pa.nulls(len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(x[k].combine_chunks() for k in keys), _lists(bins), _lists(bm.m), _lists(bm.v), pa.array(bm.t), pa.array(bm.prod), pa.array(["state"] * len(x)), none], names)
            flat = np.r_[own.flat(), 1.0]
            total, last = flat if total is None else total + flat, x.select(keys).slice(0, 1).combine_chunks()
        if total is not None:
            empty = pa.nulls(1, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(last[k].combine_chunks() for k in keys), empty, empty, empty, pa.array([0]), pa.array([0.0]), pa.array(["params"]), _lists(total[None])], names)

    new = together(states, cells, keys).mapInArrow(each, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {STATE}, kind string, params array<double>")
    out = dealt(new, n, keys, shuffle=False)  # a worker's rows are one bucket already
    total = vector_sum(out.where("kind = 'params'"), "params")
    return out, s if total is None else s.from_flat(total[:-1] / total[-1])


def laid_out(n_bins: int, slice_bins: int, least: int = 20, most: int = 4096) -> tuple[int, int]:
    """(buckets, bins in a slice) for so many bins: slices of `slice_bins` bins, `least` of them at least, in `most` buckets
    at most, which then hold several slices each."""
    n = max(least, -(-n_bins // max(1, slice_bins)))
    return min(n, most), max(1, -(-n_bins // n))


def factors_of(states: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, factors, bias) of bin states."""
    return states.where("kind = 'state'").select(*keys, F.slice("theta", F.lit(1), F.size("theta") - 1).alias("factors"), F.element_at("theta", -1).alias("bias"))


def rank_sum(a: list[float], b: list[float]) -> tuple[float, float]:
    """Wilcoxon rank-sum statistic z of a against b, and its two-sided p-value by the normal distribution."""
    joined = np.concatenate([a, b])
    order = joined.argsort(kind="stable")
    ranks = np.empty(len(joined))
    ranks[order] = np.arange(1, len(joined) + 1)
    for x in np.unique(joined):
        ranks[joined == x] = ranks[joined == x].mean()
    n1, n2 = len(a), len(b)
    z = (ranks[:n1].sum() - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return z, erfc(abs(z) / sqrt(2))


def converged(errors: list[float], o: Options) -> bool:
    """Whether the last window of validation errors is no longer below the one before it, both shifted apart by `shift`."""
    need = 2 * o.win + o.spacing
    if len(errors) < need:
        return False
    last = errors[-need:]
    z, p = rank_sum(last[: o.win], [x + o.shift for x in last[-o.win :]])
    return z < 0 and p / 2 < o.p_value


@dataclass
class Fit:
    """A trained model: bin factors, row and column parameters, and the trace (iter, objective, train, valid, test)."""

    states: DataFrame
    state: State
    trace: list[tuple[int, float, float, float, float]] = field(default_factory=list)


def _split_sums(s: State, splits: dict[tuple[int, int], str]):
    """A function from bins (factors and bias) and their packed cells to the squared errors of train, valid and test."""
    where = np.full((len(s.rows), len(s.cols)), 3)
    for (r, c), split in splits.items():
        where[r, c] = {"train": 0, "valid": 1, "test": 2}[split]
    z = (s.rows[:, None, :-1] * s.cols[None, :, :-1]).reshape(-1, s.rows.shape[1] - 1).T
    base, n_cols = (s.rows[:, None, -1] + s.cols[None, :, -1]).ravel(), len(s.cols)
    most = max(1, (1 << 22) // max(1, len(base)))

    def sums(theta: np.ndarray, cells: pa.Array) -> np.ndarray:
        out = np.zeros(4)
        for a in range(0, len(theta), most):
            own = theta[a : a + most]
            full = own[:, :-1] @ z + base + own[:, -1:]
            at, r, c, value = cell_arrays(cells.slice(a, most))
            out += np.bincount(where[r, c], (full[at, r * n_cols + c] - value) ** 2, minlength=4)
        return out[:3]

    return sums


def _summed(df: DataFrame, each, size: int) -> np.ndarray:
    """Sums over all tasks of the vectors that `each` yields as lists."""
    total = vector_sum(df.mapInArrow(each, "sums array<double>"), "sums")
    return np.zeros(size) if total is None else total


def errors(states: DataFrame, s: State, splits: dict[tuple[int, int], str], full: DataFrame, o: Options, keys: list[str] = KEYS, valid: DataFrame | None = None) -> tuple[float, float, float, float]:
    """(objective, train, valid, test): squared errors by split over all its cells in all bins; one pass over the bins.

    full: centered observed cells of all splits, bin_cells() of the same workers. With `valid`, packed cells of other
    bins, the bins there are solved in closed form with ri2 and the valid and test errors are theirs."""
    sums = _split_sums(s, splits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(6)
        for b in batches:
            if b.num_rows:
                theta = _matrix(b.column(0))
                total += np.r_[sums(theta, b.column(1)), (theta[:, :-1] ** 2).sum(), (theta[:, -1] ** 2).sum(), len(theta)]
        yield pa.RecordBatch.from_arrays([_lists(total[None])], ["sums"])

    x = _summed(together(states, full, keys).select("theta", "cells"), each, 6)
    other, bins = x[:3], x[5]
    if valid is not None:
        train = sorted(k for k, v in splits.items() if v == "train")
        offset, _, solve = design(s.axes(0.0), train, o.ri2)
        place = np.full((len(s.rows), len(s.cols)), -1)
        place[tuple(np.array(train).T)] = np.arange(len(train))

        def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(4)
            for b in batches:
                at, r, c, value = cell_arrays(b.column(0))
                k = place[r, c]
                d = np.zeros((b.num_rows, len(train)))
                d[at[k >= 0], k[k >= 0]] = value[k >= 0]
                total += np.r_[sums((d - offset) @ solve, b.column(0)), b.num_rows]
            yield pa.RecordBatch.from_arrays([_lists(total[None])], ["sums"])

        y = _summed(valid.select("cells"), solved, 4)
        other, bins = y[:3], y[3]
    sse = np.r_[x[0], other[1:]]
    count = [max(1, sum(v == k for v in splits.values())) * max(1, n) for k, n in (("train", x[5]), ("valid", bins), ("test", bins))]
    objective = x[0] + o.rc * (s.rows[:, :-1] ** 2).sum() + o.rbc * (s.rows[:, -1] ** 2).sum() + o.ra * (s.cols[:, :-1] ** 2).sum() + o.rba * (s.cols[:, -1] ** 2).sum() + o.ri * x[3] + o.rbi * x[4]
    return float(objective), *(float(e / n) for e, n in zip(sse, count, strict=True))


def save_checkpoint(path: str, iteration: int, states: DataFrame, s: State, best: tuple | None, rest: dict, o: Options, keep: int = 2) -> None:
    """All a run needs to go on: bin states now and at the minimum as Parquet, the rest as one JSON row written last, so
    that a checkpoint without it doesn't count. The last `keep` checkpoints stay, older ones are removed."""
    spark = states.sparkSession
    where = f"{path}/{iteration:08d}"
    states.write.mode("overwrite").parquet(f"{where}/states")
    if best:
        best[1].write.mode("overwrite").parquet(f"{where}/best")
    all_ = {"iteration": iteration, "flat": s.flat().tolist(), "best": [best[0], best[2].flat().tolist(), best[3]] if best else None, "rate": o.rate, "beta1": o.beta1, **rest}
    spark.createDataFrame([(iteration, json.dumps(all_))], "iteration int, rest string").coalesce(1).write.mode("append").json(f"{path}/index")
    known = [r[0] for r in spark.read.schema("iteration int").json(f"{path}/index").distinct().orderBy(F.desc("iteration")).collect()]  # one per checkpoint
    for old in known[keep:]:
        forget(spark, f"{path}/{old:08d}")


def load_checkpoint(spark: SparkSession, path: str, like: State) -> dict:
    """The latest whole checkpoint under `path`."""
    row = spark.read.schema("iteration int, rest string").json(f"{path}/index").orderBy(F.desc("iteration")).first()
    x, where = json.loads(row["rest"]), f"{path}/{row['iteration']:08d}"
    x["states"], x["state"] = spark.read.parquet(f"{where}/states"), like.from_flat(np.array(x["flat"]))
    if x["best"]:
        x["best"] = (x["best"][0], spark.read.parquet(f"{where}/best"), like.from_flat(np.array(x["best"][1])), x["best"][2])
    x["trace"] = [tuple(r) for r in x["trace"]]
    return x


def train(t: DataFrame, splits: dict[tuple[int, int], str], bins: DataFrame, start: State, o: Options, n_workers: int, keys: list[str] = KEYS, checkpoint: str | None = None, every: int = 80, restart: bool = False, valid_bins: DataFrame | None = None, slice_bins: int | None = None) -> Fit:
    """Trains on the centered tensor `t`: steps, an evaluation every `per_mse`, the best state kept, and at convergence a
    halved rate from the best state on, `searches` times.

    A convergence test comes once more than `win` evaluations have passed since the minimum that the last halving went
    back to (with wait_from "minimum", since the latest one). The run stops for good when no halving is left, by
    `max_iters`, by patience (no new minimum in twice the window and its spacing), when the training error fell by less
    than `bail_gain` in `bail_at` iterations, or when an error is not a number. `valid_bins` are centered cells of other
    bins, on which validation and test errors are then taken. With `checkpoint`, a folder, the run is saved every `every`
    iterations; with `restart` it goes on from the latest one there. Bins lie in `n_workers` buckets; each is one worker, or
    with `slice_bins` as many as it has slices of so many bins."""
    spark = t.sparkSession
    split_table = spark.createDataFrame([(r, c, k) for (r, c), k in splits.items()], "row_id int, col_id int, split string")
    mine = t.join(plane(split_table.where("split = 'train'")), ["row_id", "col_id"], "left_semi")
    full, cells = bin_cells(t, n_workers, keys), bin_cells(mine, n_workers, keys)
    other = bin_cells(valid_bins, n_workers, keys) if valid_bins is not None else None
    s, best, iteration, states = start, None, 0, None
    run = {"trace": [], "valid": [], "low": 0, "anchor": 0, "searches": o.searches}
    if restart:
        x = load_checkpoint(spark, checkpoint, start)
        states = dealt(x["states"], n_workers, keys)
        s, best, iteration, run = x["state"], x["best"], x["iteration"], {k: x[k] for k in run}
        best = best and (best[0], dealt(best[1], n_workers, keys), *best[2:])  # the checkpoint it lies in may go
        o = replace(o, rate=x["rate"], beta1=x["beta1"])
    else:
        states = bin_states(bins, n_workers, keys)
    while o.max_iters is None or iteration < o.max_iters:
        if checkpoint and iteration and iteration % every == 0:
            save_checkpoint(checkpoint, iteration, states, s, best, run, o)
        last = states
        states, s = step(last, cells, s, o, iteration, n_workers, keys, slice_bins)
        if best is None or best[1] is not last:
            forget(spark, last)
        iteration += 1
        trace, valid = run["trace"], run["valid"]
        if iteration == o.bail_at and trace and trace[0][2] - trace[-1][2] < o.bail_gain:
            break
        if iteration % o.per_mse and iteration != o.max_iters:
            continue
        row = errors(states, s, splits, full, o, keys, other)
        if any(e != e for e in row):
            break
        trace.append((iteration, *row))
        valid.append(row[2])
        if best is None or row[2] < best[0]:
            if best is not None:
                forget(spark, best[1])
            best, run["low"] = (row[2], states, s, len(trace) - 1), len(valid) - 1
        if (o.min_iters is None or iteration >= o.min_iters) and len(trace) - best[3] > 2 * o.win + o.spacing:
            break
        waited = len(trace) - (best[3] if o.wait_from == "minimum" else run["anchor"])
        if (o.min_iters is None or iteration >= o.min_iters) and waited > o.win and converged(valid, o):
            if not run["searches"]:
                break
            run["searches"] -= 1
            run["anchor"] = best[3]
            o = replace(o, rate=o.rate / 2, beta1=2 * o.beta1 - 1)
            run["valid"] = valid[: run["low"] + 1] + valid[-1:]  # those between are of an abandoned path
            if states is not best[1]:
                forget(spark, states)
            states, s = best[1], best[2]
    for table in (full, cells, other, None if best is None or states is best[1] else states):
        forget(spark, table)
    return Fit(best[1] if best else states, best[2] if best else s, run["trace"])


def burn_in(t: DataFrame, bins: DataFrame, start: State, o: Options, n_bins: int, n_train: int, keys: list[str] = KEYS) -> State:
    """Row and column parameters warmed up by one worker on at most `burn_in_bins` bins, for `burn_in_epochs` of their cells."""
    share = min(1.0, o.burn_in_bins / max(1, n_bins))
    scale = 1 << 30
    pick = lambda df: df.where(F.pmod(F.xxhash64(F.lit(o.seed), *keys), F.lit(scale)) < int(share * scale))
    updates = int(o.burn_in_epochs * n_train * min(n_bins, o.burn_in_bins))
    states, cells = bin_states(pick(bins), 1, keys), bin_cells(pick(t), 1, keys)
    out, s = step(states, cells, start, replace(o, batch=max(1, updates)), -1, 1, keys)
    for table in (states, cells, out):
        forget(t.sparkSession, table)
    return s


def train_bins(t: DataFrame, splits: dict[tuple[int, int], str], bins: DataFrame, s: State, o: Options, n_workers: int, per_eval: int = 50_000, win: int = 20, spacing: int = 5, shift: float = 1e-5, p_value: float = 0.01, least_gain: float = 0.01, keys: list[str] = KEYS, slice_bins: int | None = None) -> DataFrame:
    """(keys, factors, bias, evaluations): bins fitted to fixed rows and columns, each worker on its own and until its
    own validation error stops falling.

    After `batch` updates a worker takes its bins' errors every `per_eval` updates. With two windows of them it stops if
    the best gain is below `least_gain`, and at convergence (or when one and a half times the windows passed without a
    new minimum) it halves the rate from its best state, `searches` times, then stops. The best state counts. A worker
    without training or validation cells leaves its bins as they are; `max_iters` bounds the evaluations, if set. A worker is
    a bucket, or with `slice_bins` a slice of one, held alone."""
    known, kinds = _split_sums(s, splits), dict(t.dtypes)
    is_train = np.zeros((len(s.rows), len(s.cols)), bool)
    for (r, c), split in splits.items():
        is_train[r, c] = split == "train"
    need = 2 * win + spacing
    test = replace(o, win=win, spacing=spacing, shift=shift, p_value=p_value)

    def fit(x: pa.Table, rng: np.random.Generator) -> tuple[np.ndarray, int]:
        packed_cells, theta = x["cells"].combine_chunks(), _matrix(x["theta"])
        at, r, c, value = cell_arrays(packed_cells)
        own = is_train[r, c]
        cells, values, m, rate = np.c_[at, r, c][own], value[own], Moments(theta.shape), replace(o, rows=False, cols=False, bins=True)
        if not len(cells):
            return theta, 0
        error = lambda: float(known(theta, packed_cells)[1])
        scale = max(1, len(theta)) * max(1, sum(v == "valid" for v in splits.values()))
        found, left = [error() / scale], o.searches
        low, best = 0, (theta.copy(), m)
        sgd_partition(cells, values, theta, m, s, rate, rng)
        while o.max_iters is None or len(found) <= o.max_iters:
            sgd_partition(cells, values, theta, m, s, replace(rate, batch=per_eval), rng)
            found.append(error() / scale)
            if found[-1] < found[low]:
                low, best = len(found) - 1, (theta.copy(), deepcopy(m))
            if len(found) < need:
                continue
            if found[0] - found[low] < least_gain:
                break
            if converged(found, test) or len(found) - low > 1.5 * need:
                if not left:
                    break
                left -= 1
                rate = replace(rate, rate=rate.rate / 2, beta1=2 * rate.beta1 - 1)
                theta[:], m = best[0], deepcopy(best[1])
                found = found[: low + 1]
        return best[0], len(found)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, slice_bins or 1 << 40):
            first = zlib.crc32("|".join(str(x[k][0].as_py()) for k in keys).encode())
            theta, n = fit(x, np.random.default_rng([o.seed, first]))
            yield pa.RecordBatch.from_arrays([*(x[k].combine_chunks() for k in keys), _lists(theta[:, :-1]), pa.array(theta[:, -1]), pa.array([n] * len(x), pa.int32())], [*keys, "factors", "bias", "evaluations"])

    joined = together(bin_states(bins, n_workers, keys), bin_cells(t, n_workers, keys), keys)
    return joined.mapInArrow(each, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", factors array<double>, bias double, evaluations int")
