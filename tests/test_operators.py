import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunar.operators import folds, impute, intervals, metrics, model, stats, tensor
from lacunar.operators import train as tr
from lacunar.plans import pipelines
from lacunar.sources import readers, sinks


def cells(spark, rows):
    return spark.createDataFrame(rows, "contig string, start long, row_id int, col_id int, value double")


# --- intervals ---


def brute_overlaps(a, b):
    return sorted((x, y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


@pytest.mark.parametrize("width", [1, 7, 1 << 14])
def test_overlaps_brute_force(spark, width):
    rng = random.Random(width)
    make = lambda n: sorted({(rng.choice("xy"), s := rng.randrange(60), s + rng.randrange(1, 25)) for _ in range(n)})
    a, b = make(40), make(30)
    df = lambda rows: spark.createDataFrame(rows, "contig string, start long, end long")
    got = sorted(((r["contig"], r["start"], r["end"]), (r["b_contig"], r["b_start"], r["b_end"])) for r in intervals.overlaps(df(a), df(b), width).collect())
    assert got == brute_overlaps(a, b)


def test_touching_intervals_do_not_overlap(spark):
    df = lambda *r: spark.createDataFrame(list(r), "contig string, start long, end long")
    assert intervals.overlaps(df(("x", 0, 10)), df(("x", 10, 20))).count() == 0
    assert intervals.overlaps(df(("x", 5, 5)), df(("x", 0, 20))).count() == 0  # empty intervals meet nothing


def test_window_means_spanning_features_and_empty_windows(spark):
    w = intervals.windows(spark, "x", 0, 40, 10)
    f = spark.createDataFrame([("x", 5, 25, 2.0), ("x", 20, 30, 4.0)], "contig string, start long, end long, value double")
    assert [r["value"] for r in intervals.window_means(w, f).orderBy("start").collect()] == [2.0, 2.0, 3.0, 0.0]


def test_union_split_keeps_gaps_out(spark):
    t = spark.createDataFrame([("x", 0, 10, "a", 1.0), ("x", 5, 15, "b", 2.0), ("x", 20, 30, "a", 3.0)], "contig string, start long, end long, track string, value double")
    got = [tuple(r) for r in intervals.union_split(t, ["a", "b"]).orderBy("start").collect()]
    assert got == [("x", 0, 5, 1.0, 0.0), ("x", 5, 10, 1.0, 2.0), ("x", 10, 15, 0.0, 2.0), ("x", 20, 30, 3.0, 0.0)]


def test_contained_in_many_bounds(spark):
    rng = random.Random(5)
    make = lambda n, w: sorted({(rng.choice("xy"), s := rng.randrange(200), s + rng.randrange(0, w)) for _ in range(n)})
    a, b = make(150, 12), make(40, 40)
    df = lambda rows: spark.createDataFrame(rows, "contig string, start long, end long")
    want = [x for x in a if any(x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in b)]
    for width in (7, 1 << 14):
        assert sorted(map(tuple, intervals.contained(df(a), df(b), width).collect())) == want
    plan = intervals.contained(df(a), df(b))._jdf.queryExecution().optimizedPlan().toString()
    assert "floor" in plan.lower() and "Cartesian" not in plan


def test_union_split_brute_force(spark):
    rng = random.Random(6)
    rows = [(contig, at, at + rng.randrange(1, 9), track, float(rng.randrange(1, 9))) for contig in "xyz" for track in "ab" for at in rng.sample(range(0, 200, 10), 8)]
    got = sorted(map(tuple, intervals.union_split(spark.createDataFrame(rows, "contig string, start long, end long, track string, value double"), ["a", "b"]).collect()))
    want = []
    for contig in "xyz":
        edges = sorted({e for r in rows if r[0] == contig for e in r[1:3]})
        for lo, hi in zip(edges, edges[1:]):
            over = {t: v for c, s, e, t, v in rows if c == contig and s < hi and lo < e}
            if over:
                want.append((contig, lo, hi, over.get("a", 0.0), over.get("b", 0.0)))
    assert got == want


# --- tensor ---


def test_missing_values_and_negatives(spark):
    t = cells(spark, [("a", 0, 0, 0, float("nan")), ("a", 0, 0, 1, 0.0), ("a", 0, 1, 0, None), ("a", 0, 1, 1, 2.0), ("a", 1, 0, 0, -1.0)])
    assert {r["value"] for r in tensor.scrub(t).collect()} == {2.0, -1.0}
    assert [r["value"] for r in tensor.without_negatives(t).collect()] == [2.0]


def test_wrong_number_of_fields_raises(spark):
    lines = spark.createDataFrame([("a", 0, "1|2|3")], "contig string, start long, packed string")
    slots = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "slot int, row_id int, col_id int")
    with pytest.raises(Exception, match="wrong number of fields"):
        tensor.unpacked_text(lines, slots, 2).collect()


def test_zero_lines_vanish(spark):
    lines = spark.createDataFrame([("a", 0, "0|0"), ("a", 1, "0|3")], "contig string, start long, packed string")
    slots = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "slot int, row_id int, col_id int")
    got = tensor.unpacked_text(lines, slots, 2).collect()
    assert [(r["start"], round(np.sinh(r["value"]), 9)) for r in got] == [(1, 3.0)]


def test_ordinals_are_gapless_and_ordered(spark):
    df = spark.range(1000).select(F.lit("c").alias("contig"), F.pmod(F.col("id") * 7919, F.lit(1000)).alias("start")).repartition(7)
    got = sorted((r["start"], r["ordinal"]) for r in tensor.with_ordinal(df).collect())
    assert got == [(i, i) for i in range(1000)]


# --- model ---


def test_ridge_is_the_minimum_and_counts_missing_cells_as_mean(spark):
    rng = np.random.default_rng(1)
    axes = model.init_axes(4, 3, 2, 3, rng.normal(size=4), rng.normal(size=3))
    train = [(r, c) for r in range(4) for c in range(3) if (r + c) % 4]
    data = {(0, train[0]): 1.5, (0, train[2]): -0.5, (1, train[5]): 2.0}
    t = cells(spark, [("a", b, r, c, v) for (b, (r, c)), v in data.items()] + [("a", 2, 0, 0, 9.0)])  # bin 2 has no training cell
    got = {r["start"]: np.r_[r["factors"], r["bias"]] for r in model.solve_bins(t, axes, train, 0.7).collect()}

    def loss(b, x):
        total = 0.7 * (x[:2] ** 2).sum()
        for r, c in train:
            total += ((axes.rows[r] * axes.cols[c]) @ x[:2] + x[2] + axes.row_bias[r] + axes.col_bias[c] - data.get((b, (r, c)), 0.0)) ** 2
        return total

    assert set(got) == {0, 1, 2}
    for b, x in got.items():
        for k in range(3):
            for e in (1e-3, -1e-3):
                y = x.copy()
                y[k] += e
                assert loss(b, y) > loss(b, x)


def test_rank_one_agrees_with_general_solution(spark):
    axes = model.init_axes(3, 3, 1, 4, [0.1, 0.2, -0.3], [0.0, 0.5, -0.1])
    train = [(r, c) for r in range(3) for c in range(3) if r != c]
    t = cells(spark, [("a", b, r, c, float(b + r - c)) for b in range(3) for r, c in train if (b + r + c) % 3])
    plane = spark.createDataFrame([(r, c, float(axes.rows[r, 0] * axes.cols[c, 0]), float(axes.row_bias[r] + axes.col_bias[c])) for r, c in train], "row_id int, col_id int, z double, offset double")
    a = {r["start"]: (r["factors"][0], r["bias"]) for r in model.solve_bins(t, axes, train, 2.9).collect()}
    b = {r["start"]: (r["g"], r["gb"]) for r in model.solve_bins_rank1(t, plane, 2.9).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_high_ranks_by_matrix_product(spark):
    axes = model.init_axes(5, 4, 12, 3, np.arange(5.0), np.arange(4.0), 1.5)
    bins = model.init_bins(spark.createDataFrame([("a", b) for b in range(30)], "contig string, start long"), 12, 1)
    rows, cols = axes.frames(spark)
    some = spark.createDataFrame([(1, 2), (4, 0)], "row_id int, col_id int")
    key = lambda df: {(r["start"], r["row_id"], r["col_id"]): r["predicted"] for r in df.collect()}
    for want in (None, some):
        a, b = (key(model.predicted(bins, rows, cols, 1.5, want, unrolled=n)) for n in (0, 50))
        assert a.keys() == b.keys() and all(np.isclose(a[k], b[k]) for k in a) and len(a) == 30 * (20 if want is None else 2)
    known = {r["start"]: r for r in bins.collect()}
    by_hand = lambda b, r, c: sum(axes.rows[r] * axes.cols[c] * known[b]["factors"]) + r + c + 1.5 + known[b]["bias"]
    assert all(np.isclose(v, by_hand(*k)) for k, v in a.items())


def test_mse_counts_unobserved_cells(spark):
    t = cells(spark, [("a", 0, 0, 0, 1.0), ("a", 1, 0, 1, 3.0)])
    p = spark.createDataFrame([("a", b, 0, c, 0.0) for b in (0, 1) for c in (0, 1)], "contig string, start long, row_id int, col_id int, predicted double")
    s = spark.createDataFrame([(0, 0, "train"), (0, 1, "train")], "row_id int, col_id int, split string")
    assert stats.mse_by_split(t, p, s).first()["mse"] == 10 / 4


# --- folds ---


def test_nested_folds_partition_and_patch(spark):
    grid = [(r, c) for r in range(6) for c in range(4)]
    f = folds.nested_folds(spark, grid, 3, 4, 10, seed=1).collect()
    for t in range(3):
        for v in range(4):
            one = [r for r in f if (r["test_fold"], r["valid_fold"]) == (t, v)]
            assert sorted((r["row_id"], r["col_id"]) for r in one) == grid
            for axis in ("row_id", "col_id"):
                assert {r[axis] for r in one if r["split"] == "train"} == {r[axis] for r in one}
    with pytest.raises(ValueError, match="no training data"):
        folds.nested_folds(spark, [(0, 0), (1, 0), (1, 1)], fixed_test=[[(0, 0)]], n_valid=2, tries=1)


def test_best_split_is_no_worse_than_first():
    grid = [(r, c) for r in range(5) for c in range(5) if (r * c) % 3]

    def quality(fold_of):
        """Of each row and column the most cells in any one fold, summed."""
        total = 0
        for axis in (0, 1):
            for name in {c[axis] for c in grid}:
                total += max(sum(c[axis] == name and f == k for c, f in zip(grid, fold_of, strict=True)) for k in range(3))
        return total

    one = folds.best_split(grid, 3, 1, random.Random(2))
    many = folds.best_split(grid, 3, 50, random.Random(2))
    assert quality(many) < quality(one)
    assert folds._qualities(np.array(grid), np.array([one, many]), 3).tolist() == [quality(one), quality(many)]
    assert sorted(many.count(k) for k in range(3)) == sorted(one.count(k) for k in range(3))


# --- averages and metrics ---


def test_average_of_copies_is_the_model(spark):
    p = spark.createDataFrame([("a", 0, 0, 0, 1.25), ("a", 0, 0, 1, -2.0)], "contig string, start long, row_id int, col_id int, predicted double")
    assert sorted(map(tuple, impute.model_average([p, p, p]).collect())) == sorted(map(tuple, p.collect()))


def test_unknown_names_raise(spark):
    rows = spark.createDataFrame([("r", 0)], "row_name string, row_id int")
    cols = spark.createDataFrame([("c", 0)], "col_name string, col_id int")
    with pytest.raises(ValueError, match="no requested row_name"):
        impute.requested_cells(rows, cols, ["none"])


def test_metrics_of_ties_constants_and_single_class(spark):
    rows = [("x", "a", i, float(i % 2), 1.0, int(i < 3)) for i in range(10)] + [("y", "a", i, float(i), float(-i), 0) for i in range(10)]
    m = {r["exp"]: r for r in metrics.metrics(metrics.ranked(spark.createDataFrame(rows, "exp string, contig string, start long, o double, p double, flag int"))).collect()}
    assert m["x"]["gwcorrasinh"] is None or np.isnan(m["x"]["gwcorrasinh"])
    assert m["x"]["catchpeakobs"] == 0.5 and m["y"]["catchpeakobs"] is None


def test_ranks_by_range_equal_ranks_by_window(spark):
    """With ties, a constant experiment and one of a single bin; no task ever holds an experiment as a whole."""
    rng = random.Random(8)
    rows = [(e, "a", i, float(rng.randrange(5)), float(rng.randrange(40)), rng.random()) for e in "xyz" for i in range(120)] + [("w", "a", 0, 1.0, 2.0, 3.0)] + [("v", "a", i, 0.0, 0.0, 0.0) for i in range(30)]
    pairs = spark.createDataFrame(rows, "exp string, contig string, start long, o double, p double, alt double")
    names = ["n", "k1", "k5", "po", "pp", "pa", "ro", "rp"]
    key = lambda df: {(r["exp"], r["start"]): tuple(float(r[c]) for c in names) for r in df.collect()}
    big = metrics.ranked(pairs, window_rows=0)
    assert key(metrics.ranked(pairs)) == key(big)
    assert "Window" not in big._jdf.queryExecution().optimizedPlan().toString()


def test_correlations_come_with_p_values(spark):
    rng = random.Random(4)
    rows = [("x", "a", i, float(i), i + 9 * rng.random()) for i in range(12)] + [("y", "a", i, 1.0, float(i)) for i in range(12)]
    table = metrics.metrics(metrics.ranked(spark.createDataFrame(rows, "exp string, contig string, start long, o double, p double")))
    got = {r["exp"]: r for r in metrics.with_p_values(table).collect()}
    for name in metrics.CORRELATIONS:
        assert np.isclose(got["x"][f"{name}_p"], metrics.correlation_p_value(got["x"][name], 12)) and got["y"][f"{name}_p"] is None


def test_auc_of_reversed_scores(spark):
    rng = random.Random(3)
    rows = [("x", "a", i, rng.choice([0.0, 1.0, 2.0]), rng.random(), rng.randrange(2)) for i in range(50)]
    auc = lambda sign: metrics.metrics(metrics.ranked(spark.createDataFrame([(*r[:4], 1 + sign * r[4], r[5]) for r in rows], "exp string, contig string, start long, o double, p double, flag int"))).first()["catchpeakobs"]
    assert abs(auc(1) + auc(-1) - 1) < 1e-12


def test_correlation_p_value():
    assert abs(metrics.correlation_p_value(0.5, 12) - 0.09785) < 1e-4
    assert metrics.correlation_p_value(0.0, 12) == 1.0 and metrics.correlation_p_value(None, 12) is None


# --- training ---


def test_nadam_first_update_by_hand():
    o = tr.Options(rate=0.1)
    theta, m, v, prod = tr.nadam(np.array([1.0]), np.array([2.0]), np.zeros(1), np.zeros(1), 1, 1.0, o)
    b1, b2 = 0.9, 0.9 * (1 - 1e-6)
    look = 0.1 * 2 / (1 - b1) + b2 * 0.2 / (1 - b1 * b2)
    assert np.isclose(theta[0], 1 - 0.1 * look / (2 + 1e-8)) and np.isclose(m[0], 0.2) and np.isclose(v[0], 0.004) and prod == b1


def test_nonneg_projects():
    theta, *_ = tr.nadam(np.array([0.001]), np.array([5.0]), np.zeros(1), np.zeros(1), 1, 1.0, tr.Options(rate=0.1, nonneg=True))
    assert theta[0] == 0


def test_rank_sum_by_hand():
    z, p = tr.rank_sum([1, 2, 3], [4, 5, 6])
    assert np.isclose(z, (6 - 10.5) / np.sqrt(9 * 7 / 12)) and np.isclose(p, 0.04953, atol=1e-4)


def test_convergence():
    o = tr.Options(win=5, spacing=2)
    assert not tr.converged([1 / (1 + i) for i in range(30)], o)
    assert tr.converged([0.5] * 30, o) and not tr.converged([0.5] * 11, o)


def test_training_recovers_structure(spark):
    rng = np.random.default_rng(0)
    rows, cols, bins = rng.normal(size=(8, 2)), rng.normal(size=(6, 2)), rng.normal(size=(60, 2))
    x = 5 + np.einsum("rk,ck,bk->brc", rows, cols, bins)
    data = [("a", b, r, c, float(x[b, r, c])) for b in range(60) for r in range(8) for c in range(6) if rng.random() < 0.9]
    splits = spark.createDataFrame([(r, c, "train" if (r * 5 + c * 3) % 10 < 8 else "valid") for r in range(8) for c in range(6)], "row_id int, col_id int, split string")
    # rank 4, as steps of rank 2 often end in a local minimum
    o = tr.Options(rank=4, batch=6000, max_iters=8, per_mse=2, burn_in_epochs=0.0, rc=1e-4, ra=1e-4, ri=1e-4, ri2=1e-3, rate=0.02, seed=1)
    axes, solved, fit = pipelines.train_model(cells(spark, data), splits, o, n_workers=2)
    assert solved.count() == 60
    assert min(r[3] for r in fit.trace) < 0.1 * x.var()


# --- sources and sinks ---


def test_model_round_trip(spark, tmp_path):
    axes = model.init_axes(3, 2, 2, 1, mean=1.5)
    bins = model.init_bins(spark.createDataFrame([("a", 0), ("a", 1)], "contig string, start long"), 2, 1)
    sinks.save_model(axes, bins, {"rate": 0.1}, f"{tmp_path}/p")
    sinks.save_model(axes, bins, {"ri2": 2.0}, f"{tmp_path}/m", (f"{tmp_path}/p",))
    got = sinks.load_model(spark, f"{tmp_path}/m", True)
    assert np.allclose(got["axes"].rows, axes.rows) and got["axes"].mean == 1.5
    assert got["settings"] == {**sinks.OLD_SETTINGS, "rate": 0.1, "ri2": 2.0} and got["bins"].count() == 2
    old = {"rc": 2.88e-4, "ra": 5.145e-11, "ri": 9.358e-14, "rbc": 0.0, "rba": 0.0, "rbi": 0.0, "rate": 0.005}
    assert sinks.load_model(spark, f"{tmp_path}/m")["settings"] == {**old, "ri2": 2.0}


def test_tracks_and_readers(spark, tmp_path):
    (tmp_path / "t.bdg").write_text("x\t0\t10\t2.5\nx\t10\t20\t.\n")
    assert [r["value"] for r in readers.track(spark, f"{tmp_path}/t.bdg").orderBy("start").collect()] == [2.5, 0.0]
    (tmp_path / "map.txt").write_text(f"{tmp_path}/t.bdg liver DNase\n")
    t = readers.assemble(spark, readers.file_map(spark, f"{tmp_path}/map.txt"), intervals.windows(spark, "x", 0, 20, 10))
    assert [(r["start"], round(np.sinh(r["value"]), 9)) for r in t.collect()] == [(0, 2.5)]
    (tmp_path / "lines.txt").write_text("x 0 10 1|2\nx 10 20 3|4\n")
    region = spark.createDataFrame([("x", 12, 13)], "contig string, start long, end long")
    assert [r["packed"] for r in readers.packed_lines(spark, f"{tmp_path}/lines.txt", region).collect()] == ["3|4"]


def test_track_reader_keeps_every_contig(spark, tmp_path):
    (tmp_path / "t.bdg").write_text("track type=bedGraph name=x\nbrowser position tig1:1-9\n#c\n\ntig1\t0\t10\t2.5\ntrack2\t0\t5\t1\nbrowser9\t1\t2\tNaN\n")
    got = sorted((r["contig"], r["start"], r["end"], r["value"]) for r in readers.track(spark, f"{tmp_path}/t.bdg").collect())
    assert got == [("browser9", 1, 2, 0.0), ("tig1", 0, 10, 2.5), ("track2", 0, 5, 1.0)]


def test_all_tracks_are_one_scan(spark, tmp_path):
    rng, w, want = random.Random(3), intervals.windows(spark, "x", 0, 100, 10), {}
    lines = []
    for k in range(6):
        rows = [(s := rng.randrange(95), s + rng.randrange(1, 12), rng.randrange(1, 9)) for _ in range(8)]
        (tmp_path / f"t {k}+.bdg").write_text("track x\n" + "".join(f"x\t{a}\t{b}\t{v}\n" for a, b, v in rows))
        lines.append((f"{tmp_path}/t {k}+.bdg", f"r{k % 3}", f"c{k // 3}"))
        for at in range(0, 100, 10):
            if met := [v for a, b, v in rows if a < at + 10 and at < b]:
                want[at, k % 3, k // 3] = sum(met) / len(met)
    files = spark.createDataFrame(lines, "url string, row_name string, col_name string")
    t = readers.assemble(spark, files, w)
    assert {(r["start"], r["row_id"], r["col_id"]): round(float(np.sinh(r["value"])), 9) for r in t.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert t._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1
    assert readers.assemble(spark, files.limit(0), w).count() == 0


def test_formats_by_name(spark, tmp_path):
    t = cells(spark, [("a", 0, 0, 0, 1.0), ("a", 10, 0, 1, 2.0), ("a", 10, 0, 0, 0.0)])
    t.write.parquet(f"{tmp_path}/p")
    t.write.csv(f"{tmp_path}/c", header=True)
    (tmp_path / "lines").write_text("a 0 10 1|0\na 10 20 0|2\n")
    slots = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "slot int, row_id int, col_id int")
    rows = lambda df: sorted((r["contig"], r["start"], r["row_id"], r["col_id"], round(r["value"], 9)) for r in df.collect())
    want = [("a", 0, 0, 0, 1.0), ("a", 10, 0, 1, 2.0)]
    assert rows(readers.load(spark, f"{tmp_path}/p")) == rows(readers.load(spark, f"{tmp_path}/c", "csv")) == want
    packed = readers.load(spark, f"{tmp_path}/lines", "packed", slots)
    assert rows(tensor.with_sinh(packed)) == want
    with pytest.raises(ValueError, match="unknown format"):
        readers.load(spark, f"{tmp_path}/p", "pickle")
    assert rows(readers.load_tensor(spark, f"{tmp_path}/p", fraction=1.0)) == want
    assert [round(r["value"], 9) for r in readers.load_tensor(spark, f"{tmp_path}/p", undo_asinh=True).orderBy("start").collect()] == [round(float(np.sinh(v)), 9) for v in (1, 2)]


def test_parts_and_their_positions(spark, tmp_path):
    lines = spark.createDataFrame([(f"line {k:03d}",) for k in random.Random(1).sample(range(25), 25)], "line string")
    sinks.write_parts(lines, f"{tmp_path}/parts", 10)
    got = {d.name: sum(spark.read.text(str(f)).count() for f in d.glob("*.gz")) for d in (tmp_path / "parts").glob("part=*")}
    assert got == {"part=0": 10, "part=1": 10, "part=2": 5}
    for side in "ab":
        (tmp_path / side).mkdir()
        for k in range(2):
            (tmp_path / side / f"part-{k}.txt").write_text("".join(f"{side}{k}{i}\n" for i in range(3)))
    a, b = (readers.numbered_parts(spark, f"{tmp_path}/{x}") for x in "ab")
    both = sorted((r["left"], r["right"]) for r in readers.zipped(a, b).collect())
    assert both == [(f"a{k}{i}", f"b{k}{i}") for k in range(2) for i in range(3)]
    with pytest.raises(ValueError, match="differ"):
        readers.zipped(a, b.where("part = 0"))


def test_small_sinks_and_readers(spark, tmp_path):
    from lacunar.functions import scalar

    ex, slots = spark.createDataFrame([("e", 0, 0)], "exp string, row_id int, col_id int"), spark.createDataFrame([(0, 0, 0)], "slot int, row_id int, col_id int")
    sinks.publish_catalogue(ex, slots, f"{tmp_path}/cat")
    assert spark.read.parquet(f"{tmp_path}/cat/catalogue").count() == spark.read.parquet(f"{tmp_path}/cat/slots").count() == 1
    sinks.write_trace(spark, [(2, 1.0, 2.0, 3.0, 4.0), (1, 5.0, 6.0, 7.0, 8.0)], f"{tmp_path}/trace")
    assert [r["iter"] for r in spark.read.csv(f"{tmp_path}/trace", sep="\t", header=True, inferSchema=True).collect()] == [1, 2]
    for _ in range(2):
        sinks.append_metrics(ex, f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", sep="\t", header=True).count() == 2
    sinks.record_run(spark, f"{tmp_path}/run", {"rate": 1})
    with pytest.raises(Exception, match="already exists"):
        sinks.record_run(spark, f"{tmp_path}/run", {"rate": 2})
    sinks.record_run(spark, f"{tmp_path}/run", {"rate": 2}, restart=True)
    assert spark.read.json(f"{tmp_path}/run").first()["command"] == '{"rate": 2}'
    (tmp_path / "n.narrowPeak").write_text("x\t5\t9\tp\t0\t.\t3.5\n")
    assert tuple(readers.peaks(spark, f"{tmp_path}/n.narrowPeak").first()) == ("x", 5, 9, 3.5)
    row = spark.range(1).select(scalar.strip_gz(F.lit("a.gz.gz")).alias("s"), scalar.url_parts(F.lit("s3://b/k/x.gz")).alias("u"), scalar.part_number(F.lit("/a/part-0012.gz")).alias("p")).first()
    assert row["s"] == "a.gz" and tuple(row["u"]) == ("s3", "b", "k/x.gz") and row["p"] == 12
    line = spark.range(1).select(scalar.track_line(F.lit("f"), F.lit("1,2,3"), F.lit("https://h.org/a b/f")).alias("l")).first()["l"]
    assert line.endswith("bigDataUrl=https://h.org/a%20b/f")
    found = pipelines.random_candidates({"ri": (1.0, 2.0)}, 5, 1)
    assert len(found) == 5 and all(1 <= c["ri"] <= 2 for c in found) and found == pipelines.random_candidates({"ri": (1.0, 2.0)}, 5, 1)
    f = folds.nested_folds(spark, [(r, c) for r in range(4) for c in range(3)], 2, 2, 5, seed=1, take_test=True)
    assert folds.load_split(f, 1, 0).count() == 12 and {r["split"] for r in folds.load_split(f, 1, 0, True).collect()} == {"train"}
    t = cells(spark, [("a", b, 0, 0, 1.0) for b in range(20)])
    assert tensor.partitioned(t, 3).rdd.getNumPartitions() == 3
    assert sorted(r["start"] for r in tensor.in_bins(t, t.where("start < 3").union(t.where("start = 1"))).collect()) == [0, 1, 2]


def test_export_is_one_call(spark, tmp_path):
    p = spark.createDataFrame([(x, b, 0, c, float(b + c)) for x in "uvw" for b in range(0, 100, 10) for c in (0, 1)], "contig string, start long, row_id int, col_id int, predicted double")
    names = spark.createDataFrame([(0, 0, "liver", "DNase"), (0, 1, "liver", "H3K9ac")], "row_id int, col_id int, row_name string, col_name string")
    bounds = spark.createDataFrame([(x, 0, 95) for x in "uvw"], "contig string, start long, end long")
    for k in (1, 4):
        sinks.export(p, names, bounds, 10, f"{tmp_path}/e{k}", "http://t.org", batches=k)
        assert spark.read.text(f"{tmp_path}/e{k}/lines").count() == 2
        rows = spark.read.csv(f"{tmp_path}/e{k}/tracks", sep="\t", schema="contig string, start long, end long, value double, row_name string, col_name string")
        got = sorted((r["contig"], r["start"], r["col_name"], round(r["value"], 6)) for r in rows.collect())
        assert got == sorted((x, b, n, round(float(f"{np.sinh(b + c):.8e}"), 6)) for x in "uvw" for b in range(0, 90, 10) for c, n in ((0, "DNase"), (1, "H3K9ac")))
    with pytest.raises(Exception, match="already exists"):
        sinks.export(p, names, bounds, 10, f"{tmp_path}/e1", "http://t.org")


def test_watermarked_means(spark, tmp_path):
    from lacunar.streaming.impute import windowed_means

    spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 3.0), ("2024-01-01 00:01:10", "b", 5.0)], "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, kind string, value double").parquet(f"{tmp_path}/in")
    q = windowed_means(stream, "ts", "value", ["kind"], "1 minute", "5 minutes").writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["kind"], r["value"]) for r in spark.table("means").collect()) == [("a", 2.0), ("b", 5.0)]


def test_track_writer_refuses_to_overwrite(spark, tmp_path):
    p = spark.createDataFrame([("x", 0, 0, 0, 1.0), ("x", 10, 0, 0, -1.0), ("x", 95, 0, 0, 1.0)], "contig string, start long, row_id int, col_id int, predicted double")
    names = spark.createDataFrame([(0, 0, "liver", "DNase")], "row_id int, col_id int, row_name string, col_name string")
    bounds = spark.createDataFrame([("x", 0, 100)], "contig string, start long, end long")
    sinks.write_tracks(sinks.track_rows(p, 10), names, bounds, f"{tmp_path}/out")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/out/row_name=liver/col_name=DNase").collect()]
    assert lines == [f"x\t0\t10\t{np.sinh(1):.8e}", f"x\t10\t20\t{0:.8e}"]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_tracks(sinks.track_rows(p, 10), names, bounds, f"{tmp_path}/out")


def test_stream_imputes_arriving_bins(spark, tmp_path):
    from lacunar.streaming.impute import impute_stream

    axes = model.init_axes(2, 2, 1, 1)
    t = cells(spark, [("a", b, r, c, 1.0 + b) for b in range(3) for r in range(2) for c in range(2)])
    t.write.parquet(f"{tmp_path}/in")
    q = impute_stream(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in"), axes, [(r, c) for r in range(2) for c in range(2)], 1.0, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12


def test_bins_in_pieces_come_out_whole(spark, tmp_path):
    """Split bins wait for their last piece, late cells are dropped, an open bin stays in the state."""
    import time

    from lacunar.streaming import gather
    from lacunar.streaming.impute import impute_stream

    kind = "contig string, start long, row_id int, col_id int, value double, ts timestamp"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1) + __import__("datetime").timedelta(seconds=s)
    files = [
        [("a", 0, 0, 0, 1.0, at(0)), ("a", 1, 0, 0, 2.0, at(1)), (None, 1, 0, 0, 2.0, at(1)), ("a", 1, 0, 0, 2.0, None)],
        [("a", 0, 1, 1, 3.0, at(8)), ("a", 1, 1, 0, 4.0, at(2))],
        [("a", 0, 0, 1, 5.0, at(15)), ("b", 7, 0, 0, 6.0, at(60))],
        [("b", 8, 0, 0, 8.0, at(200))],
        [("a", 9, 0, 0, 7.0, at(5)), ("b", 8, 0, 1, 8.0, at(201))],  # the first is late by now
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    old = {k: spark.conf.get(k, None) for k in gather.STORE}
    for k, v in gather.STORE.items():
        spark.conf.set(k, v)
    try:
        arriving = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        seen = []
        whole = gather.whole_bins(arriving, "ts", "10 seconds", "5 seconds")
        q = whole.writeStream.foreachBatch(lambda df, n: seen.append(sorted(map(tuple, df.collect())))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        out = [x for x in seen if x]
        assert sorted(r for x in out for r in x) == [("a", 0, 0, 0, 1.0), ("a", 0, 0, 1, 5.0), ("a", 0, 1, 1, 3.0), ("a", 1, 0, 0, 2.0), ("a", 1, 1, 0, 4.0), ("b", 7, 0, 0, 6.0)]
        for key in {r[:2] for x in out for r in x}:  # each bin in one batch
            assert sum(any(r[:2] == key for r in x) for x in out) == 1
        axes = model.init_axes(2, 2, 1, 1)
        q = impute_stream(gather.whole_bins(arriving, "ts", "10 seconds", "5 seconds"), axes, [(r, c) for r in range(2) for c in range(2)], 1.0, f"{tmp_path}/out", f"{tmp_path}/ck2")
        assert q.awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/out").count() == 3 * 4
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_run(spark):
    rng = np.random.default_rng(3)
    data = cells(spark, [("a", b, r, c, float(rng.normal())) for b in range(12) for r in range(4) for c in range(3)])
    splits = {(r, c): "valid" if (r + c) % 5 == 4 else "train" for r in range(4) for c in range(3)}
    bins = model.init_bins(data.select("contig", "start").distinct(), 2, 1)
    return data, splits, bins, tr.State.of(model.init_axes(4, 3, 2, 1))


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    data, splits, bins, start = small_run(spark)
    o = tr.Options(rank=2, batch=50, per_mse=1, max_iters=4)
    whole = tr.train(data, splits, bins, start, o, 2, checkpoint=f"{tmp_path}/c", every=2)
    again = tr.train(data, splits, bins, start, o, 2, checkpoint=f"{tmp_path}/c", every=100, restart=True)
    assert np.allclose(whole.trace, again.trace)
    assert np.allclose(whole.state.flat(), again.state.flat())


def hand_step(cells, bins, rows, cols, o, draws):
    """The updates one by one, entity by entity, from the formulas."""
    state = {}

    def move(key, theta, grad):
        m, v, t, prod = state.get(key, (np.zeros_like(theta), np.zeros_like(theta), 0, 1.0))
        t += 1
        b, after, rate = o.beta1 * (1 - 1e-6) ** (t - 1), o.beta1 * (1 - 1e-6) ** t, o.rate * (1 - 1e-6) ** (t - 1)
        prod *= b
        m, v = b * m + (1 - b) * grad, o.beta2 * v + (1 - o.beta2) * grad**2
        bar = (1 - b) * grad / (1 - prod) + after * m / (1 - prod * after)
        state[key] = (m, v, t, prod)
        out = theta - rate * bar / (np.sqrt(v / (1 - o.beta2**t)) + o.epsilon)
        return np.maximum(out, 0) if o.nonneg else out

    for k in draws:
        i, r, c, value = cells[k]
        x, y, g = rows[r].copy(), cols[c].copy(), bins[i].copy()
        err = sum(x[f] * y[f] * g[f] for f in range(o.rank)) + x[-1] + y[-1] + g[-1] - value
        if o.rows:
            rows[r] = move(("r", r), x, np.array([*(err * y[:-1] * g[:-1] + o.rc * x[:-1]), err + o.rbc * x[-1]]))
        if o.cols:
            cols[c] = move(("c", c), y, np.array([*(err * x[:-1] * g[:-1] + o.ra * y[:-1]), err + o.rba * y[-1]]))
        if o.bins:
            bins[i] = move(("b", i), g, np.array([*(err * x[:-1] * y[:-1] + o.ri * g[:-1]), err + o.rbi * g[-1]]))


@pytest.mark.parametrize("flags", [{}, {"cols": False, "bins": False}, {"cols": False}, {"rows": False, "cols": False}, {"nonneg": True}])
def test_steps_by_hand(spark, flags):
    """Two iterations of one worker: all axes, rows only, rows and bins, bins only, non-negative."""
    import zlib

    data, splits, bins, start = small_run(spark)
    o = tr.Options(rank=2, batch=60, per_mse=1, max_iters=2, rate=0.05, rc=0.02, ra=0.03, ri=0.01, rbc=0.1, rba=0.2, rbi=0.3, **flags)
    fit = tr.train(data, splits, bins, start, replace(o, per_mse=5), 1)
    mine = sorted((r["start"], r["row_id"], r["col_id"], r["value"]) for r in data.collect() if splits[r["row_id"], r["col_id"]] == "train")
    theta = {r["start"]: np.array([*r["factors"], r["bias"]]) for r in bins.collect()}
    rows, cols = start.rows.copy(), start.cols.copy()
    # moments go on from one iteration to the next, so both are one run with two draws
    moving = [axis for axis, on in ((1, o.rows), (2, o.cols), (0, o.bins)) if on]
    draws = []
    for i in range(2):
        drawn = np.random.default_rng([o.seed, i + 1, zlib.crc32(b"a|0")]).integers(0, len(mine), o.batch)
        draws += [drawn[k] for batch in tr.conflict_free(np.array([[int(mine[d][a]) for a in moving] for d in drawn])) for k in batch]
    hand_step(mine, theta, rows, cols, o, draws)
    assert np.allclose(fit.state.rows, rows) and np.allclose(fit.state.cols, cols)
    got = {r["start"]: np.array([*r["factors"], r["bias"]]) for r in tr.factors_of(fit.states).collect()}
    assert got.keys() == theta.keys() and all(np.allclose(got[b], theta[b]) for b in got)


def test_batches_have_no_conflict():
    rng = np.random.default_rng(1)
    draws = np.c_[rng.integers(0, 12, 500), rng.integers(0, 5, 500), rng.integers(0, 90, 500)]
    batches = tr.conflict_free(draws)
    assert sorted(np.concatenate(batches).tolist()) == list(range(500)) and all((np.diff(b) > 0).all() for b in batches)
    assert all(len(set(draws[b, a])) == len(b) for b in batches for a in range(3))
    # a draw couldn't have gone to an earlier batch
    for at, b in enumerate(batches):
        for k in b:
            assert all(any((draws[x] == draws[k]).any() for x in e if x < k) for e in batches[:at])
    assert len(batches) < 1.3 * np.bincount(draws[:, 1]).max() and tr.conflict_free(draws[:0]) == []


def plain_or_batch(tr, cells_, values, bins, m, s, o, rng):
    """One update by one, without the copies that a call of the kernel makes, or the kernel."""
    if o.batch > 1:
        return tr.sgd_partition(cells_, values, bins, m, s, o, rng)
    k = rng.integers(0, len(cells_))
    i, r, c = cells_[k]
    x, y, g = s.rows[r], s.cols[c], bins[i]
    err = (x[:-1] * y[:-1]) @ g[:-1] + x[-1] + y[-1] + g[-1] - values[k]
    grads = [np.r_[err * y[:-1] * g[:-1] + o.rc * x[:-1], err], np.r_[err * x[:-1] * g[:-1] + o.ra * y[:-1], err], np.r_[err * x[:-1] * y[:-1] + o.ri * g[:-1], err]]
    for table, own, at, grad in zip((s.rows, s.cols, bins), (s.row_m, s.col_m, m), (r, c, i), grads, strict=True):
        own.t[at] += 1
        table[at], own.m[at], own.v[at], own.prod[at] = tr.nadam(table[at], grad, own.m[at], own.v[at], int(own.t[at]), float(own.prod[at]), o)


def test_kernel_is_fast_at_the_default_rank():
    """5,000 updates of rank 100 on a plane of the usual size: a batch at a time, some nine times as fast as one by one (five
    are asked for here, as machines are shared)."""
    import time

    rng = np.random.default_rng(2)
    o = tr.Options(batch=5000)
    state = tr.State.of(model.init_axes(127, 24, 100, 1))
    cells_ = np.c_[rng.integers(0, 1000, 200_000), rng.integers(0, 127, 200_000), rng.integers(0, 24, 200_000)]
    bins, values = rng.uniform(-0.3, 0.3, (1000, 101)), rng.normal(size=200_000)
    took = []
    for size, times in ((5000, 2), (1, 400)):
        own, b = tr.State(state.rows.copy(), state.cols.copy()), bins.copy()
        m, began = tr.Moments(b.shape), time.process_time()
        for _ in range(times):
            plain_or_batch(tr, cells_, values, b, m, own, replace(o, batch=size), rng)
        took.append((time.process_time() - began) / times / size)
    assert took[0] * 5 < took[1], took


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_slices_hold_what_they_say(size):
    import pyarrow as pa

    rows = 41
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, min(rows, a + 6)))}) for a in range(0, rows, 6)]
    got = list(tr.slices(iter(batches), size))
    assert [v for t in got for v in t["x"].to_pylist()] == list(range(rows))
    assert all(t.num_rows == size for t in got[:-1]) and (got[-1].num_rows <= 1.5 * size + 0.5) and (len(got) == 1 or got[-1].num_rows >= size // 2)


def test_slices_of_a_bucket_are_workers_of_their_own(spark):
    """Two buckets in slices: the parameters are the plain average over slices, each trained from the same start."""
    import zlib

    data, splits, bins, start = small_run(spark)
    o = tr.Options(rank=2, batch=40, rate=0.05)
    states, packed = tr.bin_states(bins, 2), tr.bin_cells(data, 2)
    out, s = tr.step(states, packed, start, o, 0, 2, slice_bins=2)
    where = {r["start"]: r["b"] for r in tr.together(states, packed).select("start", F.spark_partition_id().alias("b")).collect()}
    theta = {r["start"]: np.array([*r["factors"], r["bias"]]) for r in bins.collect()}
    rows, cols, n = 0.0, 0.0, 0
    for b in set(where.values()):
        own = sorted(k for k in where if where[k] == b)
        while own:
            part, own = (own[:2], own[2:]) if len(own) >= 3 else (own, [])
            mine = sorted((r["start"], r["row_id"], r["col_id"], r["value"]) for r in data.collect() if r["start"] in part)
            drawn = np.random.default_rng([o.seed, 1, zlib.crc32(f"a|{part[0]}".encode())]).integers(0, len(mine), o.batch)
            order = [drawn[k] for batch in tr.conflict_free(np.array([[mine[d][1], mine[d][2], mine[d][0]] for d in drawn])) for k in batch]
            x, y = start.rows.copy(), start.cols.copy()
            hand_step(mine, theta, x, y, o, order)
            rows, cols, n = rows + x, cols + y, n + 1
    assert n > 2 and np.allclose(s.rows, rows / n) and np.allclose(s.cols, cols / n)
    got = {r["start"]: np.array([*r["factors"], r["bias"]]) for r in tr.factors_of(out).collect()}
    assert all(np.allclose(got[b], theta[b]) for b in theta)


def test_layout_follows_the_bins():
    assert tr.laid_out(50, 1000) == (20, 3) and tr.laid_out(30_000, 1000) == (30, 1000)
    assert tr.laid_out(100 * 30_000, 1000) == (3000, 1000)  # a hundred times the bins: as many a slice, more slices
    buckets, size = tr.laid_out(10**9, 1000)
    assert buckets == 4096 and size == 1000 and tr.laid_out(0, 1000)[1] == 1


def test_vectors_add_up_as_a_tree(spark):
    rows = spark.range(0, 1000, 1, 37).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    assert tr.vector_sum(rows, "v", fan=3).tolist() == [499500.0, 1000.0]
    assert tr.vector_sum(rows.where("id < 0"), "v") is None
    plan = rows.select("v")._jdf.queryExecution().toString()
    assert "Generate" not in plan


def hand_errors(data, splits, theta, s, bins=None):
    sse, n = {"train": 0.0, "valid": 0.0, "test": 0.0}, len(theta)
    for r in data:
        if r["start"] in theta and (r["row_id"], r["col_id"]) in splits:
            g, x, y = theta[r["start"]], s.rows[r["row_id"]], s.cols[r["col_id"]]
            sse[splits[r["row_id"], r["col_id"]]] += ((x[:-1] * y[:-1]) @ g[:-1] + x[-1] + y[-1] + g[-1] - r["value"]) ** 2
    return {k: v / max(1, sum(x == k for x in splits.values())) / n for k, v in sse.items()}, sse


def test_errors_by_hand(spark):
    data, splits, bins, start = small_run(spark)
    o = tr.Options(rank=2, rc=0.5, ra=0.25, ri=0.125, rbc=0.1, rba=0.2, rbi=0.3, ri2=0.7)
    states, full = tr.bin_states(bins, 3), tr.bin_cells(data, 3)
    theta = {r["start"]: np.array([*r["factors"], r["bias"]]) for r in bins.collect()}
    rows = data.collect()
    mse, sse = hand_errors(rows, splits, theta, start)
    got = tr.errors(states, start, splits, full, o)
    penalty = 0.5 * (start.rows[:, :-1] ** 2).sum() + 0.1 * (start.rows[:, -1] ** 2).sum() + 0.25 * (start.cols[:, :-1] ** 2).sum() + 0.2 * (start.cols[:, -1] ** 2).sum()
    penalty += sum(0.125 * (g[:-1] ** 2).sum() + 0.3 * g[-1] ** 2 for g in theta.values())
    assert np.allclose(got, (sse["train"] + penalty, mse["train"], mse["valid"], mse["test"]))
    # validation on other bins: these are solved in closed form first
    other = data.where("start >= 6")
    train = sorted(k for k, v in splits.items() if v == "train")
    solved = {r["start"]: np.array([*r["factors"], r["bias"]]) for r in model.solve_bins(other, start.axes(0.0), train, 0.7).collect()}
    there = hand_errors(rows, splits, solved, start)[0]
    got = tr.errors(states, start, splits, full, o, valid=tr.bin_cells(other, 3))
    assert np.allclose(got[1:], (mse["train"], there["valid"], there["test"]))


def test_a_step_shuffles_nothing(spark):
    data, splits, bins, start = small_run(spark)
    plan = tr.together(tr.bin_states(bins, 3), tr.bin_cells(data, 3))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2


def test_halving_goes_back_to_the_best_state(spark, monkeypatch):
    """Errors that fall, then rise: the rate is halved from the best state, and with no halving left the run ends."""
    data, splits, bins, start = small_run(spark)
    seen, fake = [], [5.0, 4.0, 3.0, *(3.5 + k / 100 for k in range(60))]

    def errors(states, s, *_):
        seen.append(s)
        return (1.0, 1.0, fake[len(seen) - 1], 1.0)

    rates = []
    real = tr.step
    monkeypatch.setattr(tr, "errors", errors)
    monkeypatch.setattr(tr, "step", lambda *a: (rates.append((a[3].rate, a[3].beta1)), real(*a))[1])
    o = tr.Options(rank=2, batch=5, per_mse=1, win=4, spacing=1, searches=1, rate=0.01, max_iters=40)
    fit = tr.train(data, splits, bins, start, o, 1)
    assert np.allclose(fit.state.flat(), seen[2].flat())
    assert rates[0] == (0.01, 0.9) and rates[-1][0] == 0.005 and np.isclose(rates[-1][1], 0.8)
    assert len(fit.trace) == 3 + 2 * o.win + o.spacing  # patience: that many evaluations after the minimum
    fake[:] = [5.0] * 60
    seen.clear()
    assert len(tr.train(data, splits, bins, start, replace(o, bail_at=6, max_iters=20), 1).trace) == 5  # it did not move


def test_burn_in_moves_rows_and_columns(spark):
    data, splits, bins, start = small_run(spark)
    o = tr.Options(rank=2, burn_in_epochs=0.5, burn_in_bins=6, rate=0.05)
    s = tr.burn_in(data, bins, start, o, 12, 9)
    assert not np.allclose(s.rows, start.rows) and not np.allclose(s.cols, start.cols) and s.rows.shape == start.rows.shape
    plane = spark.createDataFrame([(r, c, x) for (r, c), x in splits.items()], "row_id int, col_id int, split string")
    axes, solved, fit = pipelines.train_model(data, plane, tr.Options(rank=2, batch=50, per_mse=1, max_iters=2), n_workers=2, fraction=0.5, valid_on_other_bins=True)
    assert solved.count() == 12 and len(fit.trace) == 2 and fit.states.where("kind = 'state'").count() < 12


def test_bins_alone_stop_by_themselves(spark):
    rng = np.random.default_rng(1)
    axes = model.init_axes(6, 5, 2, 2, spread=1.0)
    theta = rng.normal(size=(20, 3))
    x = np.einsum("rk,ck,bk->brc", axes.rows, axes.cols, theta[:, :2]) + theta[:, 2, None, None]
    t = cells(spark, [("a", b, r, c, float(x[b, r, c])) for b in range(20) for r in range(6) for c in range(5)])
    splits = {(r, c): "valid" if (r + c) % 4 == 3 else "train" for r in range(6) for c in range(5)}
    bins = model.init_bins(t.select("contig", "start").distinct(), 2, 1)
    o = tr.Options(rank=2, batch=100, ri=1e-6, rate=0.05, searches=1)
    got = tr.train_bins(t, splits, bins, tr.State.of(axes), o, 2, per_eval=400, win=4, spacing=1).collect()
    mse = lambda rows: np.mean([(axes.rows @ np.diag(r["factors"]) @ axes.cols.T + r["bias"] - x[r["start"]]) ** 2 for r in rows])
    assert len(got) == 20 and mse(got) < 0.05 * mse(bins.collect())
    assert all(9 <= r["evaluations"] < 200 for r in got)
    idle = tr.train_bins(t, splits, bins, tr.State.of(axes), replace(o, rate=0.0), 1, per_eval=50, win=4, spacing=1).collect()
    assert {r["evaluations"] for r in idle} == {9}  # no gain within two windows


def test_old_checkpoints_go(spark, tmp_path):
    data, splits, bins, start = small_run(spark)
    tr.train(data, splits, bins, start, tr.Options(rank=2, batch=20, per_mse=1, max_iters=6), 1, checkpoint=f"{tmp_path}/c", every=1)
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["00000004", "00000005", "index"]


def test_bags_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    data, _, _, _ = small_run(spark)
    f = folds.nested_folds(spark, [(r, c) for r in range(4) for c in range(3)], 3, 4, 20, seed=1, take_test=True)
    o = tr.Options(rank=2, batch=20, per_mse=1, max_iters=1, burn_in_epochs=0.0)
    run = lambda: pipelines.bagged(data, f, 0, o, 2, 3, path=f"{tmp_path}/bags", n_workers=1)[0]
    key = lambda df: sorted((r["model"], r["start"], r["row_id"], r["col_id"], r["predicted"]) for r in df.collect())
    first = key(run())
    monkeypatch.setattr(pipelines, "train_model", lambda *a, **k: pytest.fail("trained again"))
    assert key(run()) == first and len(first) == 2 * 12 * 12
    saved = next((tmp_path / "bags").iterdir())
    wanted = spark.createDataFrame([(0, 1)], "row_id int, col_id int")
    got = pipelines.solve_saved(spark, str(saved), data, [(0, 0), (1, 1), (2, 2), (3, 0)], wanted).collect()
    assert len(got) == 12 and {(r["row_id"], r["col_id"]) for r in got} == {(0, 1)}


def test_what_is_written_on_the_way_goes(spark, tmp_path):
    from lacunar.sources import shared

    class Listing:
        def __call__(self):
            import os

            base = shared.shared_dir(spark).removeprefix("file://")
            return {os.path.join(d, f) for d, _, fs in os.walk(base) for f in fs}

    files = Listing()
    before = files()
    with shared.scratch(spark):
        a = shared.cut(spark.range(10).toDF("k"))
        b = shared.store(a, "x")
        shared.cut(b.join(a, "k")).write.parquet(f"{tmp_path}/out")
    assert files() == before and spark.read.parquet(f"{tmp_path}/out").count() == 10
    with pytest.raises(ValueError, match="stop"), shared.scratch(spark):
        shared.store(spark.range(3), "x")
        raise ValueError("stop")
    assert files() == before
    t = shared.dealt(spark.range(10).toDF("k"), 2, ["k"])
    assert t.count() == 10
    shared.forget(spark, t)
    assert files() == before


def test_only_named_axes_move(spark):
    data, splits, bins, start = small_run(spark)
    o = tr.Options(rank=2, batch=30, per_mse=1, max_iters=1, cols=False, bins=False)
    fit = tr.train(data, splits, bins, start, o, 2)
    assert np.allclose(fit.state.cols, start.cols) and not np.allclose(fit.state.rows, start.rows)
    before = {r["start"]: r["factors"] for r in bins.collect()}
    assert all(np.allclose(before[r["start"]], r["factors"]) for r in tr.factors_of(fit.states).collect())


def test_new_row_for_a_trained_model(spark):
    data, splits, _, _ = small_run(spark)
    plane = spark.createDataFrame([(r, c, s) for (r, c), s in splits.items()], "row_id int, col_id int, split string")
    new = cells(spark, [("a", b, 0, c, 1.0) for b in range(10) for c in range(2)])
    names = lambda n: spark.createDataFrame([(f"c{i}", i) for i in range(n)], "col_name string, col_id int")
    axes, fit = pipelines.add_row(data, new, names(3), names(2), plane, model.init_axes(4, 3, 2, 1), tr.Options(rank=2, batch=50, per_mse=1, max_iters=1), 2)
    assert axes.rows.shape == (5, 2) and axes.cols.shape == (3, 2) and tr.factors_of(fit.states).count() == 10


def test_noise_of_scale_zero_changes_nothing(spark):
    bins = model.init_bins(spark.createDataFrame([("a", 1)], "contig string, start long"), 3, 1)
    assert model.with_noise(bins, 4, 0.0).first()["factors"] == bins.first()["factors"]
    assert model.with_noise(bins, 4, 0.1).first()["factors"] != bins.first()["factors"]


def test_search_options():
    o = pipelines.search_options(tr.Options(), {"ratezzzexp": 0.0, "ri2": 4.0})
    assert o.rate == 1.0 and o.ri2 == 4.0
    assert [c["ri2"] for c, _ in pipelines.search(o, [{"ri2": 3.0}, {"ri2": 1.0}], lambda x: x.ri2)] == [1.0, 3.0]


def test_an_interval_is_a_few_rows_however_long(spark):
    """Rows after binning: two at most at each level, none for levels that the other side doesn't have."""
    long = [("x", 0, 250_000_000), ("x", 7, 1_000_000), ("y", 0, 1 << 40)]
    short = [("x", s, s + 100) for s in range(0, 1 << 20, 4096)]
    df = lambda rows: spark.createDataFrame(rows, "contig string, start long, end long")
    assert intervals.explode_bins(df(long[:2])).count() <= 4 and intervals.explode_bins(df(short)).count() <= 2 * len(short)
    levels = intervals.levels_of(intervals.WIDTH, df(short), df(long), df([]))
    assert levels[0] == [0] and levels[2] == [] and len(levels[1]) == 3
    assert intervals.explode_bins(df(short), above=levels[1]).count() <= 2 * 4 * len(short)
    assert intervals.explode_bins(df(long[2:])).count() <= 1 << 5  # beyond the widest bins it touches several
    a, b = long + short, long + [("y", 5, 6), ("x", 999_999, 1_000_001)]
    got = sorted(((r["contig"], r["start"], r["end"]), (r["b_contig"], r["b_start"], r["b_end"])) for r in intervals.overlaps(df(a), df(b)).collect())
    assert got == brute_overlaps(sorted(a), sorted(b))
    assert sorted(map(tuple, intervals.contained(df(a), df(b)).collect())) == sorted(x for x in a if any(x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in b))


def test_overlapping_keeps_rows_as_often_as_they_stand(spark):
    df = lambda rows: spark.createDataFrame(rows, "contig string, start long, end long")
    a = df([("x", 0, 10), ("x", 0, 10), ("x", 20, 30)])
    assert sorted(map(tuple, intervals.overlapping(a, df([("x", 1, 3), ("x", 2, 9), ("x", 9, 12)])).collect())) == [("x", 0, 10)] * 2


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_union_split_where_a_track_overlaps_itself(spark, parts):
    """The interval that begins last counts, then the larger value; borders of ranges leave no trace."""
    rng = random.Random(parts)
    rows = [(c, s, s + rng.choice([1, 4, 30, 150]), t, float(rng.randrange(1, 9))) for c in "xyz" for t in "ab" for s in (rng.randrange(0, 120) for _ in range(25))] + [("x", 5, 5, "a", 1.0), ("x", 0, 500, "other", 1.0)]
    t = spark.createDataFrame(rows, "contig string, start long, end long, track string, value double")
    got = sorted(map(tuple, intervals.union_split(t, ["a", "b"], parts).collect()))
    want = []
    for contig in "xyz":
        own = [r for r in rows if r[0] == contig and r[3] in "ab" and r[2] > r[1]]
        edges = sorted({e for r in own for e in r[1:3]})
        for lo, hi in zip(edges, edges[1:]):
            over = {t: max((s, v) for _, s, e, u, v in own if u == t and s < hi and lo < e)[1] for t in "ab" if any(u == t and s < hi and lo < e for _, s, e, u, v in own)}
            if over:
                want.append((contig, lo, hi, over.get("a", 0.0), over.get("b", 0.0)))
    assert got == want


def test_region_reader_plans_only_the_parts_it_needs(spark, tmp_path):
    """With an index parts that no region meets aren't read, not even broken ones; a line comes once for many regions."""
    for k in range(4):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"c{k // 2} {s} {s + 25} {s}|{k}\n" for s in range(k * 1000, k * 1000 + 500, 25)))
    path = str(tmp_path)
    regions = spark.createDataFrame([("c0", 1010, 1060), ("c0", 1020, 1030), ("c1", 0, 10), ("c9", 0, 10)], "contig string, start long, end long")
    plain = sorted(map(tuple, readers.packed_lines(spark, path, regions).collect()))
    assert [r[1] for r in plain] == [1000, 1025, 1050]
    assert readers.index_parts(spark, path).count() == 4
    lines = readers.packed_lines(spark, path, regions)
    assert sorted(map(tuple, lines.collect())) == plain
    assert [f.rsplit("/", 1)[1] for f in lines.inputFiles()] == ["part-1.txt"]
    assert readers.packed_lines(spark, path, regions.where("contig = 'c9'")).count() == 0
    assert readers.packed_lines(spark, path).count() == 80


def test_assemble_raises_for_entries_that_name_no_file(spark, tmp_path):
    (tmp_path / "a b.bed").write_text("x 0 10 1.0\n")
    (tmp_path / "c.bed").write_text("x 0 10 1.0\n")
    files = lambda *names: spark.createDataFrame([(f"{tmp_path}/{n}", "r", n) for n in names], "url string, row_name string, col_name string")
    w = intervals.windows(spark, "x", 0, 20, 10)
    assert readers.assemble(spark, files("a b.bed", "c.bed"), w).count() == 2
    with pytest.raises(ValueError, match="name no file"):
        readers.assemble(spark, files("a b.bed", "c*.bed"), w)


def test_halving_gives_the_good_ones_more(spark, monkeypatch):
    """Fewer iterations than a grid of full runs, the order repeats, and the cells are dealt once."""
    data, splits, _, _ = small_run(spark)
    table = spark.createDataFrame([(r, c, k) for (r, c), k in splits.items()], "row_id int, col_id int, split string")
    base = tr.Options(rank=2, batch=80, rate=0.05)
    candidates = [{"rate": 1e-7}, {"rate": 0.05}, {"rate": float("nan")}, {"rate": 0.01}]
    steps, real = [], tr.step
    monkeypatch.setattr(tr, "step", lambda *a, **k: steps.append(1) or real(*a, **k))
    dealt, plain = [], tr.bin_cells
    monkeypatch.setattr(tr, "bin_cells", lambda *a, **k: dealt.append(1) or plain(*a, **k))
    got = pipelines.halving(data, table, base, candidates, rungs=(1, 3), keep=0.5, n_workers=2)
    assert len(steps) == 4 * 1 + 2 * 2 and len(dealt) == 2
    assert [g[1] for g in got] == [3, 3, 1, 1] and got[-1][0]["rate"] != got[-1][0]["rate"]
    assert got[0][2] <= got[1][2] and got[0][2] == got[0][2]
    again = pipelines.halving(data, table, base, candidates, rungs=(1, 3), keep=0.5, n_workers=2)
    assert [(str(c), n) for c, n, _ in got] == [(str(c), n) for c, n, _ in again]


def test_interval_joins_are_equi_joins(spark):
    a = spark.range(1000).select(F.lit("x").alias("contig"), F.col("id").alias("start"), (F.col("id") + 3).alias("end"))
    for df in (intervals.overlaps(a, a), intervals.flagged(a, a), intervals.window_means(a, a.withColumn("value", F.lit(1.0)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1, 0, 0, 1.0)], "contig string, start long, row_id int, col_id int, value double").write.parquet(f"{tmp_path}/t")
    plan = stats.row_bias(readers.load_tensor(spark, f"{tmp_path}/t").where("contig = 'a'"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(contig,a)" in plan and "start" not in plan.split("ReadSchema:")[1].split(">")[0]


@pytest.mark.parametrize("unrolled", [0, 8])
def test_predictions_in_blocks(spark, unrolled):
    """Blocks of the plane give what the whole gives, with all cells and with some; a plane beyond one block has no cap."""
    bins = spark.createDataFrame([("a", k, [0.1 * k, 0.2], 0.5) for k in range(3)], "contig string, start long, factors array<double>, bias double")
    rows, cols = (spark.createDataFrame([(k, [x * k, 1.0], 0.01 * k) for k in range(n)], "id int, factors array<double>, bias double") for n, x in ((7, 0.3), (5, 0.7)))
    some = spark.createDataFrame([(r, c) for r in range(7) for c in range(5) if (r + c) % 3] + [(99, 0)], "row_id int, col_id int")
    key = lambda df: {tuple(r)[:4]: pytest.approx(r["predicted"]) for r in df.collect()}
    hand = {("a", k, r, c): (0.3 * r * 0.7 * c * 0.1 * k + 0.2) + 0.01 * r + 0.01 * c + 1.5 + 0.5 for k in range(3) for r in range(7) for c in range(5)}
    for block in (1 << 17, 6):
        assert key(model.predicted(bins, rows, cols, 1.5, None, unrolled=unrolled, block=block)) == hand
        assert key(model.predicted(bins, rows, cols, 1.5, some, unrolled=unrolled, block=block)) == {k: v for k, v in hand.items() if (k[2] + k[3]) % 3}
    many = spark.range(400).select(F.col("id").cast("int").alias("id"), F.array(F.col("id") * 0.001, F.lit(1.0)).alias("factors"), F.lit(0.0).alias("bias"))
    got = model.predicted(bins, many, many, 0.0, unrolled=unrolled).agg(F.count(F.lit(1)), F.max("row_id"), F.sum("predicted")).first()
    want = sum(0.1 * k * sum(0.001 * r for r in range(400)) ** 2 + 160_000 * 0.7 for k in range(3))
    assert (got[0], got[1]) == (480_000, 399) and got[2] == pytest.approx(want)
