"""The registered queries of the library's own operators, each with the SQL that DuckDB must agree with.

Doubles are rounded to six places on both sides, as the order of a sum is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.functions import scalar
from lacunar.operators import folds, impute, intervals, metrics, model, stats, tensor
from lacunar.operators.tensor import KEYS
from lacunar.sources import sinks

from . import fixtures as fx
from .fixtures import SQL_E, SQL_L, SQL_SPLIT, SQL_W, sql_predicted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

E_SHAPE, L_SHAPE = (20, 5), (25, 25)
E_SPLIT = SQL_SPLIT.format(name="s", rows=20, cols=5)
L_SPLIT = SQL_SPLIT.format(name="s", rows=25, cols=25)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def cells(t: DataFrame, value: str = "value", into: str | None = None) -> DataFrame:
    return t.select(*KEYS, "row_id", "col_id", r6(value, into or value))


def e_predicted(spark: SparkSession, d: str, phase: float = 0.0, want: DataFrame | None = None) -> DataFrame:
    rows, cols = fx.axes3(spark, *E_SHAPE)
    return model.predicted(fx.bins3(fx.e(spark, d), phase), rows, cols, 5.0, want)


# --- the tensor ---


@query(f"WITH {SQL_L} SELECT contig, start, row_id, col_id, round(value, 6) AS value FROM l")
def tensor_build_l(spark, d):
    return cells(fx.l(spark, d))


@query(f"WITH {SQL_E} SELECT contig, start, row_id, col_id, round(value, 6) AS value FROM e")
def tensor_build_e(spark, d):
    return cells(fx.e(spark, d))


@query("""SELECT n_name || '/' || p_brand AS exp, n_name AS row_name, p_brand AS col_name, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS INTEGER) AS row_id,
CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS col_id FROM nation, (SELECT DISTINCT p_brand FROM part)""")
def catalogue_ids(spark, d):
    ex = fx.table(spark, d, "nation").select(F.col("n_name").alias("row_name")).crossJoin(F.broadcast(fx.brands(spark, d).select(F.col("p_brand").alias("col_name"))))
    return tensor.catalogue(ex.withColumn("exp", F.concat_ws("/", "row_name", "col_name"))).select("exp", "row_name", "col_name", "row_id", "col_id")


@query(f"WITH {SQL_E} SELECT max(row_id) + 1 AS n_rows, max(col_id) + 1 AS n_cols FROM e")
def tensor_shape(spark, d):
    return tensor.shape(fx.e(spark, d))


@query(f"WITH {SQL_E} SELECT count(DISTINCT start) AS n_bins, count(*) AS n_observed, CAST(ceil(count(DISTINCT start) / 50.0) AS BIGINT) AS n_slices FROM e")
def slice_count(spark, d):
    return tensor.counts(fx.e(spark, d), 50)


@query(f"WITH {SQL_E} SELECT DISTINCT row_id, col_id FROM e WHERE start < 50")
def observed_pattern(spark, d):
    return tensor.observed_pattern(fx.e(spark, d).where("start < 50"))


@query(f"WITH {SQL_E}, b AS (SELECT DISTINCT contig, start FROM e) SELECT contig, start, row_number() OVER (ORDER BY contig, start) - 1 AS ordinal FROM b")
def bin_ordinal(spark, d):
    return tensor.with_ordinal(fx.e(spark, d).select(*KEYS).distinct())


@query(f"""WITH {SQL_E}, b AS (SELECT DISTINCT contig, start FROM e), o AS (SELECT *, row_number() OVER (ORDER BY contig, start) - 1 AS ordinal, count(*) OVER () AS n FROM b)
SELECT contig, start, ordinal, CAST(ordinal >= n // 2 AS INTEGER) AS half FROM o""")
def half_split(spark, d):
    return tensor.halves(fx.e(spark, d).select(*KEYS).distinct())


@query(f"WITH {SQL_E}, b AS (SELECT DISTINCT contig, start FROM e), o AS (SELECT *, row_number() OVER (ORDER BY contig, start) - 1 AS ordinal FROM b) SELECT * FROM o WHERE (ordinal + 3) % 7 = 0")
def modulus_sample(spark, d):
    """A sampling operator: every seventh bin is its feature."""
    return tensor.every_nth(fx.e(spark, d).select(*KEYS).distinct(), 7, 3)


@query(f"WITH {SQL_E} SELECT contig, start, row_id, col_id, round(sinh(value), 6) AS value FROM e")
def sinh_roundtrip(spark, d):
    return cells(tensor.with_sinh(fx.e(spark, d)))


@query(f"WITH {SQL_E}, m AS (SELECT avg(value) AS mean FROM e) SELECT contig, start, row_id, col_id, round(value - mean, 6) AS value FROM e, m")
def asinh_center(spark, d):
    t = fx.e(spark, d)
    mean = stats.global_mean(t)
    return cells(t.crossJoin(F.broadcast(mean)).withColumn("value", F.col("value") - F.col("mean")))


@query(f"WITH {SQL_E}, x AS (SELECT contig, start, row_id, col_id, CASE WHEN row_id % 5 = 0 THEN 0 WHEN row_id % 5 = 1 THEN NULL ELSE value END AS value FROM e) SELECT contig, start, row_id, col_id, round(value, 6) AS value FROM x WHERE value <> 0")
def scrub_zero(spark, d):
    k = F.col("row_id") % 5
    return cells(tensor.scrub(fx.e(spark, d).withColumn("value", F.when(k == 0, F.lit(0.0)).when(k == 1, F.lit(float("nan"))).otherwise(F.col("value")))))


@query(f"WITH {SQL_E} SELECT contig, start, row_id, col_id, round(value - 5, 6) AS value FROM e WHERE value - 5 > 0")
def clamp_negatives(spark, d):
    return cells(tensor.without_negatives(tensor.centered(fx.e(spark, d), 5.0)))


@query(f"WITH {SQL_E} SELECT contig, start, row_id * 5 + col_id AS flat, round(value, 6) AS value FROM e")
def flat_cells(spark, d):
    return fx.e(spark, d).select(*KEYS, scalar.flat_index(F.col("row_id"), F.col("col_id"), 5).alias("flat"), r6("value", "value"))


def whole_numbers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Cells of E as whole numbers, cut where no average falls, and the slots they are packed in."""
    slots = fx.plane(spark, *E_SHAPE).withColumn("slot", F.col("row_id") * 5 + F.col("col_id"))
    return fx.raw_e(spark, d).withColumn("value", F.floor(F.col("value") + 0.4877).cast("double")), slots


WHOLE = f"{SQL_E}, wh AS (SELECT contig, start, row_id, col_id, floor(v + 0.4877) AS value FROM raw_e JOIN kind USING (event_type))"


@query(f"""WITH {WHOLE}, g AS (SELECT b.contig, b.start, r * 5 + c AS slot, CAST(coalesce(wh.value, 0) AS BIGINT) AS v
FROM (SELECT DISTINCT contig, start FROM wh) b CROSS JOIN range(20) x(r) CROSS JOIN range(5) y(c) LEFT JOIN wh ON wh.start = b.start AND wh.row_id = r AND wh.col_id = c)
SELECT contig, start, string_agg(v::VARCHAR || '.0', '|' ORDER BY slot) AS packed FROM g GROUP BY ALL""")
def pack_values(spark, d):
    return tensor.packed_text(*whole_numbers(spark, d))


@query(f"WITH {WHOLE} SELECT contig, start, row_id, col_id, round(asinh(value), 6) AS value FROM wh WHERE value <> 0")
def unpack_values(spark, d):
    t, slots = whole_numbers(spark, d)
    return cells(tensor.unpacked_text(tensor.packed_text(t, slots), slots, 100))


@query(f"""WITH {SQL_L}, a AS (SELECT * FROM l WHERE row_id < 13 AND start <= 24000), b AS (SELECT contig, start, row_id - 13 AS row_id, col_id, value FROM l WHERE row_id >= 13 AND start > 23950 AND col_id < 20),
k AS (SELECT DISTINCT start FROM a INTERSECT SELECT DISTINCT start FROM b)
SELECT contig, start, CAST(row_id AS INTEGER) AS row_id, col_id, round(value, 6) AS value FROM (SELECT * FROM a UNION ALL SELECT contig, start, row_id + 13, col_id, value FROM b) WHERE start IN (SELECT start FROM k)""")
def tensor_merge(spark, d):
    """Two halves of the nations, columns aligned by brand; the second has fewer, in reverse order, and one unknown."""
    t = fx.l(spark, d)
    names = fx.brands(spark, d).select(F.col("p_brand").alias("col_name"), "col_id")
    other = names.where("col_id < 20").withColumn("col_id", 19 - F.col("col_id")).unionByName(spark.range(1).select(F.lit("unknown").alias("col_name"), F.lit(20).alias("col_id")))
    b = t.where("row_id >= 13 and start > 23950 and col_id < 20").withColumn("row_id", F.col("row_id") - 13).withColumn("col_id", 19 - F.col("col_id"))
    b = b.unionByName(b.where("col_id = 0").withColumn("col_id", F.lit(20)))
    return cells(tensor.merged(t.where("row_id < 13 and start <= 24000"), b, names, other, 13))


# --- intervals ---


@query(f"""WITH {SQL_W}, b AS (SELECT 'w' AS contig, CAST(i * 21600 AS BIGINT) AS start, CAST((i + 1) * 21600 AS BIGINT) AS "end" FROM range(130) t(i))
SELECT b.contig, b.start, b."end", round(coalesce(avg(f.value), 0), 6) AS value FROM b LEFT JOIN f ON f.start < b."end" AND b.start < f."end" GROUP BY ALL""")
def window_bin_mean(spark, d):
    return intervals.window_means(intervals.windows(spark, "w", 0, 130 * 21600, 21600), fx.event_features(spark, d)).select("contig", "start", "end", r6("value", "value"))


@query(f'WITH {SQL_W} SELECT w.contig, w.start, w."end", count(*) AS n FROM w JOIN g ON w.start < g."end" AND g.start < w."end" GROUP BY ALL')
def interval_overlap_all(spark, d):
    """Windows once for every region they overlap."""
    return intervals.overlaps(fx.windows(spark), fx.regions(spark, d)).groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("n"))


@query(f'WITH {SQL_W} SELECT * FROM w WHERE EXISTS (SELECT 1 FROM g WHERE w.start < g."end" AND g.start < w."end")')
def interval_overlap_semi(spark, d):
    return intervals.overlapping(fx.windows(spark), fx.regions(spark, d))


@query(f'WITH {SQL_W} SELECT * FROM w WHERE EXISTS (SELECT 1 FROM g WHERE w.start >= g.start AND w."end" <= g."end")')
def interval_contained(spark, d):
    return intervals.contained(fx.windows(spark), fx.regions(spark, d))


@query(f"""WITH {SQL_W} SELECT w.contig, w.start, w."end", CAST(EXISTS (SELECT 1 FROM g WHERE w.start < g."end" AND g.start < w."end") AS INTEGER) AS flag FROM w""")
def interval_flag(spark, d):
    return intervals.flagged(fx.windows(spark), fx.regions(spark, d))


@query(f"""WITH {SQL_W}, m AS (SELECT w.contig, w.start, w."end", event_type, avg(value) AS v FROM w JOIN f ON f.start >= w.start AND f.start < w."end" GROUP BY ALL)
SELECT contig, start, "end", {", ".join(f"round(coalesce(max(v) FILTER (event_type = '{k}'), 0), 6) AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view"))} FROM m GROUP BY ALL""")
def track_union_wide(spark, d):
    names = ["click", "error", "purchase", "signup", "view"]
    met = intervals.overlaps(fx.windows(spark), fx.event_features(spark, d)).groupBy("contig", "start", "end", F.col("b_event_type").alias("track")).agg(F.avg("b_value").alias("value"))
    wide = intervals.union_aligned(met, names)
    return wide.select("contig", "start", "end", *(r6(n, n) for n in names))


@query(f"""WITH {SQL_W}, t AS (SELECT contig, start, "end", 'a' AS track, 1.0 AS v FROM (SELECT start, max("end") AS "end", contig FROM g GROUP BY ALL) UNION ALL SELECT contig, start, "end", 'b', 2.0 FROM w WHERE start % 7200 = 0),
x AS (SELECT contig, start FROM t UNION SELECT contig, "end" FROM t), y AS (SELECT contig, start, lead(start) OVER (PARTITION BY contig ORDER BY start) AS "end" FROM x)
SELECT y.contig, y.start, y."end", CAST(coalesce(max(v) FILTER (track = 'a'), 0) AS DOUBLE) AS a, CAST(coalesce(max(v) FILTER (track = 'b'), 0) AS DOUBLE) AS b
FROM y JOIN t ON t.start < y."end" AND y.start < t."end" GROUP BY ALL""")
def track_union_split(spark, d):
    """Tracks that don't share their windows, cut at every edge."""
    a = fx.regions(spark, d).groupBy("contig", "start").agg(F.max("end").alias("end")).withColumns({"track": F.lit("a"), "value": F.lit(1.0)})
    b = fx.windows(spark).where("start % 7200 = 0").withColumns({"track": F.lit("b"), "value": F.lit(2.0)})
    return intervals.union_split(a.unionByName(b), ["a", "b"])


# --- splits and folds ---


#: The cells of the plane that E observes.
SEEN = "seen AS (SELECT DISTINCT row_id, col_id FROM e)"


def seen(spark, d) -> DataFrame:
    return tensor.observed_pattern(fx.e(spark, d))


@query(f"WITH {SQL_E}, {SEEN}, {E_SPLIT} SELECT s.* FROM s JOIN seen USING (row_id, col_id)")
def split_assign(spark, d):
    return seen(spark, d).withColumn("split", folds.formula_split(F.col("row_id"), F.col("col_id")))


@query(f"WITH {SQL_E}, {E_SPLIT} SELECT split, count(*) AS n FROM e JOIN s USING (row_id, col_id) GROUP BY split")
def split_counts(spark, d):
    return fx.e(spark, d).join(F.broadcast(fx.splits(spark, *E_SHAPE)), tensor.CELL).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_E} SELECT DISTINCT row_id, col_id, 'train' AS split FROM e")
def trainall_mask(spark, d):
    return folds.all_train(tensor.observed_pattern(fx.e(spark, d)))


ORDER = "(row_id * 37 + col_id * 11) % 101, row_id, col_id"
RR = f"rr AS (SELECT row_id, col_id, CAST((row_number() OVER (ORDER BY {ORDER}) - 1) % 5 AS INTEGER) AS fold FROM seen)"


def dealt(spark, d) -> DataFrame:
    r, c = F.col("row_id"), F.col("col_id")
    return folds.round_robin(seen(spark, d), 5, [(r * 37 + c * 11) % 101, r, c])


@query(f"WITH {SQL_E}, {SEEN}, {RR} SELECT * FROM rr")
def fold_round_robin(spark, d):
    return dealt(spark, d)


@query(f"""WITH {SQL_E}, {SEEN}, {RR}, q AS (SELECT row_id AS k, fold, count(*) AS n FROM rr GROUP BY ALL), q2 AS (SELECT col_id AS k, fold, count(*) AS n FROM rr GROUP BY ALL)
SELECT CAST((SELECT sum(m) FROM (SELECT max(n) AS m FROM q GROUP BY k)) + (SELECT sum(m) FROM (SELECT max(n) AS m FROM q2 GROUP BY k)) AS BIGINT) AS quality""")
def fold_quality(spark, d):
    return folds.fold_quality(dealt(spark, d))


@query(f"""WITH {SQL_E}, {SEEN}, s AS (SELECT row_id, col_id, CASE WHEN row_id % 4 = 0 OR col_id = 2 THEN 'valid' ELSE 'train' END AS split FROM seen),
p AS (SELECT row_id, col_id, CASE WHEN split = 'valid' AND NOT bool_or(split = 'train') OVER (PARTITION BY row_id) THEN 'train' ELSE split END AS split FROM s)
SELECT row_id, col_id, CASE WHEN split = 'valid' AND NOT bool_or(split = 'train') OVER (PARTITION BY col_id) THEN 'train' ELSE split END AS split FROM p""")
def fold_patch(spark, d):
    r, c = F.col("row_id"), F.col("col_id")
    return folds.patched(seen(spark, d).withColumn("split", F.when((r % 4 == 0) | (c == 2), F.lit("valid")).otherwise(F.lit("train"))))


FOLDS = f"""WITH {SQL_E}, {SEEN}, n AS (SELECT count(*) AS n, count(DISTINCT row_id) AS r, count(DISTINCT col_id) AS c FROM seen)
SELECT CAST(t AS INTEGER) AS test_fold, CAST(v AS INTEGER) AS valid_fold, n AS cells, (n + 4 - t) // 5 AS tests, n - (n + 4 - t) // 5 AS others,
r AS rows_trained, c AS cols_trained, 0::BIGINT AS repeated, {{more}} FROM n, range(5) a(t), range(8) b(v)"""


def fold_table(f: DataFrame, *more: Column) -> DataFrame:
    """What must hold of nested folds: every cell once per pair of folds, equal test folds, no row or column left
    untrained, and no cell in two test or two validation folds."""
    of = lambda split: F.col("split") == split
    n = lambda c: F.sum(c.cast("long"))
    trained = lambda c: F.count_distinct(F.when(of("train"), F.col(c)))
    tests = f.where(of("test")).groupBy(*tensor.CELL).agg(F.count_distinct("test_fold").alias("k")).where("k <> 1")
    valids = f.where(of("valid")).groupBy("test_fold", *tensor.CELL).agg(F.count(F.lit(1)).alias("k")).where("k <> 1")
    repeated = tests.select("k").unionAll(valids.select("k")).agg(F.count(F.lit(1)).alias("repeated"))
    out = f.groupBy("test_fold", "valid_fold").agg(F.count_distinct(*tensor.CELL).alias("cells"), n(of("test")).alias("tests"), n(~of("test")).alias("others"), trained("row_id").alias("rows_trained"), trained("col_id").alias("cols_trained"), *more)
    return out.crossJoin(F.broadcast(repeated))


@query(FOLDS.format(more="0::BIGINT AS misplaced"))
def nested_folds(spark, d):
    """Validation folds for test folds that are given: the cells of E, dealt in a fixed order. A cell may be taken from
    validation for a row that has no other to train on."""
    cells = dealt(spark, d)
    known = [(r["row_id"], r["col_id"], r["fold"]) for r in cells.collect()]  # the plane
    given = [[(r, c) for r, c, k in known if k == fold] for fold in range(5)]
    f = folds.nested_folds(spark, [(r, c) for r, c, _ in known], 5, 8, 200, seed=3, fixed_test=given)
    misplaced = F.sum(((F.col("split") == "test") != (F.col("test_fold") == F.col("fold"))).cast("long")).alias("misplaced")
    return fold_table(f.join(F.broadcast(cells), tensor.CELL), misplaced)


@query(FOLDS.format(more="(n - (n + 4 - t) // 5 + 7 - v) // 8 AS valids"))
def best_folds(spark, d):
    """Nested folds of the cells that E observes, test folds and all, by the best of 10,000 random deals each."""
    f = folds.nested_folds(spark, [(r["row_id"], r["col_id"]) for r in seen(spark, d).collect()], seed=7)  # the plane
    return fold_table(f, F.sum((F.col("split") == "valid").cast("long")).alias("valids"))


@query(f"WITH {SQL_E} SELECT contig, start, row_id, col_id, CAST(ntile(4) OVER (PARTITION BY contig, start ORDER BY row_id, col_id) - 1 AS INTEGER) AS subset FROM e")
def bin_subsets(spark, d):
    return folds.bin_subsets(fx.e(spark, d), 4, KEYS).select(*KEYS, "row_id", "col_id", "subset")


# --- means and biases ---

TRAIN = f"""{SQL_L}, {L_SPLIT}, t AS (SELECT l.* FROM l JOIN s USING (row_id, col_id) WHERE split = 'train'),
rb AS (SELECT row_id, avg(value) AS row_bias FROM t GROUP BY row_id),
cb AS (SELECT col_id, avg(value - row_bias) AS col_bias FROM t JOIN rb USING (row_id) GROUP BY col_id)"""


def l_train(spark, d) -> DataFrame:
    return stats.in_split(fx.l(spark, d), fx.splits(spark, *L_SHAPE), "train")


@query(f"WITH {TRAIN} SELECT round(avg(value), 6) AS mean FROM t")
def global_mean_train(spark, d):
    return stats.global_mean(fx.l(spark, d), fx.splits(spark, *L_SHAPE)).select(r6("mean", "mean"))


@query(f"WITH {TRAIN} SELECT row_id, round(row_bias, 6) AS row_bias FROM rb")
def row_bias(spark, d):
    return stats.row_bias(l_train(spark, d)).select("row_id", r6("row_bias", "row_bias"))


@query(f"WITH {TRAIN} SELECT col_id, round(col_bias, 6) AS col_bias FROM cb")
def col_bias(spark, d):
    t = l_train(spark, d)
    return stats.col_bias(t, stats.row_bias(t)).select("col_id", r6("col_bias", "col_bias"))


@query(f"WITH {TRAIN}, b AS (SELECT DISTINCT contig, start FROM l), x AS (SELECT start, avg(value - row_bias - col_bias) AS v FROM t JOIN rb USING (row_id) JOIN cb USING (col_id) GROUP BY start) SELECT contig, start, round(coalesce(v, 0), 6) AS bin_bias FROM b LEFT JOIN x USING (start)")
def bin_bias(spark, d):
    t = l_train(spark, d)
    rows = stats.row_bias(t)
    return stats.bin_bias(t, rows, stats.col_bias(t, rows), fx.l(spark, d).select(*KEYS).distinct()).select(*KEYS, r6("bin_bias", "bin_bias"))


# --- the model ---

E_PRED = f"{SQL_E}, {sql_predicted('e', 20, 5)}"


@query(f"WITH {E_PRED} SELECT contig, start, row_id, col_id, round(predicted, 6) AS predicted FROM p")
def predict_rank3(spark, d):
    return cells(e_predicted(spark, d), "predicted")


@query(f"WITH {E_PRED} SELECT contig, start, row_id, col_id, round(predicted, 6) AS predicted FROM p WHERE row_id IN (2, 3, 5) AND col_id IN (1, 3)")
def predict_requested_cells(spark, d):
    rows = spark.range(20).select(F.col("id").cast("int").alias("row_id"), F.concat(F.lit("u"), "id").alias("row_name"))
    cols = fx.types(spark, d).withColumnRenamed("event_type", "col_name")
    want = impute.requested_cells(rows, cols, ["u2", "u3", "u5", "u99"], ["error", "signup"])
    return cells(e_predicted(spark, d, want=want), "predicted")


@query(f"WITH {E_PRED} SELECT p.contig, p.start, p.row_id, p.col_id, round(predicted, 6) AS predicted FROM p ANTI JOIN e USING (start, row_id, col_id)")
def impute_missing_cells(spark, d):
    return cells(impute.missing_only(e_predicted(spark, d), fx.e(spark, d)), "predicted")


@query(f"WITH {SQL_E}, {sql_predicted('e', 20, 5, mean=0.0)} SELECT contig, start, row_id, col_id, round(greatest(predicted, 0), 6) AS predicted FROM p")
def impute_nonneg(spark, d):
    rows, cols = fx.axes3(spark, *E_SHAPE)
    return cells(model.clamped(model.predicted(fx.bins3(fx.e(spark, d)), rows, cols)), "predicted")


RIDGE = f"""{TRAIN}, g0 AS (SELECT avg(value) AS gm FROM t),
pl AS (SELECT s.row_id, s.col_id, sin(s.row_id + 0.5) * cos(s.col_id + 0.25) AS z, (row_bias - gm) + col_bias AS o FROM s JOIN rb USING (row_id) JOIN cb USING (col_id), g0 WHERE split = 'train'),
fl AS (SELECT sum(z * z) + 2.9 AS szz, sum(z) AS sz, count(*) AS n, sum(-z * o) AS ze0, sum(-o) AS e0 FROM pl),
ob AS (SELECT start, sum(z * (value - gm)) AS zd, sum(value - gm) AS dd FROM t JOIN pl USING (row_id, col_id), g0 GROUP BY start),
bn AS (SELECT b.contig, b.start, szz, sz, n, coalesce(zd, 0) + ze0 AS sze, coalesce(dd, 0) + e0 AS se FROM (SELECT DISTINCT contig, start FROM l) b LEFT JOIN ob USING (start), fl),
sol AS (SELECT contig, start, (sze * n - sz * se) / (szz * n - sz * sz) AS g, (szz * se - sz * sze) / (szz * n - sz * sz) AS gb FROM bn)"""


def rank1(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tensor, solved bins, row biases, column biases, mean) of the rank-one model of L; row biases are of the centered data."""
    t, splits = fx.l(spark, d), fx.splits(spark, *L_SHAPE)
    train = stats.in_split(t, splits, "train")
    mean = stats.global_mean(train)
    centre = lambda x: x.crossJoin(F.broadcast(mean)).withColumn("value", F.col("value") - F.col("mean")).drop("mean")
    rows = stats.row_bias(centre(train))
    cols = stats.col_bias(centre(train), rows)
    r, c = F.col("row_id"), F.col("col_id")
    plane = splits.where("split = 'train'").join(rows, "row_id").join(cols, "col_id").select("row_id", "col_id", (F.sin(r + 0.5) * F.cos(c + 0.25)).alias("z"), (F.col("row_bias") + F.col("col_bias")).alias("offset"))
    return t, model.solve_bins_rank1(centre(t), plane, 2.9), rows, cols, mean


@query(f"WITH {RIDGE} SELECT contig, start, round(g, 6) AS g, round(gb, 6) AS gb FROM sol")
def ridge_rank1(spark, d):
    return rank1(spark, d)[1].select(*KEYS, r6("g", "g"), r6("gb", "gb"))


@query(f"""WITH {RIDGE}, p AS (SELECT contig, start, row_id, col_id, g * sin(row_id + 0.5) * cos(col_id + 0.25) + gb + (row_bias - gm) + col_bias + gm AS predicted FROM sol, rb, cb, g0)
SELECT p.contig, p.start, p.row_id, p.col_id, round(predicted, 6) AS predicted FROM p ANTI JOIN l USING (start, row_id, col_id)""")
def ridge_rank1_imputed(spark, d):
    """From tables to imputed cells: the tensor, its biases, the closed-form solution, and a value for every missing cell."""
    t, sol, rows, cols, mean = rank1(spark, d)
    plane = rows.crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(mean))
    r, c = F.col("row_id"), F.col("col_id")
    p = sol.crossJoin(F.broadcast(plane)).withColumn("predicted", F.col("g") * F.sin(r + 0.5) * F.cos(c + 0.25) + F.col("gb") + F.col("row_bias") + F.col("col_bias") + F.col("mean"))
    return cells(impute.missing_only(p.select(*KEYS, "row_id", "col_id", "predicted"), t), "predicted")


def _rank4() -> tuple[model.Axes, list[tuple[int, int]]]:
    """Axes drawn from a seed, and the training cells of the formula's split."""
    train = [(r, c) for r in range(L_SHAPE[0]) for c in range(L_SHAPE[1]) if (r * 7 + c * 3) % 10 < 7]
    return model.init_axes(*L_SHAPE, 4, 5), train


def _rank4_sql() -> str:
    """The solution as sums of values times fixed weights: columns of the pseudo-inverse, found here by solving the
    normal equations of the design once per training cell."""
    axes, train = _rank4()
    z = np.array([[*(axes.rows[r] * axes.cols[c]), 1.0] for r, c in train])
    w = np.linalg.solve(z.T @ z + np.diag([2.9] * 4 + [0.0]), z.T).T
    rows = ", ".join(f"({r}, {c}, {', '.join(f'{x:.17e}::DOUBLE' for x in own)})" for (r, c), own in zip(train, w, strict=True))
    sums = ", ".join(f"round(coalesce(sum((value - gm) * w{k}), 0), 6) AS {name}" for k, name in enumerate(["f0", "f1", "f2", "f3", "bias"]))
    return f"""WITH {SQL_L}, g0 AS (SELECT avg(value) AS gm FROM l), wt(row_id, col_id, w0, w1, w2, w3, w4) AS (VALUES {rows}),
o AS (SELECT l.*, gm, w0, w1, w2, w3, w4 FROM l CROSS JOIN g0 LEFT JOIN wt USING (row_id, col_id)) SELECT contig, start, {sums} FROM o GROUP BY contig, start"""


@query(_rank4_sql())
def ridge_rank4(spark, d):
    """The same in closed form at rank four, by one matrix product per batch of bins."""
    t = fx.l(spark, d)
    axes, train = _rank4()
    mean = t.agg(F.avg("value")).first()[0]
    sol = model.solve_bins(tensor.centered(t, mean), axes, train, 2.9)
    return sol.select(*KEYS, *(r6(F.get("factors", F.lit(k)), f"f{k}") for k in range(4)), r6("bias", "bias"))


# --- errors ---


@query(f"""WITH {E_PRED}, {E_SPLIT}, n AS (SELECT count(DISTINCT start) AS bins FROM e), pl AS (SELECT split, count(*) AS k FROM s GROUP BY split),
x AS (SELECT split, sum((predicted - value) ** 2) AS sse FROM e JOIN p USING (start, row_id, col_id) JOIN s USING (row_id, col_id) GROUP BY split)
SELECT split, round(coalesce(sse, 0), 6) AS sse, k * bins AS n, round(coalesce(sse, 0) / (k * bins), 6) AS mse FROM pl LEFT JOIN x USING (split), n""")
def mse_by_split(spark, d):
    out = stats.mse_by_split(fx.e(spark, d), e_predicted(spark, d), fx.splits(spark, *E_SHAPE))
    return out.select("split", r6("sse", "sse"), "n", r6("mse", "mse"))


@query(f"""WITH {E_PRED}, {E_SPLIT}, half AS (SELECT *, CASE WHEN start < 60 THEN 'train' ELSE 'other' END AS part FROM e),
n AS (SELECT part, count(DISTINCT start) AS bins FROM half GROUP BY part), pl AS (SELECT split, CASE split WHEN 'train' THEN 'train' ELSE 'other' END AS part, count(*) AS k FROM s GROUP BY split),
x AS (SELECT split, sum((predicted - value) ** 2) AS sse FROM half JOIN p USING (start, row_id, col_id) JOIN s USING (row_id, col_id) WHERE part = CASE split WHEN 'train' THEN 'train' ELSE 'other' END GROUP BY split)
SELECT split, round(coalesce(sse, 0), 6) AS sse, k * bins AS n, round(coalesce(sse, 0) / (k * bins), 6) AS mse FROM pl JOIN n USING (part) LEFT JOIN x USING (split)""")
def mse_split_loci(spark, d):
    t = fx.e(spark, d)
    out = stats.mse_split_loci(t.where("start < 60"), t.where("start >= 60"), e_predicted(spark, d), fx.splits(spark, *E_SHAPE))
    return out.select("split", r6("sse", "sse"), "n", r6("mse", "mse"))


@query(f"WITH {SQL_E}, b AS (SELECT *, ntile(4) OVER (PARTITION BY contig, start ORDER BY row_id, col_id) AS k FROM e) SELECT round(avg(value), 6) AS mean, count(*) AS n FROM b WHERE k < 4")
def global_mean_bin_masks(spark, d):
    """Masks that differ from bin to bin: three of four subsets train."""
    t = fx.e(spark, d)
    masks = folds.bin_subsets(t, 4, KEYS).withColumn("split", F.when(F.col("subset") < 3, F.lit("train")).otherwise(F.lit("valid")))
    return stats.in_bin_split(t, masks, "train").agg(r6(F.avg("value"), "mean"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_E}, b AS (SELECT contig, start, count(*) AS t FROM e GROUP BY ALL) SELECT contig, start, t, round(0.005 * power(1 - 1e-6, t - 1), 9) AS rate, round(0.9 * power(1 - 1e-6, t - 1), 9) AS beta1 FROM b")
def decay_schedule(spark, d):
    """Rate and first decay of each bin after as many updates as it has cells."""
    t = F.col("t")
    return fx.e(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("t")).select(*KEYS, "t", F.round(scalar.decayed(0.005, t), 9).alias("rate"), F.round(scalar.decayed(0.9, t), 9).alias("beta1"))


@query(f"WITH {E_PRED}, n AS (SELECT count(DISTINCT start) AS bins FROM e) SELECT p.row_id, p.col_id, round(sum((predicted - coalesce(value, 0)) ** 2) / max(bins), 6) AS mse FROM p LEFT JOIN e USING (start, row_id, col_id), n GROUP BY ALL")
def mse_per_experiment(spark, d):
    t = fx.e(spark, d)
    return stats.mse_per_experiment(t, e_predicted(spark, d), t.select(*KEYS).distinct().count()).select("row_id", "col_id", r6("mse", "mse"))


PENALTY = " + ".join(f"sin(start * 0.1::DOUBLE * {k}) ** 2" for k in (1, 2, 3))


@query(f"WITH {SQL_E}, b AS (SELECT DISTINCT start FROM e) SELECT round(sum({PENALTY}), 6) AS factors2, round(sum((cos(start * 0.05::DOUBLE) * 0.1) ** 2), 6) AS bias2 FROM b")
def l2_penalty(spark, d):
    return stats.penalty(fx.bins3(fx.e(spark, d))).select(r6("factors2", "factors2"), r6("bias2", "bias2"))


@query(f"""WITH {E_PRED}, {E_SPLIT}, x AS (SELECT sum((predicted - value) ** 2) AS sse FROM e JOIN p USING (start, row_id, col_id) JOIN s USING (row_id, col_id) WHERE split = 'train'),
ra AS (SELECT sum({" + ".join(f"(sin(r * {k} + 0.5) * 0.3) ** 2" for k in (1, 2, 3))}) AS f, sum((r * 0.01) ** 2) AS b FROM range(20) a(r)),
ca AS (SELECT sum({" + ".join(f"(cos(c * {k} + 0.25) * 0.3) ** 2" for k in (1, 2, 3))}) AS f, sum((c * 0.02) ** 2) AS b FROM range(5) a(c)),
ba AS (SELECT sum({PENALTY}) AS f, sum((cos(start * 0.05::DOUBLE) * 0.1) ** 2) AS b FROM (SELECT DISTINCT start FROM e))
SELECT round(sse + 0.5 * ra.f + 0.25 * ra.b + 0.1 * ca.f + 0.2 * ca.b + 0.01 * ba.f + 0.02 * ba.b, 6) AS objective FROM x, ra, ca, ba""")
def objective(spark, d):
    t = fx.e(spark, d)
    rows, cols = fx.axes3(spark, *E_SHAPE)
    sse = stats.mse_by_split(t, e_predicted(spark, d), fx.splits(spark, *E_SHAPE)).where("split = 'train'").select("sse")
    weights = {"rc": 0.5, "rbc": 0.25, "ra": 0.1, "rba": 0.2, "ri": 0.01, "rbi": 0.02}
    return stats.objective(sse, *(stats.penalty(x) for x in (rows, cols, fx.bins3(t))), weights).select(r6("objective", "objective"))


#: An error for each bin of E in order: that of the predictions there.
TRACE = f"""{E_PRED}, er AS (SELECT start, round(avg((predicted - value) ** 2), 9) AS error FROM e JOIN p USING (contig, start, row_id, col_id) GROUP BY start),
tr AS (SELECT row_number() OVER (ORDER BY start) - 1 AS i, error FROM er)"""


@query(f"""WITH {TRACE}, pt AS (SELECT e.i AS iter, k, tr.error + CASE WHEN k < 5 THEN 0 ELSE 0.00001::DOUBLE END AS e FROM tr e, range(12) x(k), tr WHERE e.i >= 11 AND (k < 5 OR k >= 7) AND tr.i = e.i - 11 + k),
rk AS (SELECT iter, k, rank() OVER (PARTITION BY iter ORDER BY e) + (count(*) OVER (PARTITION BY iter, e) - 1) / 2.0::DOUBLE AS r FROM pt)
SELECT CAST(iter AS BIGINT) AS iter, round((sum(r) - 27.5) / sqrt(25 * 11 / 12.0::DOUBLE), 6) AS z FROM rk WHERE k < 5 GROUP BY iter""")
def trace_windows(spark, d):
    met = fx.e(spark, d).join(e_predicted(spark, d), [*KEYS, *tensor.CELL])
    per_bin = met.groupBy(*KEYS).agg(F.round(F.avg(F.pow(F.col("predicted") - F.col("value"), 2)), 9).alias("error"))
    trace = tensor.with_ordinal(per_bin, into="iter").select("iter", "error")
    return stats.trace_windows(trace, 5, 2, 1e-5).select(F.col("iter").cast("long").alias("iter"), r6("z", "z"))


# --- several models ---

PHASES = (0.0, 0.7, 1.9)
MODELS = f"{SQL_E}, " + ", ".join(sql_predicted("e", 20, 5, f"p{i}", p) for i, p in enumerate(PHASES)) + ", u AS (" + " UNION ALL ".join(f"SELECT *, {i} AS model FROM p{i}" for i in range(3)) + ")"
USED = "(row_id + col_id + model) % 3"


def models(spark, d) -> list[DataFrame]:
    return [e_predicted(spark, d, p) for p in PHASES]


@query(f"WITH {MODELS} SELECT contig, start, row_id, col_id, round(sum(predicted), 6) AS predicted FROM u GROUP BY ALL")
def model_sum(spark, d):
    return cells(impute.model_sum(models(spark, d)), "predicted")


@query(f"WITH {MODELS} SELECT contig, start, row_id, col_id, round(sum(predicted) / 3, 6) AS predicted FROM u GROUP BY ALL")
def model_average(spark, d):
    return cells(impute.model_average(models(spark, d)), "predicted")


@query(f"WITH {MODELS} SELECT contig, start, row_id, col_id, round(coalesce(avg(predicted) FILTER ({USED} = 2 AND col_id <> 4), 0), 6) AS predicted FROM u GROUP BY ALL")
def heldout_average(spark, d):
    """A model counts for the cells it held out; cells of the last column were never held out."""
    k = (F.col("row_id") + F.col("col_id") + F.col("model")) % 3
    plane = fx.plane(spark, *E_SHAPE).crossJoin(spark.range(3).select(F.col("id").cast("int").alias("model")))
    splits = plane.withColumn("split", F.when((k == 0) | (F.col("col_id") == 4), F.lit("train")).when(k == 1, F.lit("valid")).otherwise(F.lit("test")))
    return cells(impute.heldout_average(impute.united(models(spark, d)), splits), "predicted")


@query(f"WITH {MODELS} SELECT contig, start, row_id, col_id, round(avg(predicted) FILTER (CASE WHEN (row_id + col_id) % 4 = 3 THEN true ELSE (row_id + col_id) % 4 = model END), 6) AS predicted FROM u GROUP BY ALL")
def fold_aware_average(spark, d):
    plane = fx.plane(spark, *E_SHAPE).withColumn("fold", (F.col("row_id") + F.col("col_id")) % 4).where("fold < 3")
    pred = impute.united(models(spark, d)).withColumn("test_fold", F.col("model"))
    return cells(impute.fold_aware_average(pred, plane, plane), "predicted")


# --- quality metrics ---

PAIRS = f"""{SQL_E}, {sql_predicted("e", 20, 5)}, {sql_predicted("e", 20, 5, "a", 0.7)},
x AS (SELECT p.row_id || ':' || p.col_id AS exp, p.contig, p.start, greatest(coalesce(value, 0), 0) AS o, greatest(p.predicted, 0) AS p, greatest(a.predicted, 0) AS alt
      FROM p JOIN a USING (start, row_id, col_id) LEFT JOIN e USING (start, row_id, col_id)),
r0 AS (SELECT *, count(*) OVER (PARTITION BY exp) AS n,
  row_number() OVER (PARTITION BY exp ORDER BY o DESC, start) AS po, row_number() OVER (PARTITION BY exp ORDER BY p DESC, start) AS pp, row_number() OVER (PARTITION BY exp ORDER BY alt DESC, start) AS pa,
  rank() OVER (PARTITION BY exp ORDER BY o) + (count(*) OVER (PARTITION BY exp, o) - 1) / 2.0::DOUBLE AS ro,
  rank() OVER (PARTITION BY exp ORDER BY p) + (count(*) OVER (PARTITION BY exp, p) - 1) / 2.0::DOUBLE AS rp FROM x),
r AS (SELECT *, round(n * 0.01::DOUBLE) AS k1, round(n * 0.05::DOUBLE) AS k5 FROM r0)"""


def _auc(rank: str, positive: str) -> str:
    pos = f"sum(CASE WHEN {positive} THEN 1.0::DOUBLE ELSE 0 END)"
    neg = f"sum(CASE WHEN {positive} THEN 0 ELSE 1.0::DOUBLE END)"
    return f"(sum(CASE WHEN {positive} THEN {rank} ELSE 0 END) - {pos} * ({pos} + 1) / 2) / nullif({pos} * {neg}, 0)"


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


METRICS = {
    "mse_global": ("mseglobal", "avg((o - p) ** 2)"),
    "mse_top1obs": ("mse1obs", "avg((o - p) ** 2) FILTER (po <= k1)"),
    "mse_top1imp": ("mse1imp", "avg((o - p) ** 2) FILTER (pp <= k1)"),
    "mse_top1alt": ("mse1altimp", "avg((o - p) ** 2) FILTER (pa <= k1)"),
    "mse_top1altprecision": ("mse1altimprecip", "avg((o - alt) ** 2) FILTER (pp <= k1)"),
    "pearson_asinh": ("gwcorrasinh", _corr("o", "p")),
    "spearman": ("gwspcorr", _corr("ro", "rp")),
    "pearson_raw": ("gwcorr", _corr("sinh(o)", "sinh(p)")),
    "match1": ("match1", "count(*) FILTER (po <= k1 AND pp <= k1) / max(k1)"),
    "catch1obs": ("catch1obs", "count(*) FILTER (po <= k1 AND pp <= k5) / max(k1)"),
    "catch1imp": ("catch1imp", "count(*) FILTER (pp <= k1 AND po <= k5) / max(k1)"),
    "auc_obs": ("aucobs1", _auc("rp", "po <= k1")),
    "auc_imp": ("aucimp1", _auc("ro", "pp <= k1")),
}


def e_ranked(spark, d) -> DataFrame:
    return metrics.ranked(metrics.paired(fx.e(spark, d), e_predicted(spark, d), e_predicted(spark, d, 0.7)))


def _metric(name: str, column: str, sql: str) -> None:
    def run(spark, d):
        return metrics.metrics(e_ranked(spark, d)).select("exp", r6(column, column))

    QUERIES[f"metric_{name}"] = run
    SQL[f"metric_{name}"] = f"WITH {PAIRS} SELECT exp, round({sql}, 6) AS {column} FROM r GROUP BY exp"


for _name, (_column, _sql) in METRICS.items():
    _metric(_name, _column, _sql)


def sql_p_value(r: str) -> str:
    """Two-sided p-value of a correlation by the finite series of the t distribution, which has one for even and one for odd
    degrees of freedom. k!, (2k)! and so on by lgamma."""
    even = f"abs({r}) * coalesce(list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow(1 - {r} * {r}, k))), 0)"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: exp(2 * lgamma(k + 1) + k * ln(4) - lgamma(2 * k + 2)) * pow(1 - {r} * {r}, k + 0.5))), 0))"
    return f"CASE WHEN {r} IS NULL OR n < 3 THEN NULL WHEN n % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"


@query(f"""WITH {PAIRS}, m AS (SELECT exp, n, {', '.join(f'{s} AS {c}' for c, s in METRICS.values())} FROM r GROUP BY exp, n)
SELECT exp, n, {', '.join(f'round({c}, 6) AS {c}' for c, _ in METRICS.values())}, {', '.join(f"round({sql_p_value(c)}, 6) + 0.0 AS {c}_p" for c in metrics.CORRELATIONS)} FROM m""")
def metric_table(spark, d):
    """All metrics of an experiment in one pass, correlations with their p-values."""
    table = metrics.with_p_values(metrics.metrics(e_ranked(spark, d)))
    return table.select("exp", "n", *(r6(c, c) for c, _ in METRICS.values()), *(r6(f"{c}_p", f"{c}_p") for c in metrics.CORRELATIONS))


@query(f"WITH {PAIRS} SELECT exp, round({_auc('rp', 'start % 9 = 0')}, 6) AS catchpeakobs FROM r GROUP BY exp")
def metric_auc_flag(spark, d):
    """The class comes from intervals that bins overlap: every ninth bin."""
    r = e_ranked(spark, d)
    regions = r.select("contig", "start").distinct().where("start % 9 = 0").select("contig", "start", (F.col("start") + 1).alias("end"))
    bins = r.select("contig", "start").distinct().withColumn("end", F.col("start") + 1)
    flags = intervals.flagged(bins, regions).select(*KEYS, "flag")
    return metrics.metrics(r.join(flags, KEYS)).select("exp", r6("catchpeakobs", "catchpeakobs"))


# --- export ---


@query(f"WITH {E_PRED} SELECT contig, start, start + 1 AS \"end\", row_id, col_id, printf('%.8e', sinh(greatest(predicted, 0))) AS value FROM p")
def bedgraph_rows(spark, d):
    return sinks.track_rows(e_predicted(spark, d), 1).select("contig", "start", "end", "row_id", "col_id", "value")


@query("""SELECT row_name, col_name, 'track type=bigWig maxHeightPixels=50 name=' || row_name || '.' || col_name || '.imp.bw visibility=full color=' || CASE WHEN col_name = 'DNase' THEN '255,140,0' ELSE '80,80,80' END
|| ' bigDataUrl=http://tracks.example.org/' || replace(row_name, ' ', '%20') || '.' || replace(col_name, '#', '%23') || '.imp.bw' AS line
FROM (SELECT n_name AS row_name, b AS col_name FROM nation, (SELECT DISTINCT p_brand AS b FROM part UNION ALL SELECT 'DNase'))""")
def track_lines(spark, d):
    names = fx.brands(spark, d).select(F.col("p_brand").alias("col_name")).unionAll(spark.range(1).select(F.lit("DNase")))
    return sinks.track_lines(fx.table(spark, d, "nation").select(F.col("n_name").alias("row_name")).crossJoin(F.broadcast(names)), "http://tracks.example.org")


@query(f"""WITH {E_PRED} SELECT contig, start, row_id, col_id, round(predicted, 6) AS predicted FROM p WHERE start >= 10 AND start + 1 <= 100""")
def bounds_filter(spark, d):
    bounds = spark.range(1).select(F.lit("e").alias("contig"), F.lit(10).cast("long").alias("start"), F.lit(100).cast("long").alias("end"))
    return cells(intervals.contained(e_predicted(spark, d).withColumn("end", F.col("start") + 1), bounds), "predicted")


@query(f"WITH {SQL_E} SELECT contig, start, row_id, col_id, CAST((row_number() OVER (ORDER BY contig, start, row_id, col_id) - 1) // 500 AS BIGINT) AS part FROM e")
def text_part_ids(spark, d):
    return sinks.part_ids(fx.e(spark, d), 500, [*KEYS, "row_id", "col_id"]).select(*KEYS, "row_id", "col_id", "part")
