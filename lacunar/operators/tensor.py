"""The sparse tensor as a DataFrame of observed cells: bin keys, row_id, col_id, value. A missing cell is a missing row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacunar.functions.scalar import clamp, observed
from lacunar.sources.shared import cut

#: What makes a bin.
KEYS = ["contig", "start"]
#: What makes a cell of the plane.
CELL = ["row_id", "col_id"]


#: The most rows a table of the plane (its cells, axes or experiments) may have to be sent to all executors, a few MB.
PLANE_ROWS = 1 << 17


def plane(df: DataFrame, rows: int = PLANE_ROWS) -> DataFrame:
    """A table of the plane for a join: broadcast after counting it, by a shuffle beyond `rows`."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dense_ids(names: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Sorted distinct names and their numbers from 0. For the axes, whose length is that of a catalogue."""
    return names.select(name_col).distinct().withColumn(id_col, (F.row_number().over(Window.orderBy(name_col)) - 1).cast("int"))


def catalogue(experiments: DataFrame, row_name: str = "row_name", col_name: str = "col_name") -> DataFrame:
    """Experiments with row_id and col_id."""
    rows, cols = dense_ids(experiments, row_name, "row_id"), dense_ids(experiments, col_name, "col_id")
    return experiments.join(plane(rows), row_name).join(plane(cols), col_name)


def from_measurements(df: DataFrame, keys: list[str], row: Column, col_name: str, value: Column, ids: DataFrame) -> DataFrame:
    """One cell per (bin, row, column): the mean of its measurements, column names numbered by `ids`."""
    cells = df.groupBy(*keys, row.cast("int").alias("row_id"), F.col(col_name)).agg(F.avg(value).alias("value"))
    return cells.join(plane(ids), col_name).select(*keys, "row_id", "col_id", "value")


def scrub(t: DataFrame) -> DataFrame:
    """Null, NaN and 0 dropped: they mean missing."""
    return t.where(observed(F.col("value")))


def with_asinh(t: DataFrame) -> DataFrame:
    return t.withColumn("value", F.asinh("value"))


def with_sinh(t: DataFrame) -> DataFrame:
    return t.withColumn("value", F.sinh("value"))


def centered(t: DataFrame, mean: float | Column) -> DataFrame:
    """The mean taken off stored values only, so that a missing cell still reads 0."""
    return t.withColumn("value", F.col("value") - mean)


def without_negatives(t: DataFrame) -> DataFrame:
    """Negative values become 0 and thereby missing."""
    return scrub(t.withColumn("value", clamp(F.col("value"))))


def shape(t: DataFrame) -> DataFrame:
    return t.agg((F.max("row_id") + 1).alias("n_rows"), (F.max("col_id") + 1).alias("n_cols"))


def counts(t: DataFrame, bins_per_slice: int, keys: list[str] = KEYS) -> DataFrame:
    """Bins, observed cells, and the slices of `bins_per_slice` bins they make."""
    per_bin = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_bin.agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n_observed"), F.ceil(F.count(F.lit(1)) / bins_per_slice).cast("long").alias("n_slices"))


def observed_pattern(t: DataFrame) -> DataFrame:
    return t.select(*CELL).distinct()


def merged(a: DataFrame, b: DataFrame, a_cols: DataFrame, b_cols: DataFrame, a_rows: int, keys: list[str] = KEYS) -> DataFrame:
    """Rows of `b` stacked under those of `a` at the bins both have; b's columns find a's by name, others are dropped.

    a_cols and b_cols: (col_name, col_id) of each."""
    to = b_cols.select("col_name", F.col("col_id").alias("_from")).join(a_cols.select("col_name", F.col("col_id").alias("_to")), "col_name")
    moved = b.join(plane(to), F.col("col_id") == F.col("_from")).select(*keys, (F.col("row_id") + a_rows).cast("int").alias("row_id"), F.col("_to").alias("col_id"), "value")
    both = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)
    return a.select(*keys, *CELL, "value").unionByName(moved).join(both, keys, "left_semi")


def merged_splits(splits: DataFrame, new_cells: DataFrame, a_rows: int) -> DataFrame:
    """Splits after a merge: every new cell trains."""
    return splits.unionByName(new_cells.select((F.col("row_id") + a_rows).cast("int").alias("row_id"), "col_id", F.lit("train").alias("split")))


def packed(t: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per bin with its cells in an array, as the solvers take them. A plane bounds an array's length."""
    return t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_id", "col_id", "value"))).alias("cells"))


def packed_text(t: DataFrame, slots: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per bin with the values of all slots joined by '|', missing ones as 0. slots: (slot, row_id, col_id)."""
    grid = t.select(*keys).distinct().crossJoin(F.broadcast(slots))
    full = grid.join(t, [*keys, *CELL], "left").withColumn("v", F.coalesce("value", F.lit(0.0)))
    per = full.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "v"))).alias("x"))
    return per.select(*keys, F.array_join(F.transform("x", lambda s: s["v"].cast("string")), "|").alias("packed"))


def unpacked_text(lines: DataFrame, slots: DataFrame, n_slots: int, keys: list[str] = KEYS) -> DataFrame:
    """Cells of packed lines, on the asinh scale. A line with another number of fields is an error; lines that sum to 0 vanish."""
    parts = F.split("packed", r"\|")
    checked = lines.select(*keys, F.when(F.size(parts) == n_slots, parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.size(parts).cast("string")))).alias("parts"))
    long = checked.select(*keys, F.posexplode("parts").alias("slot", "v")).withColumn("value", F.asinh(F.col("v").try_cast("double")))
    return scrub(long.join(plane(slots), "slot").select(*keys, *CELL, "value"))


def with_ordinal(df: DataFrame, keys: list[str | Column] = KEYS, into: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 in the order of `keys`, without gathering them: each range-partition counts its own rows, and
    only the counts, one a partition, reach the driver. The partitions are cut off first, as their bounds are sampled."""
    part, at = f"{into}__part", f"{into}__at"
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(at))
    ranged = cut(ranged)
    sizes = {r[part]: r["n"] for r in ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}
    begins, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        begins.append(str(total))
        total += sizes.get(k, 0)
    begin = F.get(F.split(F.lit(",".join(begins)), ",").cast("array<bigint>"), F.col(part))
    return ranged.withColumn(into, F.col(at) + begin if begins else F.lit(0).cast("long")).drop(part, at)


def halves(bins: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Bins with their ordinal and the half of the whole they fall in, 0 or 1."""
    numbered = with_ordinal(bins, keys)
    n = numbered.count()
    return numbered.withColumn("half", (F.col("ordinal") >= n // 2).cast("int"))


def every_nth(bins: DataFrame, n: int, seed: int = 0, keys: list[str] = KEYS) -> DataFrame:
    """A repeatable sample of a fraction 1 / n of the bins, by ordinal."""
    return with_ordinal(bins, keys).where(F.pmod(F.col("ordinal") + seed, F.lit(n)) == 0)


def sampled(t: DataFrame, fraction: float, seed: int, keys: list[str] = KEYS) -> DataFrame:
    """All cells of a Bernoulli sample of bins. The draw is a hash of the bin, so it repeats whatever the partitions."""
    scale = 1 << 30
    return t.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(scale)) < int(fraction * scale))


def partitioned(t: DataFrame, n: int, keys: list[str] = KEYS) -> DataFrame:
    """Bins dealt by hash to n partitions, sorted within each: one partition is one worker of the trainer."""
    return t.repartition(n, *keys).sortWithinPartitions(*keys)


def in_bins(t: DataFrame, bins: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cells of the bins (windows) that `bins` names, once each however often it names them."""
    return t.join(bins.select(*keys), keys, "left_semi")
