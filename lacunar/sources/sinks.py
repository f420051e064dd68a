"""Writers: text parts, tracks, models, traces and run records."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.functions.scalar import clamp, colour_of, track_line
from lacunar.operators import intervals, tensor
from lacunar.operators.model import Axes


def part_ids(df: DataFrame, lines_per_part: int, keys: list[str]) -> DataFrame:
    """The part each line falls in when every part holds `lines_per_part` lines, in the order of `keys`."""
    return tensor.with_ordinal(df, keys).withColumn("part", F.floor(F.col("ordinal") / lines_per_part)).drop("ordinal")


def write_parts(df: DataFrame, path: str, lines_per_part: int, keys: list[str] | None = None) -> None:
    """Gzip text parts of exactly `lines_per_part` lines of the column `line`, but for the last, a folder part=N each, in
    the order of `keys` (by default the line itself)."""
    numbered = tensor.with_ordinal(df, keys or ["line"]).withColumn("part", F.floor(F.col("ordinal") / lines_per_part))
    ordered = numbered.repartition("part").sortWithinPartitions("part", "ordinal")
    ordered.select("part", "line").write.partitionBy("part").option("compression", "gzip").text(path)


def publish_catalogue(experiments: DataFrame, slots: DataFrame, path: str) -> None:
    experiments.write.parquet(f"{path}/catalogue")
    slots.write.parquet(f"{path}/slots")


def value_text(value: Column) -> Column:
    return F.format_string("%.8e", value)


def track_rows(predicted: DataFrame, window: int, undo_asinh: bool = True, value: str = "predicted") -> DataFrame:
    """(contig, start, end, row_id, col_id, value): negative values 0, then off the asinh scale, as '%.8e'."""
    v = clamp(F.col(value))
    return predicted.select("contig", "start", (F.col("start") + window).alias("end"), "row_id", "col_id", value_text(F.sinh(v) if undo_asinh else v).alias("value"))


def write_tracks(rows: DataFrame, names: DataFrame, bounds: DataFrame | None, path: str, mode: str = "errorifexists") -> None:
    """Sorted bedGraph text, one folder per row and column name; windows not wholly inside `bounds` are left out. A track
    is cut into files by range of its bins, whose names are in order, so no track is written by one task.
    Fails if the path exists, unless `mode` is append. names: (row_id, col_id, row_name, col_name)."""
    inside = rows if bounds is None else intervals.contained(rows, bounds)
    named = inside.join(tensor.plane(names), tensor.CELL)
    order = ["row_name", "col_name", "contig", "start"]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("row_name", "col_name", "contig", "start", "end", "value").write.mode(mode).partitionBy("row_name", "col_name").csv(path, sep="\t")


def export(predicted: DataFrame, names: DataFrame, bounds: DataFrame | None, window: int, path: str, base_url: str, batches: int = 1, undo_asinh: bool = True, kind: str = "imp") -> None:
    """Predictions to a folder of tracks and their track lines: coordinates, values and bounds as in track_rows() and
    write_tracks(). With `batches` the contigs are dealt over as many appends, so that fewer rows are sorted at a time.
    Fails if the folder exists."""
    spark = predicted.sparkSession
    track_lines(names, base_url, kind).select("line").coalesce(1).write.mode("errorifexists").text(f"{path}/lines")
    rows = track_rows(predicted, window, undo_asinh)
    for k in range(batches):
        some = rows if batches == 1 else rows.where(F.pmod(F.xxhash64("contig"), F.lit(batches)) == k)
        write_tracks(some, names, bounds, f"{path}/tracks", "append" if k else "errorifexists")
    spark.createDataFrame([(kind, base_url, window)], "kind string, base_url string, window int").coalesce(1).write.json(f"{path}/export")


def track_lines(names: DataFrame, base_url: str, kind: str = "imp") -> DataFrame:
    """A track line per (row_name, col_name)."""
    file = F.concat_ws(".", "row_name", "col_name", F.lit(kind), F.lit("bw"))
    return names.select("row_name", "col_name", track_line(file, colour_of(F.col("col_name")), F.concat(F.lit(base_url + "/"), file)).alias("line"))


def write_trace(spark: SparkSession, trace: list[tuple], path: str) -> None:
    """Tab-separated errors by iteration."""
    spark.createDataFrame(trace, "iter int, objective double, train double, valid double, test double").coalesce(1).sortWithinPartitions("iter").write.mode("overwrite").csv(path, sep="\t", header=True)


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").csv(path, sep="\t", header=True)


def save_model(axes: Axes, bins: DataFrame, settings: dict, path: str, parents: tuple[str, ...] = ()) -> None:
    """A model's folder: bin factors, both axes, and a one-row manifest with its settings and the models it came from."""
    spark = bins.sparkSession
    bins.write.parquet(f"{path}/bins")
    rows, cols = axes.frames(spark)
    rows.coalesce(1).write.parquet(f"{path}/rows")
    cols.coalesce(1).write.parquet(f"{path}/cols")
    spark.createDataFrame([(json.dumps({"mean": axes.mean, "settings": settings, "parents": parents}),)], "manifest string").coalesce(1).write.parquet(f"{path}/manifest")


#: What a model that was saved without a setting was trained with. Fixed values.
OLD_SETTINGS = {"rc": 2.88e-4, "ra": 5.145e-11, "ri": 9.358e-14, "rbc": 0.0, "rba": 0.0, "rbi": 0.0, "rate": 0.005}


def load_model(spark: SparkSession, path: str, with_parents: bool = False) -> dict:
    """axes, bins, settings (a parent's where the model has none of its own, else the old defaults) and, on request, the
    parents' models."""
    m = json.loads(spark.read.parquet(f"{path}/manifest").first()[0])
    axis = lambda name: sorted(spark.read.parquet(f"{path}/{name}").collect())
    r, c = axis("rows"), axis("cols")
    axes = Axes(np.array([x["factors"] for x in r]), np.array([x["bias"] for x in r]), np.array([x["factors"] for x in c]), np.array([x["bias"] for x in c]), m["mean"])
    parents = [load_model(spark, p, with_parents) for p in m["parents"]] if with_parents else []
    settings: dict = {}
    for p in parents:
        settings |= p["settings"]
    return {"axes": axes, "bins": spark.read.parquet(f"{path}/bins"), "settings": OLD_SETTINGS | settings | m["settings"], "parents": parents}


def record_run(spark: SparkSession, path: str, command: dict, restart: bool = False) -> None:
    """The command a run was started with; refuses to overwrite another run's unless it restarts."""
    spark.createDataFrame([(json.dumps(command, sort_keys=True),)], "command string").coalesce(1).write.mode("overwrite" if restart else "errorifexists").json(path)
