"""Readers. Paths may hold globs; gzip is read as it is."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacunar.functions.scalar import missing_as_zero, part_number
from lacunar.operators import intervals, tensor

from .shared import exists

def track(spark: SparkSession, path: str) -> DataFrame:
    """bedGraph text: contig, start, end, value; '.' and NaN read 0. Track and browser lines and comments are no data."""
    return _track_rows(spark.read.text(path)).select("contig", "start", "end", "value")


def _track_rows(lines: DataFrame) -> DataFrame:
    """Columns of bedGraph lines next to the others of `lines`."""
    parts = F.split("value", r"\s+")
    rows = lines.where(~F.col("value").rlike(r"^(track|browser)\s|^(track|browser)$|^#|^\s*$"))
    others = [c for c in lines.columns if c != "value"]
    return rows.select(*others, parts[0].alias("contig"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"), missing_as_zero(F.get(parts, 3)).alias("value"))


def intervals_of(spark: SparkSession, path: str) -> DataFrame:
    """BED text: the first three columns."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).where(F.col("value") != "").select(parts[0].alias("contig"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"))


def peaks(spark: SparkSession, path: str) -> DataFrame:
    """narrowPeak text: as BED, with the signal value of its seventh column."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.col("value") != "").select(parts[0].alias("contig"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"), F.get(parts, 6).try_cast("double").alias("signal"))


def file_map(spark: SparkSession, path: str) -> DataFrame:
    """Lines "url row column", white space between: (url, row_name, col_name)."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("url"), parts[1].alias("row_name"), parts[2].alias("col_name"))


def _packed(lines: DataFrame) -> DataFrame:
    parts = F.split("value", r"\s+", 4)
    return lines.where(F.col("value") != "").select(*(c for c in lines.columns if c != "value"), parts[0].alias("contig"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"), F.trim(parts[3]).alias("packed"))


#: Where the index of a folder of parts lies. Spark's readers pass over names that begin so.
INDEX = "_regions"


def index_parts(spark: SparkSession, path: str) -> DataFrame:
    """Writes and returns the index of a folder of assembled lines: (file, contig, start, end), where each part's lines of a
    contig lie. One pass; a row for each part and contig. Parts that are added later need a new index."""
    lines = _packed(spark.read.text(path).select("value", F.input_file_name().alias("file")))
    lines.groupBy("file", "contig").agg(F.min("start").alias("start"), F.max("end").alias("end")).write.mode("overwrite").parquet(f"{path}/{INDEX}")
    return spark.read.parquet(f"{path}/{INDEX}")


def packed_lines(spark: SparkSession, path: str, regions: DataFrame | None = None) -> DataFrame:
    """Assembled lines "contig start end v1|v2|...", with `regions` those that overlap one, once each however many they
    overlap. If the folder has an index (index_parts()), only parts that a region meets are planned and read. The region
    filter comes before the values are split."""
    if regions is None:
        return _packed(spark.read.text(path))
    wanted = regions.select("contig", "start", "end")
    if exists(spark, f"{path}/{INDEX}/_SUCCESS"):
        met = intervals.overlapping(spark.read.parquet(f"{path}/{INDEX}"), wanted).select("file").distinct()
        files = [r["file"] for r in met.collect()]  # paths of parts alone
        if not files:
            return _packed(spark.createDataFrame([], "value string"))
        return intervals.overlapping(_packed(spark.read.text(files)), wanted)
    return intervals.overlapping(_packed(spark.read.text(path)), wanted)


def numbered_parts(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the number of the part they come from and their place in it, for positional joins of part lists."""
    rows = spark.read.text(path).select("value", part_number(F.input_file_name()).alias("part"), F.monotonically_increasing_id().alias("_i"))
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("part").orderBy("_i")) - 1).drop("_i")


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two numbered part lists line by line; raises if their numbers of parts differ."""
    if a.select("part").distinct().count() != b.select("part").distinct().count():
        raise ValueError("the part lists differ in length")
    return a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), ["part", "line"])


def load_tensor(spark: SparkSession, path: str, fraction: float | None = None, seed: int = 20, undo_asinh: bool = False) -> DataFrame:
    """A stored tensor: an optional sample of its bins, optionally off the asinh scale, missing values scrubbed."""
    t = spark.read.parquet(path)
    if fraction is not None:
        t = tensor.sampled(t, fraction, seed)
    if undo_asinh:
        t = tensor.with_sinh(t)
    return tensor.scrub(t)


def load(spark: SparkSession, path: str, form: str = "parquet", slots: DataFrame | None = None, n_slots: int | None = None) -> DataFrame:
    """A tensor's cells in any of the formats there are: `parquet` (cells), `packed` (assembled lines, whose slots are
    given) or `csv` (cells with a header)."""
    if form == "parquet":
        return load_tensor(spark, path)
    if form == "csv":
        return tensor.scrub(spark.read.csv(path, header=True, schema="contig string, start bigint, row_id int, col_id int, value double"))
    if form == "packed":
        return tensor.unpacked_text(packed_lines(spark, path), slots, n_slots or slots.count(), ["contig", "start"])
    raise ValueError(f"unknown format: {form}")


def assemble(spark: SparkSession, files: DataFrame, windows: DataFrame) -> DataFrame:
    """The tensor of all tracks of a file map over fixed windows, on the asinh scale: each track's means per window.

    All tracks are one scan: a line's file name, looked up in the map, says which row and column it belongs to, and the
    windows are joined once. An entry that names no file as the reader names it (a glob, say) is an error, as its experiment
    would be missing without a word."""
    ids = tensor.catalogue(files).select("url", "row_id", "col_id")
    urls = [r["url"] for r in ids.select("url").collect()]  # one per track file
    if not urls:
        return spark.createDataFrame([], "contig string, start bigint, row_id int, col_id int, value double")
    name = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/*", "/")
    lines = spark.read.text(urls).select("value", F.url_decode(F.regexp_replace(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")), r"^[a-z0-9]+:/*", "/")).alias("file"))
    known = ids.select(name(F.col("url")).alias("file"), "row_id", "col_id")
    read = {unquote(re.sub(r"^[a-z0-9]+:/*", "/", f)) for f in lines.inputFiles()}  # a listing, not a scan
    if lost := sorted({r["file"] for r in known.select("file").collect()} - read):
        raise ValueError(f"entries of the file map that name no file as it is read: {lost[:5]}")
    rows = _track_rows(lines).join(F.broadcast(known), "file")
    met = intervals.overlaps(windows.select("contig", "start", "end"), rows.select("contig", "start", "end", "value", "row_id", "col_id"))
    means = met.groupBy("contig", "start", F.col("b_row_id").alias("row_id"), F.col("b_col_id").alias("col_id")).agg(F.asinh(F.avg("b_value")).alias("value"))
    return tensor.scrub(means)
