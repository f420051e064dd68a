"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Track colours by column name, and the colour of any other. Fixed values.
COLOURS = {
    "H3K27me3": "255,0,0",
    "H3K36me3": "0,0,255",
    "H3K4me3": "0,128,0",
    "H3K4me1": "154,205,50",
    "DNase": "255,140,0",
    "H3K27ac": "218,165,32",
    "H3K4me2": "89,190,121",
    "H3K9me3": "194,102,199",
    "H3K9ac": "77,49,129",
    "H2AZ": "163,165,77",
    "H3K79me2": "84,136,227",
    "H3K79me1": "201,116,39",
    "H4K20me1": "59,167,229",
    "H3K4ac": "181,61,49",
    "H4K8ac": "67,200,172",
    "H3K23ac": "138,46,124",
    "H3K18ac": "197,153,72",
    "H2BK5ac": "106,118,192",
    "H2BK120ac": "139,83,33",
    "H2AK5ac": "187,134,214",
    "H3K14ac": "225,131,94",
    "H2BK12ac": "219,119,185",
    "H4K91ac": "186,71,88",
    "H2BK15ac": "167,69,112",
}
OTHER_COLOUR = "80,80,80"


def observed(value: Column) -> Column:
    """Whether a value is there: null, NaN and 0 all mean missing."""
    return F.coalesce(~F.isnan(value) & (value != 0), F.lit(False))


def missing_as_zero(value: Column) -> Column:
    """'.' of text tracks, null and NaN read as 0."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def clamp(value: Column) -> Column:
    return F.greatest(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def flat_index(row_id: Column, col_id: Column, n_cols: int) -> Column:
    return row_id * n_cols + col_id


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sum_of_squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def decayed(start: float, t: Column, rate: float = 1e-6) -> Column:
    """start * (1 - rate) ** (t - 1): the learning rate and the first moment's decay at update t."""
    return F.lit(start) * F.pow(F.lit(1 - rate), t - 1)


def part_number(path: Column) -> Column:
    """The number in a part's file name, as sort key."""
    return F.regexp_extract(path, r"part-?(\d+)", 1).try_cast("int")


def strip_gz(path: Column) -> Column:
    return F.regexp_replace(path, r"\.gz$", "")


def url_parts(url: Column) -> Column:
    """Struct of scheme, bucket and key of an object-store URL."""
    part = lambda i: F.regexp_extract(url, r"^([a-z0-9]+)://([^/]+)/?(.*)$", i)
    return F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("key"))


def colour_of(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    return F.coalesce(F.element_at(table, name), F.lit(OTHER_COLOUR))


def track_line(file_name: Column, colour: Column, url: Column) -> Column:
    """A browser's track line; slashes of the URL's path stay as they are."""
    quoted = F.replace(F.replace(F.url_encode(url), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    quoted = F.regexp_replace(quoted, "^([a-z0-9]+)%3A", "$1:")
    return F.concat(F.lit("track type=bigWig maxHeightPixels=50 name="), file_name, F.lit(" visibility=full color="), colour, F.lit(" bigDataUrl="), quoted)
