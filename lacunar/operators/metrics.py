"""Quality of predicted tracks, per experiment, all distributed: ranks, then one aggregate.

Experiments of at most `window_rows` bins are ranked by windows, each in one task. With a larger one all are put in order
by range partitions, which cut through experiments: a row's place is its number in the whole order less its
experiment's first, and ties are averaged from their counts.

Input rows: exp, the bin keys, o (observed), p (predicted), optionally alt (another prediction). NaN and negative values
read 0 on both sides, and so do missing ones. The top 1 % and 5 % are by value, then by the bin's order.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacunar.functions.scalar import clamp
from lacunar.sources.shared import cut

from .tensor import CELL, KEYS, with_ordinal
from .tensor import plane as _plane


def paired(observed: DataFrame, predicted: DataFrame, alt: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Cells of the predicted experiments with what was observed: exp is row_id:col_id. observed: value; the others: predicted."""
    out = predicted.withColumnRenamed("predicted", "p").join(observed.select(*keys, *CELL, F.col("value").alias("o")), [*keys, *CELL], "left")
    if alt is not None:
        out = out.join(alt.select(*keys, *CELL, F.col("predicted").alias("alt")), [*keys, *CELL], "left")
    values = [c for c in ("o", "p", "alt") if c in out.columns]
    return out.select(F.concat_ws(":", *CELL).alias("exp"), *keys, *(clamp(F.col(c)).alias(c) for c in values))


def average_rank(value: str, by: str = "exp") -> Column:
    """Rank from 1, ties at their mean."""
    return F.rank().over(Window.partitionBy(by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(by, value)) - 1) / F.lit(2.0)


def ranked(pairs: DataFrame, keys: list[str] = KEYS, window_rows: int = 1 << 20) -> DataFrame:
    """Adds n, the top percentile sizes k1 and k5, descending places po and pp (and pa), average ranks ro and rp."""
    pairs = cut(pairs)
    sizes = cut(pairs.groupBy("exp").agg(F.count(F.lit(1)).alias("n")))  # one row per cell of the plane
    small = (sizes.agg(F.max("n")).first()[0] or 0) <= window_rows
    out = pairs.join(_plane(sizes), "exp").withColumns({"k1": F.round(F.col("n") * 0.01).cast("long"), "k5": F.round(F.col("n") * 0.05).cast("long")})
    values = {"po": ("o", "ro"), "pp": ("p", "rp")} | ({"pa": ("alt", None)} if "alt" in pairs.columns else {})
    if not small:
        for place, (value, rank) in values.items():
            out = _placed(out, keys, value, place, rank)
        return out
    for place, (value, _) in values.items():
        out = out.withColumn(place, F.row_number().over(Window.partitionBy("exp").orderBy(F.col(value).desc(), *keys)))
    return out.withColumns({"ro": average_rank("o"), "rp": average_rank("p")})


def _placed(df: DataFrame, keys: list[str], value: str, place: str, rank: str | None) -> DataFrame:
    """Adds the descending place of a value in its experiment and, on request, its average rank, by range partitions."""
    order = [F.col("exp"), F.col(value).desc(), *map(F.col, keys)]
    numbered = with_ordinal(df, order, "_at")
    firsts = numbered.groupBy("exp").agg(F.min("_at").alias("_first"))
    out = numbered.join(_plane(firsts), "exp").withColumn(place, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")
    if not rank:
        return out
    tied = cut(out.groupBy("exp", value).agg(F.count(F.lit(1)).alias("_times"), F.max(place).alias("_last")).where("_times > 1"))
    return out.join(tied, ["exp", value], "left").withColumn(rank, F.col("n") + 1 - F.coalesce(F.col("_last") - (F.col("_times") - 1) / F.lit(2.0), F.col(place).cast("double"))).drop("_times", "_last")


def _square(a: str, b: str) -> Column:
    return F.pow(F.col(a) - F.col(b), 2)


def auc(rank: Column, positive: Column) -> Column:
    """Area under the ROC curve from average ranks of the score; null without both classes."""
    pos = F.sum(F.when(positive, F.lit(1.0)).otherwise(F.lit(0.0)))
    neg = F.sum(F.when(positive, F.lit(0.0)).otherwise(F.lit(1.0)))
    return (F.sum(F.when(positive, rank.cast("double")).otherwise(F.lit(0.0))) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; null if either side is constant, where the built-in function fails under ANSI rules."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def metrics(r: DataFrame) -> DataFrame:
    """All metrics of ranked(); with a column flag (0 or 1) also catchpeakobs, with alt the two of the alternative."""
    o1, p1, o5, p5 = (F.col(a) <= F.col(b) for a, b in (("po", "k1"), ("pp", "k1"), ("po", "k5"), ("pp", "k5")))
    share = lambda both: F.sum(both.cast("double")) / F.nullif(F.max("k1").cast("double"), F.lit(0.0))
    out = {
        "mseglobal": F.avg(_square("o", "p")),
        "mse1obs": F.avg(F.when(o1, _square("o", "p"))),
        "mse1imp": F.avg(F.when(p1, _square("o", "p"))),
        "gwcorrasinh": correlation(F.col("o"), F.col("p")),
        "gwspcorr": correlation(F.col("ro"), F.col("rp")),
        "gwcorr": correlation(F.sinh("o"), F.sinh("p")),
        "match1": share(o1 & p1),
        "catch1obs": share(o1 & p5),
        "catch1imp": share(p1 & o5),
        "aucobs1": auc(F.col("rp"), o1),
        "aucimp1": auc(F.col("ro"), p1),
    }
    if "alt" in r.columns:
        out |= {"mse1altimp": F.avg(F.when(F.col("pa") <= F.col("k1"), _square("o", "p"))), "mse1altimprecip": F.avg(F.when(p1, _square("o", "alt")))}
    if "flag" in r.columns:
        out |= {"catchpeakobs": auc(F.col("rp"), F.col("flag") == 1)}
    return r.groupBy("exp").agg(F.max("n").alias("n"), *(c.alias(k) for k, c in out.items()))


#: The metrics that come with a p-value.
CORRELATIONS = ("gwcorrasinh", "gwspcorr", "gwcorr")


def with_p_values(table: DataFrame) -> DataFrame:
    """The table of metrics with <correlation>_p next to its correlations. As long as the plane, it passes through
    Python in Arrow batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, more = b.column("n").to_pylist(), []
            for name in CORRELATIONS:
                more.append(pa.array([correlation_p_value(r, k) for r, k in zip(b.column(name).to_pylist(), n, strict=True)], pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *(f"{c}_p" for c in CORRELATIONS)])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in table.dtypes), *(f"{c}_p double" for c in CORRELATIONS)])
    return table.mapInArrow(each, schema)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def correlation_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation by the t distribution with n - 2 degrees of freedom."""
    if r is None or r != r or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0
    if x == 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
