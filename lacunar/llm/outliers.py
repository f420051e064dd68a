"""Quality rules: documents whose statistics lie far from those of their language and source.

One pass over the texts counts what the rules need. The counts become a vector of shares on scales where ordinary texts
are near normal; of each group (language and source) a robust location and scatter are estimated by the minimum
covariance determinant, so that the junk in a group doesn't hide itself: from two robust starts, concentration steps
take the half of the rows nearest to the estimate (by Mahalanobis distance) and estimate anew, for all groups at once,
until no determinant falls any more; the lower one counts. Every step is an aggregate over all rows; of a group there
are only its moments and a histogram of distances, so no group meets in one task, however large.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

_WORDS, _SYMBOLS, _CAPITALS = re.compile("[^\x20\x09-\x0d]+"), re.compile("[#*$%&|<>]"), re.compile("[A-Z]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_doubled", "n_capitals"]


def repeated(ids: np.ndarray, window: int = 8) -> int:
    """Words, given as numbers from 0, that stand in a window of `window` words found twice or more, the first time
    included. Exact: windows get numbers by doubling, each half's number paired with the other's."""
    n, size = len(ids), 1
    while size < window:
        step = min(size, window - size)
        if n < size + step + 1:
            return 0
        ids = np.unique(ids[: len(ids) - step] * (n + 1) + ids[step:], return_inverse=True)[1]
        size += step
        if ids.max() + 1 == len(ids):  # all differ, and so do longer windows
            return 0
    often = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(often)] += often
    edge[window : window + len(often)] -= often
    return int((np.cumsum(edge) > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; null has none. n_lines are lines with a word, n_doubled words equal to the one before."""
    text = text or ""
    words = _WORDS.findall(text)
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated(ids), len(lines), int((ids[1:] == ids[:-1]).sum()), len(_CAPITALS.findall(text))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id bigint, lang, source, COUNTS bigint) of every row, one pass over the texts."""
    held = ["id", "lang", "source"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([count_text(t.as_py()) for t in b.column(3).cast(pa.large_string())], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c) for c in found.T)], [*held, *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


#: The vector: word length on a logarithmic scale, then square roots of shares, which steadies their variance. With each
#: the spread below which differences mean nothing: what is rare in ordinary text has a scatter of next to zero.
VECTOR = {
    "x0": (lambda c: F.log(c("word_chars") / c("n_words")), 0.04),
    "x1": (lambda c: F.sqrt(c("n_symbols") / c("n_words")), 0.10),
    "x2": (lambda c: F.sqrt(c("n_dup_lines") / c("n_lines")), 0.15),
    "x3": (lambda c: F.sqrt(c("n_repeat_words") / c("n_words")), 0.13),
    "x4": (lambda c: F.sqrt(c("n_doubled") / c("n_words")), 0.10),
    "x5": (lambda c: F.sqrt(c("n_capitals") / c("word_chars")), 0.03),
}
DIM = len(VECTOR)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
#: Of the chi-squared distribution with DIM = 6 degrees of freedom: what makes the scatter of the nearest half that of
#: all, the 0.975 quantile, what makes the scatter within it that of all, and the 0.99999 quantile. Fixed values.
HALF, NEAR, NEAR_SCALE, CUTOFF = 1.79, 14.45, 1.10, 33.1
BINS = 1024  # of a histogram, for each doubling of the distance: few rows share the bin at which the half is cut
GRID = 256  # steps of a coordinate, for medians


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: The most groups whose estimates (2 starts of 400 bytes) are sent to all executors; more are joined by a shuffle.
GROUPS = 1 << 15


def _sent(df: DataFrame, small: bool) -> DataFrame:
    """A table of a row or two a group, for a join; `small` says that there are at most GROUPS groups."""
    return F.broadcast(df) if small else df


def grouped(rows: DataFrame, least: int = 100) -> tuple[DataFrame, bool]:
    """The rows with gid, and whether there are few groups. gid is the group that a row's scatter is estimated in. That is its language and source if `least` rows passed the
    base rules there; else all such small groups of the language together, else those of all languages; else null."""
    sizes = store(rows.where(~base_failed()).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "groups")
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    by_lang = sizes.where(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("m")).select(F.col("lang").alias("_l"), "m")
    rest = by_lang.where(F.col("m") < least).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("k"))
    named = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("_l")), "left").crossJoin(F.broadcast(rest))  # one row
    gid = F.when(F.col("n") >= least, name("lang", "source")).when(F.col("m") >= least, name("lang")).when(F.col("k") >= least, F.lit("{}"))
    of = named.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), gid.alias("gid"))
    small = sizes.count() <= GROUPS
    return rows.join(_sent(of, small), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source"), small


def _medians(x: DataFrame, of: dict[str, Column]) -> DataFrame:
    """(gid, and for each name the median of its column): from a histogram with GRID steps a unit, so that any partitions
    give the same."""
    bins = x.select("gid", F.posexplode(F.array(*(F.floor(c * GRID) for c in of.values())))).groupBy("gid", "pos", "col").agg(F.count(F.lit(1)).alias("n"))
    at = bins.groupBy("gid", "pos").agg(F.array_sort(F.collect_list(F.struct("col", "n"))).alias("h"), F.sum("n").alias("all"))
    middle = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("bigint").alias("at")), lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.coalesce(a["at"], F.when(2 * (a["n"] + b["n"]) >= F.col("all"), b["col"])).alias("at")))["at"]
    return at.groupBy("gid").pivot("pos", list(range(len(of)))).agg(F.first((middle + 0.5) / GRID)).select("gid", *(F.col(f"`{k}`").alias(n) for k, n in enumerate(of)))


def _moments(x: DataFrame) -> DataFrame:
    """(gid, start, n, s, ss): sums of the vectors y0, y1, ... and of their products, for each group and start."""
    sums, products = (F.expr("array(" + ", ".join(f"sum({c})" for c in of) + ")") for of in ([f"y{k}" for k in range(DIM)], [f"y{i} * y{j}" for i, j in PAIRS]))
    return x.groupBy("gid", "start").agg(F.count(F.lit(1)).alias("n"), sums.alias("s"), products.alias("ss"))


_ESTIMATE = "gid string, start int, mean array<double>, inverse array<double>, det double, fell double"


def _estimates(moments: DataFrame, scale: float) -> DataFrame:
    """(_ESTIMATE) of moments about `mean`: `scale` times the scatter plus the least spreads, inverted. A row a group and
    start, so a task inverts a batch of small matrices at a time. `fell`: how far the determinant's logarithm fell from
    that of the moments, `det`."""
    floors = np.diag([f * f for _, f in VECTOR.values()])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            table = lambda c: np.array(b.column(c).to_pylist(), float).reshape(b.num_rows, -1)
            n = b.column("n").to_numpy(zero_copy_only=False)[:, None]
            shift, about = table("s") / n, table("mean")
            scatter = np.zeros((b.num_rows, DIM, DIM))
            for k, (i, j) in enumerate(PAIRS):
                scatter[:, i, j] = scatter[:, j, i] = table("ss")[:, k] / n[:, 0] - shift[:, i] * shift[:, j]
            whole = scale * scatter + floors
            lists = lambda a: pa.array(a.reshape(b.num_rows, -1).tolist(), pa.list_(pa.float64()))
            det = np.linalg.slogdet(whole)[1]
            fell = b.column("det").to_numpy(zero_copy_only=False) - det
            yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("start"), lists(about + shift), lists(np.linalg.inv(whole)), pa.array(det), pa.array(fell)], ["gid", "start", "mean", "inverse", "det", "fell"])

    return moments.select("gid", "start", "n", "s", "ss", "mean", "det").mapInArrow(each, _ESTIMATE)


def _away(mean: str, into: str) -> list[Column]:
    return [F.expr(f"{c} - {mean}[{k}] AS {into}{k}") for k, c in enumerate(VECTOR)]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row's vector y0, y1, ... by its estimate."""
    return F.expr(" + ".join(f"{1 if i == j else 2} * inverse[{i * DIM + j}] * y{i} * y{j}" for i, j in PAIRS))


def _with_distance(x: DataFrame, estimates: DataFrame, small: bool) -> DataFrame:
    """Rows with each estimate of their group, their vector about its mean as y0, y1, ..., and the distance d2."""
    return x.join(_sent(estimates, small), "gid").select("*", *_away("mean", "y")).withColumn("d2", _distance())


def _concentrated(x: DataFrame, estimates: DataFrame, small: bool, scale: float = 1.0) -> DataFrame:
    """One concentration step: estimates of the half of each group's rows that lie nearest by the former ones.

    The half is cut at a bin of a histogram of distances, ties and all, so it is the same for any partitions."""
    rows = _with_distance(x, estimates, small).withColumn("bin", F.floor(F.log2(F.col("d2") + 2.0**-20) * BINS))
    bins = rows.groupBy("gid", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    held = bins.groupBy("gid", "start").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("all"))  # of fixed length: some ten thousand bins at most
    half = F.floor((F.col("all") + DIM + 1) / 2)
    last = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("bigint").alias("at")), lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.coalesce(a["at"], F.when(a["n"] + b["n"] >= half, b["bin"])).alias("at")))["at"]
    known = held.select("gid", "start", last.alias("last")).join(_sent(estimates, small), ["gid", "start"])
    near = _with_distance(x, known, small).where(F.floor(F.log2(F.col("d2") + 2.0**-20) * BINS) <= F.col("last"))
    return _estimates(_moments(near).join(_sent(estimates.select("gid", "start", "mean", "det"), small), ["gid", "start"]), scale)


def robust_scatter(x: DataFrame, small: bool, steps: int = 30) -> DataFrame:
    """(gid, mean, inverse, det): the reweighted minimum-covariance-determinant estimate of every group.

    x: gid and the vector. The starts are the coordinates' medians with their median deviations, and the scatter of the
    directions from the medians. `steps` bounds the concentration steps, which end once no logarithm of a determinant falls by a
    thousandth."""
    middle = store(_medians(x, {c: F.col(c) for c in VECTOR}), "medians")
    named = middle.select("gid", F.array(*VECTOR).alias("mean"))
    about = x.join(_sent(named, small), "gid")
    spread = _medians(about.select("gid", *_away("mean", "y")), {c: F.expr(f"abs(y{k})") for k, c in enumerate(VECTOR)})
    wide = F.array(*(F.greatest(1.4826 * F.col(c), F.lit(f)) for c, (_, f) in VECTOR.items()))
    begin = store(spread.select("gid", wide.alias("wide")).join(_sent(named, small), "gid"), "spreads")
    plain = begin.select("gid", F.lit(0).alias("start"), F.lit(1).cast("long").alias("n"), F.array(*[F.lit(0.0)] * DIM).alias("s"), F.array(*(F.pow(F.get("wide", F.lit(i)), 2) if i == j else F.lit(0.0) for i, j in PAIRS)).alias("ss"), "mean", F.lit(0.0).alias("det"))
    scaled = x.join(_sent(begin, small), "gid").select("gid", "wide", *_away("mean", "y")).select("gid", "wide", *(F.expr(f"y{k} / wide[{k}] AS z{k}") for k in range(DIM)))
    length = "sqrt(1e-18D + " + " + ".join(f"z{k} * z{k}" for k in range(DIM)) + ")"
    ways = scaled.withColumn("length", F.expr(length)).select("gid", F.lit(1).alias("start"), *(F.expr(f"{DIM**0.5}D * wide[{k}] * z{k} / length AS y{k}") for k in range(DIM)))
    turned = _moments(ways).withColumns({"s": F.array(*[F.lit(0.0)] * DIM), "det": F.lit(0.0)}).join(_sent(named, small), "gid")
    found = store(_estimates(plain.unionByName(turned.select(*plain.columns)), 1.0), "estimates")
    for _ in range(steps):
        found = store(_concentrated(x, found, small), "estimates")
        fell = found.agg(F.max("fell")).first()[0] or 0.0
        if fell < 1e-3:
            break
    best = found.groupBy("gid").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
    half = store(_concentrated(x, found.join(_sent(best, small), ["gid", "start"]), small, HALF), "estimates")
    near = _with_distance(x, half, small).where(F.col("d2") <= NEAR)
    return store(_estimates(_moments(near).join(_sent(half.select("gid", "start", "mean", "det"), small), ["gid", "start"]), NEAR_SCALE), "estimates")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 100, cutoff: float = CUTOFF, steps: int = 30) -> DataFrame:
    """(id_col, COUNTS, distance double, base_failed, kept): the statistics of every row of `docs` and what they say.

    A row is kept if it passes the base rules (20 words or more, no more than 30 % of them in repeated windows of eight) and
    its squared distance from its group (see grouped()) is `cutoff` or less. Groups are estimated from all their rows that
    pass the base rules. A null text has no word. A null language or source is one like any other. Where there are fewer
    than `least` rows to estimate from, the base rules alone decide and the distance is null, as it is for rows that fail
    them. Repeated rows and null ids come back as they are; other columns are ignored."""
    rows, small = grouped(store(counted(docs, id_col, text_col, lang_col, source_col), "counts"), least)
    passed = ~F.col("failed") & F.col("gid").isNotNull()
    rows = store(rows.select("id", "gid", *COUNTS, base_failed().alias("failed")).select("*", *(F.when(passed, f(F.col)).alias(n) for n, (f, _) in VECTOR.items())), "vectors")
    known = robust_scatter(rows.where(passed).select("gid", *VECTOR), small, steps).select("gid", "mean", "inverse")
    out = rows.withColumn("own", F.when(passed, F.col("gid"))).drop("gid").join(_sent(known, small), F.col("own") == F.col("gid"), "left")
    out = out.select("*", *_away("mean", "y")).withColumn("d2", _distance())
    return out.select(F.col("id").alias(id_col), *COUNTS, F.col("d2").alias("distance"), F.col("failed").alias("base_failed"), (~F.col("failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"))
