"""Joins of half-open intervals (contig, start, end).

An overlap predicate alone would be a nested-loop join. Instead there are bins of several widths, each eight times the one
below, and an interval belongs to the narrowest level whose bins are as long as it is, where it touches two bins at most.
Two intervals meet at the higher of their levels: there the shorter one is looked up too. So an interval is a few rows,
however long it is, and of two sides of short intervals each row is one. A pair is kept only in the bin where it first
meets, so nothing has to be made distinct.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the narrowest bins, and the number of levels: the widest bins hold 2 ** 35 positions.
WIDTH, LEVELS = 1 << 14, 8


def _level(width: int) -> Column:
    """The narrowest level whose bins are as long as the interval; what is longer still stays at the top."""
    size = F.col("end") - F.col("start")
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(size <= width << 3 * k, F.lit(k)).otherwise(out)
    return out


def _size(level: Column, width: int) -> Column:
    return F.get(F.array(*(F.lit(width << 3 * k).cast("long") for k in range(LEVELS))), level)


def _bins(level: Column, width: int, last: Column) -> Column:
    """The bins of a level from that of start to that of `last`."""
    size = _size(level, width)
    return F.transform(F.sequence(F.floor(F.col("start") / size), F.floor(last / size)), lambda b: F.struct(level.alias("level"), b.alias("bin")))


def levels_of(width: int, *sides: DataFrame) -> list[list[int]]:
    """For each side the levels that its intervals have, by one job: some small numbers."""
    out: list[list[int]] = [[] for _ in sides]
    found = None
    for k, df in enumerate(sides):
        mine = df.where("end > start").select(F.lit(k).alias("side"), _level(width).alias("level"))
        found = mine if found is None else found.unionByName(mine)
    for r in found.distinct().collect():
        out[r["side"]].append(r["level"])
    return [sorted(x) for x in out]


def explode_bins(df: DataFrame, width: int = WIDTH, above: list[int] | None = None) -> DataFrame:
    """Each interval with its own level (_own) once per bin that it touches there (_level, _bin), and at those of the levels
    `above` that are above its own; empty intervals not at all."""
    own = df.where("end > start").withColumn("_own", _level(width))
    more = F.filter(F.array(*map(F.lit, above)), lambda k: k > F.col("_own")) if above else F.array().cast("array<int>")
    at = F.flatten(F.transform(F.concat(F.array("_own"), more), lambda k: _bins(k, width, F.col("end") - 1)))
    return own.withColumn("_at", F.explode(at)).select(*df.columns, "_own", F.col("_at.level").alias("_level"), F.col("_at.bin").alias("_bin"))


def overlaps(a: DataFrame, b: DataFrame, width: int = WIDTH, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals: the columns of `a`, and those of `b` with prefix b_. A row of `a` once per match."""
    of_a, of_b = levels_of(width, a, b)
    right = explode_bins(b, width, of_a).select(*(F.col(c).alias(f"b_{c}") for c in b.columns), *(F.col(f"_{c}").alias(f"_b{c}") for c in ("own", "level", "bin")))
    left = explode_bins(a, width, of_b)
    meet = (F.col("contig") == F.col("b_contig")) & (F.col("_level") == F.col("_blevel")) & (F.col("_bin") == F.col("_bbin")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    size = _size(F.col("_level"), width)
    here = (F.col("_level") == F.greatest("_own", "_bown")) & (F.col("_bin") == F.floor(F.greatest("start", "b_start") / size))
    return left.join(right, meet & here, how).select(*a.columns, *(f"b_{c}" for c in b.columns))


def overlapping(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of `a` that overlap any of `b`, as often as they stand in `a`. Only coordinates are joined with `b`."""
    hit = overlaps(a.select("contig", "start", "end"), b.select("contig", "start", "end"), width).select("contig", "start", "end").distinct()
    return a.join(hit, ["contig", "start", "end"], "left_semi").select(*a.columns)


def contained(a: DataFrame, bounds: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of `a` that lie wholly within an interval of `bounds`, however many of them there are: a row is looked for
    in the bin of its start alone, a bound is in the bins it touches at its own level. There is a join for each level that
    bounds have, the rows found at one are no longer looked for at the next."""
    known = bounds.where("end >= start").select("contig", "start", "end", F.when(F.col("end") > F.col("start"), _level(width)).otherwise(F.lit(0)).alias("_own"))
    levels = sorted(r[0] for r in known.select("_own").distinct().collect())
    out = None
    for k, level in enumerate(levels):
        at = F.explode(_bins(F.lit(level), width, F.col("end")))
        b = known.where(F.col("_own") == level).select(F.col("contig").alias("_c"), F.col("start").alias("_lo"), F.col("end").alias("_hi"), at.alias("_b"))
        here = (F.col("contig") == F.col("_c")) & (F.floor(F.col("start") / (width << 3 * level)) == F.col("_b.bin")) & (F.col("start") >= F.col("_lo")) & (F.col("end") <= F.col("_hi"))
        found = a.join(b, here, "left_semi")
        out = found if out is None else out.unionByName(found)
        if k < len(levels) - 1:
            a = a.join(b, here, "left_anti")
    return a.limit(0) if out is None else out


def window_means(windows: DataFrame, features: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each window with the unweighted mean of the features that overlap it, 0 if none does. Windows must be distinct."""
    met = overlaps(windows.select("contig", "start", "end"), features.select("contig", "start", "end", "value"), width)
    means = met.groupBy("contig", "start", "end").agg(F.avg("b_value").alias("value"))
    return windows.join(means, ["contig", "start", "end"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def flagged(windows: DataFrame, regions: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each window with flag 1 if it overlaps a region, else 0."""
    hit = overlaps(windows.select("contig", "start", "end"), regions.select("contig", "start", "end"), width).select("contig", "start", "end").distinct().withColumn("flag", F.lit(1))
    return windows.join(hit, ["contig", "start", "end"], "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


def union_aligned(tracks: DataFrame, names: list[str]) -> DataFrame:
    """Tracks (contig, start, end, track, value) over the same windows side by side, 0 where a track has none and the
    largest value where it has several."""
    wide = tracks.groupBy("contig", "start", "end").pivot("track", names).agg(F.max("value"))
    return wide.select("contig", "start", "end", *(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names))


def union_split(tracks: DataFrame, names: list[str], parts: int | None = None) -> DataFrame:
    """Tracks of any intervals side by side: cut at every start and end, one row per piece that a track covers.

    A track that has no interval over a piece reads 0 there. Where a track overlaps itself, the interval that begins last
    counts, of several such the one with the largest value. Intervals are dealt to `parts` ranges of (contig, start) that
    hold about as many each, an interval over a border to both sides; every range is then swept once in order, with the
    intervals that are open held and no others. Empty intervals are left out, as are tracks that `names` doesn't name."""
    spark = tracks.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = tracks.where((F.col("end") > F.col("start")) & F.col("track").isin(*names) & F.col("contig").isNotNull()).select("contig", F.col("start").cast("long"), F.col("end").cast("long"), "track", F.col("value").cast("double"))
    ranged = rows.select("contig", "start").repartitionByRange(n, "contig", "start").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("contig", "start")).alias("at"))
    borders = sorted((r["at"]["contig"], r["at"]["start"]) for r in ranged.collect())[1:]  # one a range, each some interval's start

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, part, starts, ends = [], [], [], []
            for k, (contig, start, end) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                first, last = bisect_right(borders, (contig, start)), bisect_right(borders, (contig, end - 1))
                for p in range(first, last + 1):
                    take.append(k)
                    part.append(p)
                    starts.append(start if p == first else borders[p - 1][1])
                    ends.append(end if p == last else borders[p][1])
            own = b.take(pa.array(take, pa.int32()))
            since = own.column("start")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), own.column("contig"), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), own.column("track"), own.column("value"), since], ["part", "contig", "start", "end", "track", "value", "since"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[int, int, float, int]] = []  # (end, began, value, track), a heap by end
        contig, at, out, place = None, 0, [], {t: k for k, t in enumerate(names)}

        def close(until: int | None) -> None:
            """Pieces up to the next start, or all that are left of a contig."""
            nonlocal at
            while open_ and (until is None or at < until):
                to = open_[0][0] if until is None else min(open_[0][0], until)
                if to > at:
                    best: list[tuple[int, float] | None] = [None] * len(names)
                    for _, began, value, t in open_:
                        if best[t] is None or (began, value) > best[t]:
                            best[t] = (began, value)
                    out.append((contig, at, to, [0.0 if x is None else x[1] for x in best]))
                    at = to
                while open_ and open_[0][0] <= at:
                    heappop(open_)

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in out], pa.string()), *(pa.array([r[k] for r in out], pa.int64()) for k in (1, 2)), pa.array([r[3] for r in out], pa.list_(pa.float64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["contig", "start", "end", "v"])

        for b in batches:
            for c, start, end, track, value, began in zip(*(b.column(k).to_pylist() for k in range(1, 7)), strict=True):
                if c != contig:
                    close(None)
                    contig, at = c, start
                close(start)
                at = start
                heappush(open_, (end, began, 0.0 if value is None else value, place[track]))
            if len(out) > 1 << 14:
                yield flush()
        close(None)
        yield flush()

    cut_up = rows.mapInArrow(deal, "part int, contig string, start long, end long, track string, value double, since long")
    ordered = cut_up.repartition(len(borders) + 1, "part").sortWithinPartitions("part", "contig", "start")
    wide = ordered.mapInArrow(sweep, "contig string, start long, end long, v array<double>")
    return wide.select("contig", "start", "end", *(F.get("v", F.lit(k)).alias(n) for k, n in enumerate(names)))


def windows(spark, contig: str, begin: int, end: int, size: int) -> DataFrame:
    """Fixed windows of `size` from `begin` to `end`."""
    return spark.range(begin, end, size).select(F.lit(contig).alias("contig"), F.col("id").alias("start"), (F.col("id") + size).alias("end"))
