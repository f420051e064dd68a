"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are dealt by a seeded hash into shards, whose number follows the source's share of all rows, so
a source that holds a third of them is spread over a third of the shards. A shard's documents, in seeded order, are one
stream of words cut into blocks of equal size. Blocks are given out by highest quotients v / (2 q + 1): first to
sources in proportion to their targets, then each source's blocks to its shards in proportion to their sizes. A shard
with a quota of q blocks takes all its n blocks q // n times and its first q % n blocks once more; as the order is
seeded, these are a seeded choice. Words taken follow from the running sum alone, so no block is ever a row.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, row_of

WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(id_: Column, text: Column, seed: int) -> Column:
    """60 bits that the seed and the id decide, the same in any SQL engine. Without an id the text decides, so that such
    rows spread over the shards like others."""
    key = F.coalesce(id_.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 15), 16, 10).cast("long")


def water_fill(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Targets that share sum(sizes) by weight, none above `most` times its source's size, the excess shared again."""
    left, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > most * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            open_.discard(i)
        left -= sum(out[i] for i in full)
    return [float(x) for x in out]


def sainte_lague(votes: list[float], seats: int, room: list[int]) -> list[int]:
    """Seats by highest quotients v / (2 q + 1), ties to the earlier entry, never more than room[i] for entry i.

    Starts just below the final count, which is within half the number of entries of proportional, so the walk over
    quotients is short however many seats there are.
    """
    seats, total = min(seats, sum(room)), sum(votes)
    if not total or not seats:
        return [0] * len(votes)
    slack = len(votes)
    while True:
        got = [min(r, max(0, int(v * max(0, seats - slack) / total) - 1)) for v, r in zip(votes, room, strict=True)]
        if sum(got) <= seats:
            break
        slack *= 2
    heap = [(-v / (2 * q + 1), i) for i, (v, q, r) in enumerate(zip(votes, got, room, strict=True)) if v > 0 and q < r]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        i = heapq.heappop(heap)[1]
        got[i] += 1
        if got[i] < room[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _small(df: DataFrame, rows: int, most: int = 1 << 17) -> DataFrame:
    """A table for a join: sent to all executors while it has at most `most` rows (a few MB)."""
    return F.broadcast(df) if rows <= most else df


def _planned(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 7, shards: int = 512, shard_rows: int = 1 << 17, block: int | None = None, keep: bool = False) -> DataFrame:
    """The result of mix(). With `keep`, each row also carries its whole row of `docs` as the struct `row`."""
    spark = docs.sparkSession
    narrow = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), seeded(F.col(id_col), F.col(text_col), seed).alias("h")]
    counted = cut(docs.select(*narrow))  # texts are not stored again: where they are kept, words are counted a second time
    rows = docs.select(*narrow, row_of(docs)) if keep else counted
    tie = [F.xxhash64(F.col("row")[text_col])] if keep else []
    totals = counted.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row per source
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))  # UTF-8 keeps the order of code points
    names, sizes, counts = ([r[c] for r in totals] for c in ("source", "size", "n"))
    while shards * shard_rows < sum(counts) and shards < 1 << 16:
        shards *= 2
    # a source has as many shards as its share of the rows, a power of two: twice `shards` and the sources at most
    width = [min(shards, 1 << max(0, (shards * c // max(1, sum(counts))) - 1).bit_length()) for c in counts]
    wide = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(names, width, strict=True))], "i int, name string, width int")
    dealt = lambda df: df.join(_small(wide, len(names)), F.col("source").eqNullSafe(F.col("name"))).withColumn("k", F.pmod("h", F.col("width")).cast("int")).drop("name", "width")
    cells: list[dict[int, int]] = [{} for _ in names]
    for r in dealt(counted).groupBy("i", "k").agg(F.sum("size").alias("size")).collect():
        cells[r["i"]][r["k"]] = r["size"]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    block = block or int(min(1024, max(1, min((t for t in targets if t), default=1) // 10000)))
    room = [sum(-(-x // block) for x in c.values()) * most for c in cells]
    quota = sainte_lague(targets, (2 * sum(sizes) + block) // (2 * block), room)
    plan = []
    for i in range(len(names)):
        keys = sorted(cells[i])
        per = sainte_lague([float(cells[i][k]) for k in keys], quota[i], [-(-cells[i][k] // block) * most for k in keys])
        for k, q in zip(keys, per, strict=True):
            n = -(-cells[i][k] // block)
            plan.append((i, k, sizes[i], targets[i], q // n if n else 0, q % n * block if n else 0))
    known = spark.createDataFrame(plan, "i int, k int, source_size long, target double, base long, extra long")
    before = F.sum("size").over(Window.partitionBy("i", "k").orderBy("h", F.col("id").asc_nulls_last(), "size", *tie).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt(rows).withColumn("at", F.coalesce(before, F.lit(0))).join(_small(known, len(plan)), ["i", "k"])
    hi = F.least(F.greatest(F.col("extra") - F.col("at"), F.lit(0)), F.col("size"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "base", F.lit(0).cast("long").alias("lo"), hi.alias("hi"), (F.col("base") * F.col("size") + hi).alias("taken"), *(["row"] if keep else []))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 7, shards: int = 512, shard_rows: int = 1 << 17, block: int | None = None) -> DataFrame:
    """(id_col, source_col, size, source_size, target, base, lo, hi, taken): what the mix takes of every document.

    The document is taken whole `base` times and its words lo to hi (from 0, hi left out) once more; taken counts all
    that. Sources stand by code point, null last, with `weights` in turn. `block` is the number of words in a block, by
    default a ten-thousandth of the smallest target, at least 1 and at most 1024. Null and empty texts have size 0 and
    are never taken; ids may be null or repeat. Extra columns are ignored. There are `shards` shards at least, and twice
    as many again until one has about `shard_rows` documents or there are 65,536. What reaches the driver is one number
    per source and one per shard.
    """
    return _planned(docs, id_col, source_col, text_col, weights, most, seed, shards, shard_rows, block)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of `docs`: each row once for every whole time it is taken, and its first words
    once more where the last block ends in it. Rows travel through the plan, so each is taken as its own plan says
    whether its id is null, shared or its own."""
    plan = _planned(docs, id_col, source_col, text_col, **options, keep=True).where(F.col("taken") > 0)
    whole = F.expr("base + if(hi = size, 1, 0)").cast("int")
    part = F.when((F.col("hi") > 0) & (F.col("hi") < F.col("size")), F.col("hi"))
    out = plan.select("row", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(part.isNotNull(), F.array(part)).otherwise(F.array().cast("array<bigint>")))).alias("take"))
    # each word with the white space before it, so that the part is a prefix of the text as it stands
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row")[text_col], F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.greatest(F.col("take"), F.lit(0)).cast("int")), "")
    out = out.select("take", F.when(F.col("take") < 0, F.col("row")[text_col]).otherwise(first).alias("cut"), "row")
    new = {text_col: F.col("cut")} | ({"n_chars": F.char_length("cut").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
