"""Deterministic sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Shard s owns `vnodes` points on it; a key belongs to the first point clockwise of
its cell. Only the load of each cell, a table as long as the ring, reaches the driver, which walks the ring once: a
cell's keys, in hash order, go to its shard while there is room and continue clockwise to the next shard with room.
The walk yields a few stretches (cell, from, to, shard, first slot); rows find theirs by their rank in their cell, so
one shuffle does all the work and no shard is ever sorted as a whole. Rows travel with what `docs` holds: give ids and
sizes, and nothing else moves.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_of


def ring_owners(spark, n_shards: int, vnodes: int, cells: int) -> list[list[int]]:
    """For each cell the shards met clockwise from it, by hashed virtual nodes: the first owns the cell.

    A point is named by (shard, replica), whatever the number of shards: one more shard adds its own points and no
    other point moves or changes its owner.
    """
    named = spark.range(n_shards * vnodes).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).cast("int").alias("replica"))
    points = named.select("shard", F.pmod(F.xxhash64(F.lit("vnode"), "shard", "replica"), F.lit(cells)).alias("at"), F.xxhash64("shard", "replica").alias("tie")).orderBy("at", "tie", "shard").collect()
    at, order = [p["at"] for p in points], [p["shard"] for p in points]
    return at, order


def walk(loads: dict[int, int], at: list[int], order: list[int], room: list[int], cells: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches (cell, from, to, shard, first slot) that cover every cell's load; room[s] is what shard s may hold."""
    room, used, out = room[:], [0] * len(room), []
    for cell in sorted(loads):
        begin, left, k = 0, loads[cell], bisect_left(at, cell)
        while left:
            shard = order[k % len(order)]
            if take := min(left, room[shard]):
                out.append((cell, begin, begin + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                begin, left = begin + take, left - take
            k += 1
    return out


def shard_rows(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", vnodes: int = 64, cells: int = 1 << 14) -> DataFrame:
    """`docs` with shard int and slot long, which replace columns of these names: shards differ by one row at most.

    Law `rows`: with N rows, N mod n_shards shards have room for one row more than the others, and all room is used, so
    the bound on the loads is the balance itself. Order on the ring is the hash of the id, then the id; rows with
    a null id are keyed by the hash of the whole row, and rows that share an id are told apart by the hash of their row. An empty input gives no row.
    """
    spark = docs.sparkSession
    row = row_of(docs)
    # rows without an id are keys by all that is in them, so that they spread over the ring like others
    h = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit("key"), id_col)).otherwise(F.xxhash64(F.lit("null"), row))
    keyed = docs.select(row, F.col(id_col).alias("id"), h.alias("h"), F.pmod(h, F.lit(cells)).alias("cell"))
    loads = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # as long as the ring at most
    total = sum(loads.values())
    at, order = ring_owners(spark, n_shards, vnodes, cells)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    found = walk(loads, at, order, room, cells)
    by_cell: dict[int, list] = {}
    for cell, lo, hi, shard, slot in found:
        by_cell.setdefault(cell, []).append((lo, hi, shard, slot))
    plan = F.from_json(F.lit(json.dumps([[dict(zip("lhst", x, strict=True)) for x in by_cell.get(c, [])] for c in range(cells)])), "array<array<struct<l:bigint,h:bigint,s:int,t:bigint>>>")
    stretches = spark.range(1).select(F.posexplode(plan).alias("at", "parts"))  # one row a cell: the ring's fixed length bounds the broadcast
    rank = Window.partitionBy("cell").orderBy("h", F.col("id").asc_nulls_last(), F.xxhash64("row"))
    ranked = keyed.withColumn("r", F.row_number().over(rank).cast("long") - 1).join(F.broadcast(stretches), F.col("cell") == F.col("at"))
    mine = F.filter("parts", lambda p: (p["l"] <= F.col("r")) & (F.col("r") < p["h"]))[0]
    new = {"shard": F.col("p.s"), "slot": F.col("p.t") + F.col("r") - F.col("p.l")}
    return ranked.withColumn("p", mine).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in new), *(c.alias(n) for n, c in new.items()))
