"""Pieces the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.sources.shared import cut, shared_dir, short_batches, store, uncut

__all__ = ["LOWER", "UPPER", "WHITE", "WORD", "ascii_lower", "components", "cut", "held_out", "row_of", "shared_dir", "short_batches", "store", "table", "uncut"]

#: White space of the contracts: \x20 and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"
#: A word of the contracts, as a Java and DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of(df: DataFrame) -> Column:
    """All columns of a frame as the one column `row`. While they travel in it, an operator may use any names beside it."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, other letters left alone; the fast path takes texts that are all ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4: no model learns from them."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b", broadcast_rows: int = 1 << 18) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges, for every node of an edge.

    Alternating large-star and small-star steps. Each is a min per node (combined before the shuffle) that the edges look
    up, so no neighbour list is ever gathered. Up to `broadcast_rows` nodes (4 MB of ids) the minima are broadcast and edges
    stay where they are; more are cut first, so that both sides of the join are plain and Spark can split a node with very
    many links. Every round is cut by a checkpoint, and removes that of the round before. Edges with a null end are
    ignored, loops keep their node.
    """
    first = cut(edges.select(F.greatest(F.col(a).cast("long"), F.col(b).cast("long")).alias("u"), F.least(F.col(a).cast("long"), F.col(b).cast("long")).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e, before = first.where("u <> v"), []  # here and below u is larger than v
    last = _edges_seen(e)
    while last[0]:
        held: list[DataFrame] = []

        def looked_up(low: DataFrame, few: bool = 2 * last[0] <= broadcast_rows, held: list[DataFrame] = held) -> DataFrame:
            if few:
                return F.broadcast(low)
            held.append(cut(low))
            return held[-1]

        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
        large = e.join(looked_up(low), F.col("v") == F.col("node")).select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(looked_up(low), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut(small)
        uncut(*before, *held)
        before, now = [e], _edges_seen(e)
        if now == last:
            break
        last = now
    return nodes.join(e, nodes["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def _edges_seen(e: DataFrame) -> tuple[int, int]:
    """Their number, and a sum that tells sets of edges apart."""
    return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
