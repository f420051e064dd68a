"""Audit of five filters and of the order they are applied in.

One pass over the texts turns each row into a mask of the filters that it fails; grouping by text gives the smallest
doc_id of equal ones for the last bit. Masks are counted per part, 32 cells each, and all that is asked about any order
follows from these cells: a filter removes, at its step, the cells that hold its bit and none of the bits before it. So
the orders are gone through on the cells, never on the rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: The filters in the order of their bits.
FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)


def own_failures(text: Column) -> Column:
    """Bits 0 to 3 of the mask: short, repetitive, shouting, marked up. A text without a word is short alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    fails = [
        n < 50,
        100 * F.size(F.array_distinct(words)) < 65 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", broadcast_rows: int = 1 << 18) -> DataFrame:
    """(doc_id bigint, part string, mask int) of every row of `docs`.

    Null texts are empty, a null part is the empty string. Bit 4: another row's id is smaller and its text the same, in
    any part. Rows that share an id are no copies of each other; a row with a null id is none, and makes none. Texts are
    told apart by their SHA-256, so that the groups move digests, not texts. Up to `broadcast_rows` texts with copies (10 MB of digests) go to all
    executors; more are joined by a shuffle, in which Spark splits the rows of a hot text. Extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), own_failures(text).alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = store(rows, "masks")
    # a hot text is one row a task before the shuffle; texts that stand once never meet the rows again
    firsts = store(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= broadcast_rows else firsts
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select("doc_id", "part", (F.col("own") + F.when(copy, F.lit(16)).otherwise(F.lit(0))).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each part three arrays of 32 counts, one for each mask.

    labels: doc_id, quality, toxic. A row counts as good or toxic if any label of its id says 1; without one it is
    neither."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = masks.join(known, F.col("doc_id") == F.col("id"), "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    at = lambda name: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.coalesce(F.element_at(F.map_from_entries(F.collect_list(F.struct("mask", name))), m), F.lit(0).cast("long"))).alias(name)
    return counted.groupBy("part").agg(at("n"), at("good"), at("toxic"))


def _sum(counts: str, which) -> Column:
    """The counts of the masks that `which` holds for, added up."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda total, m: total + F.when(which(m), F.get(counts, m)).otherwise(F.lit(0).cast("long")))


def audit_orders(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for every
    order of the filters and every step of it what mask_cells() says, zeros included."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = [F.instr("filter_order", f) for f in FILTERS]
    mask = lambda which: sum((F.when(which(p), F.lit(1 << k)).otherwise(F.lit(0)) for k, p in enumerate(place)), F.lit(0))
    rows = rows.withColumns({"bit": mask(lambda p: p == F.col("step")), "before": mask(lambda p: p < F.col("step"))})
    bit, before = F.col("bit"), F.col("before")
    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    out = rows.select(
        "part", "filter_order", "step", "bit",
        _sum("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"), _sum("n", here).alias("removed"),
        _sum("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"), F.get("n", bit).alias("unique_fails"),
        _sum("good", here).alias("good_lost"), _sum("toxic", here).alias("toxic_lost"),
    )
    shapley = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "bit"]).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """audit_orders() of whole tables: 600 rows for each part, none without a document."""
    return audit_orders(mask_cells(failure_masks(docs, id_col, text_col, part_col), labels))
