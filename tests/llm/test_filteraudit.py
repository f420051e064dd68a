"""The filter audit against plain Python that goes through every order row by row."""

from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from lacunar.llm.filteraudit import audit_orders, failure_masks, filter_audit, mask_cells
from lacunar.llm.queries import op13_filter_audit

DATA = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in "".join(" " if c in WHITE else c for c in text).split(" ") if w]


def by_hand(docs, labels):
    """docs: (doc_id, source, text); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, _, text in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, source, text in docs:
        text = text or ""
        w = words_of(text)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and first[text] < i,
        }
        parts[source or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(rows)
            for k, f in enumerate(order):
                here = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(here)
                out[part, "".join(order), k + 1] = [len(left), len(here), sum(f in r[0] for r in rows) - len(here), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_dict(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_query(spark):
    read = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{DATA}/{n}.parquet").select(*c).collect()]
    df = op13_filter_audit(spark, DATA)
    assert dict(df.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(NAMES, "bigint")
    assert as_dict(df) == by_hand(read("documents", "doc_id", "source", "text"), read("labels", "doc_id", "quality", "toxic"))


ODD = [
    (1, "a", "one two"), (2, "b", "one two"), (3, "a", "one  two"), (2, "a", "one two"),  # copies, also under one id and in another part
    (4, None, None), (5, "", ""), (6, "c", "   \n\t"), (7, "c", ""),  # no text and no source
    (None, "a", "one two"), (None, None, "new"), (8, None, "new"),  # null ids are no copies and make none
    (9, "a", " ".join(f"w{k}" for k in range(100_000)) + " ABC"), (10, "a", "X" * 1000), (11, "a", "ÄÖ " * 60), (12, "b", "100% sure | maybe"),
    (13, "a", "x y " * 49 + "Z"), (14, "a", ("A" + "b" * 19) * 50),
]
ODD_LABELS = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (None, 1, 1), (99, 1, 1), (9, 1, 1)]


def test_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows, labels that clash, extra columns of any name."""
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, source string, text string, mask int, part string")
    labels = spark.createDataFrame(ODD_LABELS, "doc_id long, quality int, toxic int")
    assert as_dict(filter_audit(docs, labels)) == by_hand(ODD, ODD_LABELS)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert filter_audit(docs, spark.createDataFrame(ODD_LABELS, "doc_id long, quality int, toxic int")).count() == 0


def test_hot_text_and_source(spark):
    """A third of all rows in one source, and one text for half of them: counts are whole, copies but the first are E."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    masks = failure_masks(docs)
    assert masks.where("mask >= 16").count() == failure_masks(docs, broadcast_rows=0).where("mask >= 16").count() == 1499
    cells = {r["part"]: sum(r["n"]) for r in mask_cells(masks, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert cells["hot"] == 1000 and sum(cells.values()) == 3000


def test_orders_from_cells_alone(spark):
    """Every order removes the same rows in the end, and the shares of the filters add up to them."""
    n = [k * k % 11 for k in range(32)]
    out = audit_orders(spark.createDataFrame([("p", n, [0] * 32, n)], "part string, n array<bigint>, good array<bigint>, toxic array<bigint>")).collect()
    assert len(out) == 600 and {r["kept"] for r in out if r["step"] == 5} == {n[0]}
    assert sum({r["filter_order"][r["step"] - 1]: r["shapley"] for r in out}.values()) == 120 * sum(n[1:])
    assert all(r["removed"] == r["toxic_lost"] and r["good_lost"] == 0 for r in out)
