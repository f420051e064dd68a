"""Quality rules: the counts against plain Python, the estimates against a plain version of the method, planted junk."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacunar.llm import outliers
from lacunar.llm.outliers import count_text, quality_rules
from lacunar.llm.queries import op11_quality_rules

DATA = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in "".join(" " if c in WHITE else c for c in text).split(" ") if w]


def counts_by_hand(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(lines), sum(a == b for a, b in zip(w, w[1:], strict=False)), sum("A" <= c <= "Z" for c in text)


@settings(max_examples=150, deadline=None)
@given(st.text("ab \n\tÄZ#|", max_size=120))
def test_counts_of_any_text(text):
    assert count_text(text) == counts_by_hand(text)


@pytest.mark.parametrize("text", [None, "", " \n ", "a " * 7, "a " * 8, "a " * 9, "a b c d e f g h " * 2, "x a b c d e f g h y a b c d e f g h", "    word", "Z" * 100_000, " ".join(map(str, range(50_000)))])
def test_counts_of_odd_texts(text):
    if text and len(text) > 100_000:
        assert count_text(text)[0] == 50_000 and count_text(text)[4] == 0
    else:
        assert count_text(text) == counts_by_hand(text)


def vector_by_hand(c):
    n, chars, sym, dup, rep, lines, dbl, caps = c
    return [np.log(chars / n), np.sqrt(sym / n), np.sqrt(dup / lines), np.sqrt(rep / n), np.sqrt(dbl / n), np.sqrt(caps / chars)]


def distances_by_hand(x):
    """The estimate of one group as the module describes it, in plain numpy."""
    floor = np.array([f for _, f in outliers.VECTOR.values()])
    grid = lambda a: (np.sort(np.floor(a * outliers.GRID), 0)[-(-len(a) // 2) - 1] + 0.5) / outliers.GRID
    away = lambda mean, s: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(s), x - mean)
    scatter = lambda y, scale: scale * np.cov(y.T, bias=True) + np.diag(floor**2)

    def nearest(mean, s):
        b = np.floor(np.log2(away(mean, s) + 2.0**-20) * outliers.BINS)
        return x[b <= np.sort(b)[(len(x) + outliers.DIM + 1) // 2 - 1]]

    mean = grid(x)
    wide = np.maximum(1.4826 * grid(abs(x - mean)), floor)
    z = (x - mean) / wide
    z = outliers.DIM**0.5 * wide * z / np.sqrt((z * z).sum(1) + 1e-18)[:, None]
    found = []
    for s in (np.diag(wide**2 + floor**2), z.T @ z / len(x) + np.diag(floor**2)):
        m, det = mean, np.linalg.slogdet(s)[1]
        for _ in range(30):
            half = nearest(m, s)
            m, s = half.mean(0), scatter(half, 1.0)
            det, last = np.linalg.slogdet(s)[1], det
            if abs(last - det) < 1e-12:
                break
        found.append((det, m, s))
    _, m, s = min(found, key=lambda f: f[0])
    half = nearest(m, s)
    m, s = half.mean(0), scatter(half, outliers.HALF)
    near = x[away(m, s) <= outliers.NEAR]
    return away(near.mean(0), scatter(near, outliers.NEAR_SCALE))


def test_whole_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    df = op11_quality_rules(spark, DATA)
    assert df.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = {r["doc_id"]: r for r in df.collect()}
    counts = {r["doc_id"]: counts_by_hand(r["text"]) for r in docs}
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: c[:5] for i, c in counts.items()}
    failed = {i: c[0] < 20 or 100 * c[4] > 30 * c[0] for i, c in counts.items()}
    assert {i: r["base_failed"] for i, r in got.items()} == failed
    # no language and source has 100 rows here; small groups go together by language, and what is small still, in one
    members = {}
    langs = Counter(r["lang"] for r in docs if not failed[r["doc_id"]])
    for r in docs:
        if not failed[r["doc_id"]]:
            members.setdefault(r["lang"] if langs[r["lang"]] >= 100 else "rest", []).append(r["doc_id"])
    assert max(Counter((r["lang"], r["source"]) for r in docs).values()) < 100
    for ids in members.values():
        if len(ids) < 100:
            assert all(got[i]["distance"] is None and got[i]["kept"] for i in ids)
            continue
        want = distances_by_hand(np.array([vector_by_hand(counts[i]) for i in ids]))
        assert [got[i]["distance"] for i in ids] == pytest.approx(want.tolist(), rel=1e-6)
        assert [got[i]["kept"] for i in ids] == [bool(w <= outliers.CUTOFF) for w in want]
    assert all(not r["kept"] and r["distance"] is None for r in got.values() if r["base_failed"])


def test_odd_rows(spark):
    """Nulls anywhere, empty and long texts, repeated rows, clashing extra columns; too few rows: base rules alone."""
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, text, None, None), (3, text, None, None), (None, text, "en", None), (4, text + " " + text, "en", "a"), (5, "x" * 50_000, "en", "a"), (6, " ".join(map(str, range(20_000))), "de", "b")]
    docs = spark.createDataFrame([(*r, 1, 2.0, "z") for r in rows], "doc_id long, text string, lang string, source string, n_words int, x0 double, gid string")
    out = quality_rules(docs).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"], r["distance"]) for r in out) == sorted((repr(i), (c := counts_by_hand(t) if len(t or "") < 40_000 else count_text(t))[0], (bad := c[0] < 20 or 100 * c[4] > 30 * c[0]), not bad, None) for i, t, *_ in rows)
    assert quality_rules(docs.limit(0)).count() == 0


def test_junk_goes_also_from_a_hot_group(spark):
    """A third of the rows in one source, a fifth of a group junk of one kind: it doesn't hide itself, clean rows stay."""
    k = F.col("id")
    word = lambda i: F.substring(F.sha2(F.concat(k.cast("string"), F.lit("-"), i.cast("string")), 256), 1, (3 + F.pmod(F.xxhash64(k, i), F.lit(5))).cast("int"))
    plain = F.array_join(F.transform(F.sequence(F.lit(1), (60 + k % 40).cast("int")), word), " ")
    junk = k % 5 == 0
    docs = spark.range(900).select(k.alias("doc_id"), F.when(junk, F.regexp_replace(plain, " ", "### ")).otherwise(plain).alias("text"), F.lit("en").alias("lang"), F.when(k % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), k % 4)).alias("source"))
    out = quality_rules(docs, least=60).withColumn("junk", F.col("doc_id") % 5 == 0)
    assert {(r["junk"], r["kept"]): r["n"] for r in out.groupBy("junk", "kept").agg(F.count(F.lit(1)).alias("n")).collect()} == {(True, False): 180, (False, True): 720}
