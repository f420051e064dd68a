"""Every opN query over a whole small table against its SQL, or against a plain version of its contract."""

import hashlib
import os
import re
import zlib

import duckdb
import pytest
import xxhash
from test_llm import canonical_by_hand, groups_by_hand, simhash_by_hand

from lacunar.llm import common, sharding, toxicity
from lacunar.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.fixture(scope="module")
def texts(oracle):
    return dict(oracle.execute("SELECT doc_id, text FROM documents").fetchall())


def rows_of(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, DATA).collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    cur = oracle.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    assert got == sorted(repr(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in names)) for r in cur.fetchall())


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op1_rows(spark, texts):
    got = rows_of(spark, "op1_toxicity")
    assert got.keys() == texts.keys()
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())


def test_op2_brute_force(spark, texts):
    got = rows_of(spark, "op2_simhash")
    fps = {i: simhash_by_hand(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == groups_by_hand(sorted(fps.items()))


def test_op7_brute_force(spark, texts):
    got = rows_of(spark, "op7_sharding")
    for i, t in texts.items():
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    slots = [sorted(r["slot"] for r in got.values() if r["shard"] == s) for s in range(24)]
    assert all(x == list(range(len(x))) for x in slots)
    sizes = [len(x) for x in slots]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    # key by key, clockwise to the first shard with room
    at, order = sharding.ring_owners(spark, 24, 64, 1 << 14)
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(i,) for i in texts], "doc_id long").select("doc_id", F.xxhash64(F.lit("key"), "doc_id").alias("h")).withColumn("c", F.pmod("h", F.lit(1 << 14))).collect()
    room, want = [len(texts) // 24 + (s < len(texts) % 24) for s in range(24)], {}
    for r in sorted(keys, key=lambda r: (r["c"], r["h"])):
        k = next((k for k, p in enumerate(at) if p >= r["c"]), 0)
        while not room[order[k % len(order)]]:
            k += 1
        room[order[k % len(order)]] -= 1
        want[r["doc_id"]] = order[k % len(order)]
    assert {i: r["shard"] for i, r in got.items()} == want


def digest_by_hand(t):
    """Spark's xxhash64 of a string is XXH64 of its bytes with seed 42; a number hashed first seeds the next."""
    raw = canonical_by_hand(t).encode()
    one = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
    return f"{xxhash.xxh64_intdigest(raw, 42):016x}{xxhash.xxh64_intdigest(raw, one):016x}"


def test_op8_brute_force(spark, texts):
    got, ids = rows_of(spark, "op8_fingerprint"), sorted(texts, reverse=True)
    assert got.keys() == texts.keys()
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r, same = got[i], lambda a, b: float(canonical_by_hand(a) == canonical_by_hand(b))
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (same(text, edited), same(text, after))
        assert r["fingerprint"] == digest_by_hand(text) and r["edited_fingerprint"] == digest_by_hand(edited)


def test_op8_odd_tables(spark, tmp_path):
    """Repeated rows, ids that are null or shared, texts that are equal but for case, and colliding digests."""
    from lacunar.llm import fingerprint

    rows = [(9, "AbcdefghI"), (8, "abcDEFGHI"), (8, "abcDEFGHI"), (8, "other text"), (7, None), (6, ""), (None, "no id at all"), (5, "x" * 9), (5, "x" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def check(exact):
        got = QUERIES["op8_fingerprint"](spark, str(tmp_path)).collect()
        assert len(got) == len(rows)
        assert sorted(r["near_next"] for r in got if r["doc_id"] == 5) == [0.0, 1.0]  # the last copy is followed by another
        assert [r["near_next"] for r in got if r["doc_id"] == 7] == [1.0]
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], []).append(r)
        assert by[9][0]["fingerprint"] in {r["fingerprint"] for r in by[8]} and by[7][0]["fingerprint"] == by[6][0]["fingerprint"]
        assert len({r["fingerprint"] for r in got}) == 5
        assert all((len(r["fingerprint"]) == 32) == exact for r in got if r["doc_id"] not in (6, 7))

    check(True)
    old = fingerprint.digest
    fingerprint.digest = lambda form: old(form.substr(1, 0))  # every digest is the same: the forms must tell
    try:
        check(False)
    finally:
        fingerprint.digest = old


def test_op9_equals_tiktoken(spark, texts):
    import public_tokenizers
    import tiktoken

    from lacunar.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = rows_of(spark, "op9_bpe")
    for i, t in texts.items():
        ids = enc.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_op10_rows(spark, oracle, texts):
    got = rows_of(spark, "op10_langid")
    langs = {i: x for i, x in oracle.execute("SELECT doc_id, lang FROM documents").fetchall()}
    learned = {x for i, x in langs.items() if x is not None and not held(i)}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        lettered = texts[i] is not None and re.search(r"[^\W\d_]", texts[i])
        assert r["held_out"] == held(i) and 0 <= r["score"] <= 1 and (r["lang_pred"] in learned if lettered else r["lang_pred"] == "und")
    known = [i for i in got if langs[i] and got[i]["held_out"] and got[i]["lang_pred"] != "und"]
    assert known and sum(got[i]["lang_pred"] == langs[i] for i in known) >= 0.95 * len(known)


CLASHES = "row own hash id version keep h cell r p at parts k i source_ size_ width take cut form gone words after pos line k1 k2 name before node component group hits votes y m l c d n u v a b ids head place copies _k _h _cell _r _p _parts _at _key _version _dropped _n_dropped _take _s _guard _own _i _form _row _text next total extra base lo hi shard_ slot_"


def test_no_column_name_clashes(spark):
    """Extra columns by every name that the operators use inside come back as they were."""
    from lacunar.llm import embeddings, fingerprint, langid, linededup, mixing, simhash
    from lacunar.llm.jaccard import similar_documents

    extra = CLASHES.split()
    kind = "doc_id long, text string, source string, n_chars long, lang string, vec_id long, embedding array<float>, label int, toxic int, " + ", ".join(f"`{c}` int" for c in extra)
    line = "a line that five documents or more do share, long enough"
    rows = [(i, f"w{i} x y z {i}\n{line}", "s", 1, "en", i, [1.0, float(i)], 0, i % 2, *range(len(extra))) for i in range(8)]
    df = spark.createDataFrame(rows, kind)
    same = lambda out, n=len(rows): out.count() == n and all(tuple(r[c] for c in extra) == tuple(range(len(extra))) for r in out.collect())
    labels = df.select("doc_id", "toxic", *extra)
    assert same(linededup.dedup_lines(df)) and same(sharding.shard_rows(df, 3)) and same(fingerprint.fingerprints(df))
    assert linededup.dedup_lines(df).select("n_dropped").distinct().count() == 2
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and same(mixed, mixed.count())
    clean = toxicity.clean_documents(df, labels)
    assert clean.columns == df.columns and same(clean, clean.count())
    assert simhash.near_duplicates(df).count() == mixing.mix(df).count() == embeddings.link_embeddings(df).count() == similar_documents(df).count() == len(rows)
    assert fingerprint.with_next(df).count() == fingerprint.exact_groups(df).count() == toxicity.score(df, labels).count() == langid.predict(df, None).count() == len(rows)
    assert common.row_of(df) is not None
