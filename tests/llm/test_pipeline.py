import corpus_pipeline as cp
from lacunar.llm.queries import QUERIES, SQL


def test_stages_and_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "near duplicates", "mixing", "encoding"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1)) and set(SQL) <= set(QUERIES)


def test_each_stage_takes_effect(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{d}/documents.parquet")
    sizes = []
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, d)
        if i < 4:
            assert out.dtypes == first.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
    assert sizes[0] <= first.count() and sizes[1] == sizes[0] and sizes[2] < sizes[1] and sizes[4] == sizes[3]
    assert sorted(docs.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"]


def test_stages_take_an_empty_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert docs.count() == 0


def test_stages_take_nulls_and_repeats(spark):
    """Null texts and ids stay; repeated rows stay repeated, in the mix as often as its plan says."""
    d = "/root/testdata/sf0.001"
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, k int, _k int, id long, h long"
    more = ("x", 1, 2, 3, 4)
    rows = [(1, None, None, None, None, *more), (2, "", "en", "a", 0, *more), (3, "one two three four", "en", None, 18, *more), (3, "one two three four", "en", None, 18, *more), (None, "x y z", None, "a", 5, *more)]
    docs = spark.createDataFrame(rows, kind)
    key = lambda df: sorted(map(repr, df.collect()))
    for stage in (cp.drop_toxic, cp.drop_near_duplicates):
        out = stage(spark, docs, d)
        assert out.dtypes == docs.dtypes
        lost = [] if stage is cp.drop_toxic else [2]  # null and empty texts are equal sets of shingles
        assert key(out) == key(docs.where(~docs["doc_id"].isin(lost) | docs["doc_id"].isNull()) if lost else docs)
    lines = cp.drop_lines(spark, docs, d)
    assert sorted((repr(r["doc_id"]), r["text"], r["n_chars"]) for r in lines.collect()) == sorted((repr(i), t or "", len(t or "")) for i, t, *_ in rows)
    mixed = cp.mix_sources(spark, docs, d).collect()
    words = {"a": 0, None: 0}
    for r in mixed:
        words[r["source"]] += len(r["text"].split())
    assert mixed and {r["text"] for r in mixed if r["source"] == "a"} <= {"x y z", "x", "x y"} and words["a"] + words[None] == 11
    out = cp.encode(spark, docs, d).collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"] > 0) for r in out) == sorted((repr(i), bool(t)) for i, t, *_ in rows)


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    """The whole pipeline against its stages in plain Python, the mix's plan by SQL, the ids by tiktoken."""
    import hashlib
    import random

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq
    import public_tokenizers
    import tiktoken

    from lacunar.llm import bpe, toxicity
    from lacunar.sources import shared

    from test_llm import WORDS, lines_by_hand

    rng = random.Random(11)
    shared_line = "This line stands in many documents, and it is long enough to count"
    rows, marks = [], []
    for i in range(260):
        text = "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 14))) for _ in range(rng.randrange(1, 6)))
        if i % 3 == 0:
            text += f"\n \t{shared_line}  \n" + rng.choice(WORDS)
        if i % 9 == 0:
            text += " zorg blarf"
        if i % 7 == 3:
            text = rows[-1][1].replace("\n", " \n")
        rows.append((i, text, "en", rng.choice(["a", "a", "b", "c", None]), len(text)))
        marks.append((i, 0, int("zorg" in text)))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs, labels = spark.createDataFrame(rows, kind), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert toxic and toxic <= {i for i, _, t in marks if t}
    kept = [r for r in rows if r[0] not in toxic]
    lines = lines_by_hand(kept)
    assert any(x[1] for x in lines.values())
    kept = [(i, lines[i][2], lang, source, len(lines[i][2])) for i, _, lang, source, _ in kept]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(r[1]) for r in kept], list(range(len(kept)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and (a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j])):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    kept = [r for i, r in enumerate(kept) if root[i] == i]
    assert len(kept) < len(sets)
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), map(list, zip(*kept)), strict=True))), tmp_path / "kept.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/kept.parquet')")
    cur = con.execute(SQL["op3_mixing"])
    names = [x[0] for x in cur.description]
    text_of, want = {r[0]: r[1] for r in kept}, []
    for x in (dict(zip(names, r, strict=True)) for r in cur.fetchall()):
        text = text_of[x["doc_id"]]
        want += [(x["doc_id"], text)] * (x["base"] + (0 < x["hi"] == x["size"]))
        if 0 < x["hi"] < x["size"]:
            words, at = text.split(), 0
            for w in words[: x["hi"]]:
                at = text.index(w, at) + len(w)
            want.append((x["doc_id"], text[:at]))
    assert any(t != text_of[i] for i, t in want) and any("\n" in t for i, t in want if t != text_of[i])
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    final = sorted((i, len(ids := enc.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in want)
    got = cp.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == final
    # of the run only the last stage's table is left
    import glob

    base = shared.shared_dir(spark).removeprefix("file://")
    mine = {f.split("/pipeline-")[1].split("/")[0]: f for f in got.inputFiles()}
    assert [g.rsplit("/", 1)[1] for name in mine for g in glob.glob(f"{base}/pipeline-{name}/*")] == ["4"]


def test_near_duplicates_brute_force(spark):
    """Edited copies: the stage keeps the smallest id of each component over all pairs of 5-word Jaccard 0.8 or more."""
    import random

    from lacunar.llm.jaccard import similar_documents

    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for n in [3, 5, 9, 30, 69, 120, 400] * 6:
        base = [rng.choice(words) for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, 3, 4):
            copy = base[:]
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    base = [rng.choice(words) for _ in range(90)]  # one large group, most of it at 0.8 to 0.9
    for _ in range(60):
        copy = base[:]
        copy[rng.randrange(90)] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += ["", " \t", None]
    rng.shuffle(texts)

    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if root[i] != root[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(None, texts[0], "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for block in (128, 8):  # 8: the large group is divided
        got = {r["doc_id"]: r["component_id"] for r in similar_documents(docs, block=block).collect()}
        assert got.pop(None) is None and got == dict(enumerate(root))
    kept = [r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == [*sorted(set(root)), None]


def test_near_duplicates_come_by_the_simhash_index(spark, monkeypatch):
    """With bands that name no candidates, links of 0.8 within components of fingerprints at most 3 bits apart are found."""
    import random

    import numpy as np

    from lacunar.llm import jaccard

    rng = random.Random(8)
    texts = []
    for n in [30, 100, 400, 2000] * 6:
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        for edits in (0, 1, 1, 2, 3):
            copy = base[:]
            for _ in range(edits):
                copy[rng.randrange(n)] = f"w{rng.randrange(500)}"
            texts.append(" ".join(copy))
    texts += ["", "one two", "one two", "one  TWO"]
    rng.shuffle(texts)
    sets = [jaccard.shingles(t.encode(), 5) for t in texts]
    bits = [sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s)) for s in sets]

    def joined(near):
        root = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if root[i] != root[j] and near(i, j):
                    lo, hi = sorted((root[i], root[j]))
                    root = [lo if r == hi else r for r in root]
        return root

    coded = joined(lambda i, j: len(sets[i]) and len(sets[j]) and (bits[i] ^ bits[j]).bit_count() <= 3)
    alike = lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))
    want = joined(lambda i, j: coded[i] == coded[j] and alike(i, j))
    assert len(set(want)) < len(set(joined(lambda i, j: np.array_equal(sets[i], sets[j])))) - 20 and len(set(want)) > len(set(joined(alike)))

    def blind(some):
        return np.random.default_rng([len(s) for s in some]).integers(0, 1 << 63, (len(some), jaccard.BANDS)).astype(np.uint64) ^ np.array([s[0] for s in some])[:, None]

    monkeypatch.setattr(jaccard, "band_keys", blind)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (128, 1):
        assert {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs, block=block).collect()} == dict(enumerate(want))


def test_fingerprints_of_sets_in_chunks(monkeypatch):
    import numpy as np

    from lacunar.llm import simhash

    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 64, n, np.uint64) for n in (1, 2, 700, 3, 1, 64, 63, 1, 130)]
    want = [sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s)) for s in sets]
    for chunk in (1 << 16, 64, 7, 1):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert simhash.simhash_sets(sets).tolist() == want


def test_near_duplicates_tell_texts_of_one_id_apart(spark):
    """A row goes by its own text, not because another row under its id goes."""
    long = " ".join(f"w{k}" for k in range(40))
    near, other = long.replace("w39", "x"), " ".join(f"v{k}" for k in range(40))
    rows = [(1, long), (5, long), (5, other), (7, near), (7, "something else"), (7, "something else"), (9, other), (None, long), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in kept) == sorted((repr(i), t or "") for i, t in [(1, long), (5, other), (7, "something else"), (7, "something else"), (None, long), (3, None)])


def test_texts_around_one_passage_are_not_compared_pairwise(spark, monkeypatch):
    """600 texts share a passage of more than half their words: buckets hold hundreds of them that are not similar. The
    shingles' prefixes leave few comparisons; near copies among them are still found."""
    from lacunar.llm import jaccard

    passage = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(f"u{i}-{k}" for k in range(25)) + " " + passage for i in range(600)]
    texts += [t.replace(" p59", " q") for t in texts[::100]]  # near copies of six of them
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared = []
    plain = jaccard._compared

    def counting(with_text, members, *rest):
        compared.append([tuple(r) for r in members.select("group", "odd", "n").collect()])
        return plain(with_text, members, *rest)

    monkeypatch.setattr(jaccard, "_compared", counting)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs, block=8).collect()}
    assert got == {i: (i - 600) * 100 if i >= 600 else i for i in range(606)}
    assert len(compared) == 2 and compared[1] is not None  # large groups were there and were divided
    assert sum(n for group in compared for _, odd, n in group if odd) < 20 * 606  # comparisons: odd members times members


def test_native_operators_stay_in_the_jvm(spark):
    import re

    for name in ("op5_line_dedup", "op7_sharding", "op8_fingerprint"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        physical = plan[plan.index("== Physical Plan ==") :]
        assert not re.search("Python|Pandas|Arrow", physical) and "CartesianProduct" not in physical and "NestedLoop" not in physical
        scans = re.findall(r"ReadSchema: struct<([^>]*)>", physical)
        assert scans and all("lang" not in s and "n_chars" not in s for s in scans)


def test_queries_refuse_a_cluster_without_a_shared_folder(spark, monkeypatch):
    import pytest

    from lacunar.sources import shared

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Elsewhere)
