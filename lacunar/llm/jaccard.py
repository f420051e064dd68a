"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Documents with equal sets of shingles are one row throughout. Two indexes say which documents may be similar: the SimHash
index of simhash.py, whose components are taken over fingerprints of the sets, and MinHash bands for what lies beyond its
distance (two sets of similarity 0.8 differ in some 10 of 64 bits). A bucket is a component or a band's key, and no link
counts before it is verified on the shingles. First every document of a bucket is compared with the bucket's
smallest one, which joins nearly all that belongs together with as many comparisons as there are rows. What is compared
pair by pair then are buckets whose documents are still of several components, and in them only documents outside the
bucket's largest component with all others. Where many such documents share a bucket, as texts around one long passage
do, the bucket is divided once more by prefixes: two sets of similarity s share one of the rarest 1 - s of their shingles,
counted within the bucket. Large groups are cut into blocks that meet in tasks of their own.

40 bands of 5 miss a pair of similarity 0.8 with a chance of (1 - 0.8 ** 5) ** 40 = 1.3e-7, more similar ones less often.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, row_of, short_batches, store
from .simhash import CHUNK, _hashes, link_fingerprints, simhash_sets

BANDS, ROWS = 40, 5
_XOR, _ODD = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_ODD |= np.uint64(1)


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The distinct hashes of the shingles of n words, sorted; one for all words if there are fewer, none without a word."""
    return np.unique(np.array([h for hs in _hashes((text or b"").lower().split(), n) for h in hs], np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS keys for each set; the sets must not be empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    h = np.concatenate(sets)
    held, out = np.empty_like(h), np.empty((BANDS, len(sets)), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for p in range(band * ROWS, band * ROWS + ROWS):
            np.multiply(np.bitwise_xor(h, _XOR[p], out=held), _ODD[p], out=held)
            key = (key ^ np.minimum.reduceat(held, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        out[band] = key
    return out.T


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id bigint, version, k1, k2, fingerprint, bands): the digest of each row's set of shingles, its SimHash and its band
    keys, both null for an empty set. `version` is a hash of the text as it stands, which with the id finds the row again."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, n) for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
            bands: list = [None] * len(sets)
            codes: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            while full:  # CHUNK hashes at a time, or one longer set
                most = max(1, int(np.searchsorted(np.cumsum([len(sets[i]) for i in full]), CHUNK)))
                part, full = full[:most], full[most:]
                some = [sets[i] for i in part]
                for i, code, keys in zip(part, simhash_sets(some).view(np.int64), band_keys(some).view(np.int64), strict=True):
                    codes[i], bands[i] = code, keys
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(codes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "version", "k1", "k2", "fingerprint", "bands"])

    return named(docs, id_col, text_col).mapInArrow(each, "id bigint, version bigint, k1 bigint, k2 bigint, fingerprint bigint, bands array<bigint>")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, text)"""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))


def similar(sets: list[np.ndarray], least: Fraction, roots: list[int], odd: list[int]) -> list[tuple[int, int]]:
    """Links (i, j) of a similarity of `least` or more that join the components `roots` of the sets: those in `odd` are
    compared with all others, except where links have made them one component already."""
    n, root = len(sets), np.unique(roots, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), size)[np.argsort(at, kind="stable")]  # for each shingle in turn, the sets that hold it
    count = np.bincount(at)
    first, begin, links = np.cumsum(count) - count, np.cumsum(size) - size, []
    for i in odd:
        if (root == root[i]).all():
            continue
        mine = at[begin[i] : begin[i] + size[i]]
        each = count[mine]
        both = np.bincount(owner[np.repeat(first[mine] - (np.cumsum(each) - each), each) + np.arange(each.sum())], minlength=n)
        near = np.flatnonzero((both * least.denominator >= (size + size[i] - both) * least.numerator) & (root != root[i]))
        for r, j in zip(*np.unique(root[near], return_index=True), strict=True):
            links.append((i, int(near[j])))
            root[root == r] = root[i]
    return links


def _grouped(rows: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal leading columns: (key, rows), from batches sorted by them."""
    last, held = None, []
    for b in rows:
        for key, row in zip(zip(*(b.column(k).to_pylist() for k in range(n_keys)), strict=True), zip(*(b.column(k).cast(pa.large_binary()) if pa.types.is_string(b.column(k).type) else b.column(k).to_pylist() for k in range(n_keys, b.num_columns)), strict=True), strict=True):
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def _pairs_out(links: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    out = list(links)
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def _stars(n: int, least: Fraction):
    """mapInArrow over rows (centre, part, id, text), each part beginning with its centre: links from the similar ones."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, middle = None, None
        for b in batches:
            links = []
            for centre, part, i, text in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3).cast(pa.large_binary()), strict=True):
                own = shingles(text.as_py(), n)
                if (centre, part) != last:
                    last, middle = (centre, part), own
                if i == centre:  # once, or more often where rows repeat
                    continue
                both = len(np.intersect1d(own, middle, assume_unique=True))
                if both * least.denominator >= (len(own) + len(middle) - both) * least.numerator:
                    links.append((i, centre))
            yield from _pairs_out(links)

    return each


def _leftovers(n: int, least: Fraction):
    """mapInArrow over rows (group, p, q, id, root, odd, text) sorted by the first three: links from the odd ones."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 3):
            known = {i: (root, odd, text) for i, root, odd, text in sorted(rows, key=lambda r: r[2])}  # a text may come as both
            ids = list(known)
            odd = [k for k, i in enumerate(ids) if known[i][1]]
            links = similar([shingles(known[i][2].as_py(), n) for i in ids], least, [known[i][0] for i in ids], odd)
            yield from _pairs_out((ids[i], ids[j]) for i, j in links)

    return each


def _prefixes(with_text, members: DataFrame, n: int, least: Fraction) -> DataFrame:
    """(group, id, root) of large groups divided: a row for each of a document's rarest shingles, by their counts in the
    group, as many as any set of similarity `least` must share one of."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), n).view(np.int64) for t in b.column(3).cast(pa.large_binary())]
            take = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(take)) for k in range(3)), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])), pa.array(np.array([len(s) for s in sets], np.int64)[take])], ["group", "id", "root", "shingle", "size"])

    held = with_text(members.select("group", F.col("id").alias("_node"), "root")).select("group", "id", "root", "text").mapInArrow(each, "group bigint, id bigint, root bigint, shingle bigint, size bigint")
    held = cut(held)
    # a shingle that one document holds alone makes no group, but its place among the rarest counts
    counts = held.groupBy("group", "shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = held.join(counts, ["group", "shingle"]).withColumn("place", F.row_number().over(Window.partitionBy("group", "id").orderBy("df", "shingle")))
    most = F.col("size") - F.ceil(F.col("size") * least.numerator / least.denominator) + 1
    return ranked.where((F.col("place") <= most) & (F.col("df") > 1)).select(F.xxhash64("group", "shingle").alias("group"), "id", "root")


def _open_groups(members: DataFrame) -> DataFrame:
    """(group, id, root, odd, n, odds) of the groups with several roots, one group of those with the same members. Odd are
    the members outside the group's largest root."""
    h = F.xxhash64("id")
    whole = members.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("y")).where("lo <> hi")
    once = whole.groupBy("n", "x", "y").agg(F.min("group").alias("group")).select("group", "n")
    open_ = cut(members.join(once, "group"))
    big = open_.groupBy("group", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("group").agg(F.max_by("root", F.struct("m", "root")).alias("big"), (F.sum("m") - F.max("m")).alias("odds"))
    return open_.join(big, "group").select("group", "id", "root", (F.col("root") != F.col("big")).alias("odd"), "n", "odds")


def _compared(with_text, members: DataFrame, n: int, least: Fraction, block: int) -> DataFrame:
    """Links (a, b) of _open_groups(): blocks of all members meet blocks of the odd ones; up to 2 * `block` of
    either are one block."""
    parts = lambda c: F.when(F.col(c) <= 2 * block, F.lit(1)).otherwise(F.ceil(F.col(c) / block)).cast("int")
    mine = lambda k: F.pmod(F.xxhash64(F.lit(7), "id"), F.col(k)).cast("int")
    laid = members.withColumns({"ps": parts("n"), "qs": parts("odds")}).withColumns({"p": mine("ps"), "q": mine("qs")})
    as_one = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: F.struct(F.col("p").alias("p"), q.alias("q"), F.lit(False).alias("odd")))
    as_odd = F.when(F.col("odd"), F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda p: F.struct(p.alias("p"), F.col("q").alias("q"), F.lit(True).alias("odd")))).otherwise(F.array().cast("array<struct<p:int,q:int,odd:boolean>>"))
    at = F.when(F.col("odd") & (F.col("ps") == 1), as_odd).otherwise(F.concat(as_one, as_odd))
    rows = laid.select("group", F.col("id").alias("_node"), "root", F.explode(at).alias("at"))
    rows = with_text(rows).select("group", "at.p", "at.q", "id", "root", "at.odd", "text")
    return rows.repartition("group", "p", "q").sortWithinPartitions("group", "p", "q").mapInArrow(_leftovers(n, least), "a bigint, b bigint")


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 128, broadcast_rows: int = 1 << 20, distance: int = 3) -> DataFrame:
    """(id, version, component_id) of every row of `docs`: the smallest id reachable over links of `similarity` or more.

    Words are split at white space, A-Z lower-cased; a text of fewer than `shingle` words is one shingle. Null and empty
    texts have the empty set and are similar to each other alone. A row with a null id has no component and makes no link.
    Different texts under one id are rows of their own, told apart by `version`, a hash of the text. Groups of more than
    2 * `block` documents are divided into blocks, and by prefixes before that if more than 2 * `block` of their documents
    are outside the largest component, also after the links of the other groups are known. Up to `broadcast_rows` documents that share a bucket with another (24 MB of ids) are
    found by a broadcast, so that no other text moves; more by a shuffle. `distance` is the SimHash index's.
    """
    short_batches(docs.sparkSession)
    least = Fraction(str(similarity))
    found = cut(sketches(docs, id_col, text_col, shingle))
    known = found.where("id is not null").groupBy("k1", "k2").agg(F.min(F.struct("id", "version")).alias("rep"), F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands"))
    # a node is a set of shingles; its number means nothing, and the checkpoint keeps it
    sets = cut(known.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "rep.id", "rep.version", "fingerprint", "bands"))
    buckets = sets.where("bands is not null").select(F.explode("bands").alias("group"), F.col("node").alias("id"))
    coded = link_fingerprints(sets.select(F.col("node").alias("id"), "fingerprint"), distance)
    buckets = buckets.unionByName(sets.join(coded, "fingerprint").select(F.xxhash64(F.lit("simhash"), "component_id").alias("group"), F.col("node").alias("id")))
    shared = buckets.groupBy("group").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").select("group", "centre")
    buckets = cut(buckets.join(shared, "group"))
    pairs = cut(buckets.where("id <> centre").select("centre", "id").distinct())
    # the texts of the nodes that share a bucket, one row a node, written once: all that follows reads these alone
    nodes = cut(buckets.select("id").distinct().join(sets.select("node", F.col("id").alias("_id"), F.col("version").alias("_version")), F.col("id") == F.col("node")).select("node", "_id", "_version"))
    known_nodes = F.broadcast(nodes) if nodes.count() <= broadcast_rows else nodes
    texts = store(named(docs, id_col, text_col).join(known_nodes, (F.col("id") == F.col("_id")) & (F.col("version") == F.col("_version"))).select("node", "text"), "texts")
    # (id, text) of the nodes that `rows` names as _node, beside its other columns; repeated rows of `docs` come as often
    with_text = lambda rows: texts.join(rows, F.col("_node") == F.col("node")).select(*(c for c in rows.columns if c != "_node"), F.col("_node").alias("id"), "text")
    # cut, so that both sides of the next join are plain and Spark can split the rows of a large centre
    width = cut(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / (4 * block)).cast("int").alias("parts")))
    members = pairs.join(width, "centre").select("centre", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("_node"))
    centres = width.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("_node"))
    rows = with_text(members.unionByName(centres)).select("centre", "part", "id", "text")
    stars = cut(rows.repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("id") != F.col("centre")).mapInArrow(_stars(shingle, least), "a bigint, b bigint"))
    joined = cut(components(stars))
    rooted = lambda rows, known: rows.join(known, F.col("id") == F.col("node"), "left").select("group", "id", F.coalesce("component", "id").alias("root"))
    # what is joined already comes as stars around the smallest nodes, so that few rounds are left
    as_links = lambda known: known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    left = cut(_open_groups(rooted(buckets, joined)))
    wide = F.col("odds") > 2 * block
    links = as_links(joined).unionByName(_compared(with_text, left.where(~wide), shingle, least, block))
    if left.where(wide).limit(1).count():
        # the links of the other groups first: they leave fewer documents outside the largest component of a large group
        joined = cut(components(links))
        left = cut(_open_groups(rooted(left.where(wide).select("group", "id"), joined)))
        parts = left.where(~wide)
        if left.where(wide).limit(1).count():
            parts = parts.unionByName(_open_groups(_prefixes(with_text, left.where(wide), shingle, least)))
        links = as_links(joined).unionByName(_compared(with_text, parts, shingle, least, block))
    groups = components(links).withColumnRenamed("node", "_node")
    whole = sets.join(groups, F.col("node") == F.col("_node"), "left").select("k1", "k2", "id", F.coalesce("component", "node").alias("root"))
    smallest = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = whole.join(smallest, "root").select("k1", "k2", "component_id")
    return found.join(labels, ["k1", "k2"], "left").select("id", "version", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, component_id): similar_rows() by id; different texts under one id have a row each."""
    return similar_rows(docs, id_col, text_col, **options).select(F.col("id").alias(id_col), "component_id")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1 << 20, **options) -> DataFrame:
    """The rows of `docs` that have the smallest id of their component. Rows that share an id and a text stay or go
    together, rows with a null id stay. What goes is sent to all executors as ids and hashes, up to `broadcast_rows`
    (16 MB); more are joined by a shuffle."""
    gone = cut(similar_rows(docs, id_col, text_col, broadcast_rows=broadcast_rows, **options).where("component_id <> id").select("id", "version").distinct())
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    rows = docs.select(row_of(docs), F.col(id_col).cast("long").alias("own"), F.xxhash64(text_col).alias("hash"))
    return rows.join(gone, (F.col("own") == F.col("id")) & (F.col("hash") == F.col("version")), "left_anti").select("row.*")
