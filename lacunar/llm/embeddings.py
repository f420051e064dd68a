"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and halved. Each half has a codebook of its own, trained on a bounded sample; the pair
of nearest centroids is a vector's cell in the product grid, and every vector is filed in one cell. Two vectors of
cosine c lie sqrt(2 - 2 c) apart, and a vector cannot be further than that from a neighbour's cell, so the distance to
a cell, bounded below in each half by the planes between centroids, orders the cells and says when to stop: a
multi-sequence traversal takes cells in growing order of the summed bounds until the target recall is met. At recall 1
it ends at the exact distance; below, at the smaller bound that reaches the target on a sample of vectors moved by that
distance in random directions. All candidates are then verified in double precision.

Equal vectors are one row with a count throughout. A pair is counted where its cells meet, links leave a cell as stars
to the smallest id, so no group of near copies is ever written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from .simhash import local_components


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of at most k groups; empty groups are dropped."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = sums[n > 0] / n[n > 0, None]
    return c


def bounds(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """A lower bound of the distance from each row to each centroid's region: 0 for its own, else the largest distance
    to a plane that parts the region from another centroid's, of which the nearest centroid's is taken."""
    square = (book**2).sum(1)
    d2 = (x**2).sum(1)[:, None] - 2 * x @ book.T + square
    near = d2.argmin(1)
    gap = np.sqrt(np.maximum(square[near, None] + square - 2 * book[near] @ book.T, 1e-30))
    low = (d2 - d2[np.arange(len(x)), near][:, None]) / (2 * gap)
    low[np.arange(len(x)), near] = 0
    return np.maximum(low, 0)


def traverse(b1: np.ndarray, b2: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multi-sequence traversal for all rows in step: (row, centroid of half 1, centroid of half 2) of the cells whose
    summed squared bounds are at most `limit`, each row's in growing order. Every centroid of the first half keeps a
    place in the sorted second half; each step takes the smallest sum over these places and moves that one on."""
    n, k2 = len(b1), b2.shape[1]
    o1, o2 = b1.argsort(1, kind="stable"), b2.argsort(1, kind="stable")
    s1, s2 = np.take_along_axis(b1, o1, 1) ** 2, np.take_along_axis(b2, o2, 1) ** 2
    s2 = np.c_[s2, np.full(n, np.inf)]
    place, live, out = np.zeros(b1.shape, int), np.arange(n), []
    while len(live):
        sums = s1[live] + np.take_along_axis(s2[live], place[live], 1)
        i = sums.argmin(1)
        ok = sums[np.arange(len(live)), i] <= limit
        live, i = live[ok], i[ok]
        out.append((live, o1[live, i], o2[live, np.minimum(place[live, i], k2 - 1)]))
        place[live, i] += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (live, live, live)


class Index:
    """Codebooks and the bound at which a traversal ends."""

    def __init__(self, sample: np.ndarray, threshold: float, recall: float, k: int, seed: int):
        half = sample.shape[1] // 2
        self.half = half
        self.books = k_means(sample[:, :half], k, seed), k_means(sample[:, half:], k, seed + 1)
        self.limit = 2 - 2 * threshold + 1e-9
        if recall < 1:
            rng = np.random.default_rng(seed)
            step = rng.normal(size=sample.shape)
            step -= (step * sample).sum(1, keepdims=True) * sample
            step /= np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-12)
            moved = threshold * sample + np.sqrt(1 - threshold**2) * step
            c1, c2 = self.cells(moved)
            b1, b2 = self.bounds(sample)
            rows = np.arange(len(sample))
            self.limit = min(self.limit, float(np.quantile(b1[rows, c1] ** 2 + b2[rows, c2] ** 2, recall, method="higher")) + 1e-12)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(((b**2).sum(1) - 2 * h @ b.T).argmin(1) for h, b in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return bounds(x[:, : self.half], self.books[0]), bounds(x[:, self.half :], self.books[1])

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return traverse(*self.bounds(x), self.limit)


def _unit(rows: pa.Array | pa.ChunkedArray | pd.Series) -> np.ndarray:
    """Rows of equal length, as doubles scaled to length one."""
    if isinstance(rows, pd.Series):
        x = np.array([np.asarray(r, float) for r in rows])
    else:
        flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
        x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _deal(index: Index, places_only: bool = False):
    """Rows (label, cell, query, id, copies, vector): one as data in the vector's own cell, one as a query in every cell
    that it visits. With `places_only` label, cell and query alone."""
    step = max(1, (1 << 21) // max(len(b) for b in index.books))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                raw, n2 = b.column(3), len(index.books[1])
                x = _unit(raw)
                c1, c2 = index.cells(x)
                rows, v1, v2 = index.visits(x)
                take = np.concatenate([np.arange(len(x)), rows])
                cell = np.concatenate([c1 * n2 + c2, v1 * n2 + v2])
                query = np.arange(len(take)) >= len(x)
                for s in range(0, len(take), 1 << 14):
                    t, part = pa.array(take[s : s + (1 << 14)]), slice(s, s + (1 << 14))
                    places = [b.column(0).take(t), pa.array(cell[part]), pa.array(query[part])]
                    rest = [] if places_only else [b.column(1).take(t), b.column(2).take(t), raw.take(t)]
                    yield pa.RecordBatch.from_arrays(places + rest, ["label", "cell", "query", "id", "copies", "vector"][: len(places + rest)])

    return each


def blocked(dealt: DataFrame, places: DataFrame, block_rows: int, broadcast_rows: int = 1 << 18) -> DataFrame:
    """Rows of _deal() with the columns db and qb; `places` are the same rows without the rest. A cell with n data rows has ceil(n / block_rows) blocks of data and as
    many of queries as its queries need; each block of the one meets each of the other, in a group of its own. Only
    cells that are larger than a block are looked up, the others are one group each."""
    cells = places.groupBy("label", "cell").agg(F.sum((~F.col("query")).cast("long")).alias("d"), F.sum(F.col("query").cast("long")).alias("q"))
    part = lambda n: F.greatest(F.ceil(F.col(n) / block_rows), F.lit(1)).cast("int")
    hot = cut(cells.where((F.col("d") > block_rows) | (F.col("q") > block_rows)).select(F.col("label").alias("l"), F.col("cell").alias("c"), part("d").alias("nd"), part("q").alias("nq")))
    few = hot.count() <= broadcast_rows  # 6 MB
    known = dealt.join(F.broadcast(hot) if few else hot, (F.col("label") == F.col("l")) & (F.col("cell") == F.col("c")), "left")
    nd, nq = F.coalesce("nd", F.lit(1)), F.coalesce("nq", F.lit(1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    meet = F.when(F.col("query"), F.transform(every(nd), lambda d: F.struct(d.alias("db"), own(nq).alias("qb")))).otherwise(F.transform(every(nq), lambda q: F.struct(own(nd).alias("db"), q.alias("qb"))))
    return known.select("label", "cell", F.explode(meet).alias("m"), "query", "id", "copies", "vector").select("label", "cell", "m.db", "m.qb", "query", "id", "copies", "vector")


def _verify(index: Index, threshold: float, step: int = 2048):
    """For one block of queries and one of data of a cell: for each query the vectors linked to it, and stars of links. When traversals stop early
    a pair may be seen from one side only; the other side is then credited here."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        q, d = pdf[pdf["query"]].sort_values("id"), pdf[~pdf["query"]].sort_values("id")
        if q.empty or d.empty:
            return pd.DataFrame({"id": [], "star": [], "links": []}).astype("int64")
        x, y = _unit(q["vector"]), _unit(d["vector"])
        qi, di, copies = q["id"].to_numpy(), d["id"].to_numpy(), d["copies"].to_numpy()
        names = np.unique(np.r_[qi, di])
        pq, pd_ = np.searchsorted(names, qi), np.searchsorted(names, di)
        parent, links, back = np.arange(len(names)), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        exact = index.limit >= 2 - 2 * threshold
        if not exact:
            (b1, b2), (c1, c2), q_copies = index.bounds(y), index.cells(x), q["copies"].to_numpy()
        for s in range(0, len(x), step):
            for t in range(0, len(y), step):
                i, j = np.nonzero(x[s : s + step] @ y[t : t + step].T >= threshold)
                i, j = i + s, j + t
                other = qi[i] != di[j]
                i, j = i[other], j[other]
                np.add.at(links, pq[i], copies[j])
                parent = local_components(parent, np.minimum(pq[i], pd_[j]), np.maximum(pq[i], pd_[j]))
                if not exact:
                    unseen = b1[j, c1[i]] ** 2 + b2[j, c2[i]] ** 2 > index.limit
                    np.add.at(back, pd_[j[unseen]], q_copies[i[unseen]])
        links += back
        some = np.flatnonzero((links > 0) | (parent != np.arange(len(names))))
        return pd.DataFrame({"id": names[some], "star": names[parent[some]], "links": links[some]})

    return each


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, recall: float = 0.999, sample_rows: int = 20_000, cell_rows: int = 64, block_rows: int = 512, seed: int = 3) -> DataFrame:
    """(id_col, n_links, component_id, kept): near-duplicate links between vectors of equal label.

    n_links counts the other vectors, copies too, at cosine >= threshold; component_id is the smallest id reachable;
    kept says whether it is the vector's own. Vectors or labels that are null, and vectors that are empty, zero or hold
    null or non-finite components, link with nothing, nor do vectors of different lengths. Repeated rows of one id
    count as one vector each. Codebooks are fitted on at most `sample_rows` vectors, those of the smallest hashes, which
    reach the driver as Arrow batches; each length of vectors has books of its own. The grid has about `cell_rows`
    vectors to a cell of a label, up to a codebook of sample_rows / 8 centroids (400 million vectors a label by default);
    beyond that cells grow and are cut into more blocks of `block_rows`. Extra columns are ignored.
    """
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vector"), F.coalesce(good & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.lit(False)).alias("good"))
    classes = cut(rows.where("good").groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    kinds = dict(rows.dtypes)
    found = None
    for size, n in sorted((r["s"], r["n"]) for r in classes.groupBy(F.size("vector").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row per length
        own = classes.where(F.size("vector") == size)
        sample = _unit(own.select("vector", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h").limit(sample_rows).select("vector").toArrow().column(0))
        k = int(np.clip(round((n / cell_rows) ** 0.5), 1, max(1, sample_rows // 8)))
        index = Index(sample, threshold, recall, k, seed)
        own, place = own.select("label", "id", "copies", "vector"), f"label {kinds['label']}, cell long, query boolean"
        dealt = own.mapInArrow(_deal(index), f"{place}, id long, copies long, vector {kinds['vector']}")
        part = blocked(dealt, own.mapInArrow(_deal(index, True), place), block_rows).groupBy("label", "cell", "db", "qb").applyInPandas(_verify(index, threshold), "id long, star long, links long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("id <> star").select(F.col("id").alias("a"), F.col("star").alias("b")))
    per = classes.join(links, "id", "left").join(groups, F.col("id") == F.col("node"), "left").select(F.col("label").alias("_l"), F.col("vector").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(per, F.col("good") & (F.col("label") == F.col("_l")) & (F.col("vector") == F.col("_v")), "left")
    component = F.coalesce("component_id", F.col("id").cast("long"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
