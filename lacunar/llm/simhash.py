"""Near-duplicate documents by 64-bit SimHash and a hierarchical index in Gray order.

A node of the index is a mask and the bit pattern that all its fingerprints share under that mask. The upper nodes are
laid over the cluster: two fingerprints that differ in at most d bits agree on one of d + 1 blocks of the free bits, so
every fingerprint goes to d + 1 nodes, and a node that grew too large is divided again over its own free bits. The
lower nodes are built where an upper node's fingerprints meet, sorted by Gray rank, in which neighbours share long
patterns: runs of 8 are factored into a mask and a pattern, 8 of those into the next, and so on. The search walks
pairs of nodes downwards, adds up the differences under both masks and drops a pair of groups as soon as they exceed
d; pairs of groups that are already one component are dropped as well, so a dense group of copies costs no more than
the links that join it.

Links leave a node as a star to the smallest member of each local component. Equal fingerprints are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut

CHUNK = 1 << 16
FAN = 8


def _hashes(words: list[bytes], n: int) -> Iterator[list[int]]:
    """XXH64 (seed 42) of every shingle of n words, CHUNK at a time; of all words together if there are fewer."""
    h = xxhash.xxh64_intdigest
    if 0 < len(words) < n:
        yield [h(b" ".join(words), 42)]
    for at in range(0, len(words) - n + 1, CHUNK):
        part = words[at : at + CHUNK + n - 1]
        yield [h(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(n)))]


def _ones(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, for each run of hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)


def simhash_texts(texts: list[bytes | None], n: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints; 0 for texts without a word and for null."""
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    held: list[int] = []
    runs: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            got = _ones(np.array(held, np.uint64), np.array([at for _, at in runs]))
            np.add.at(ones, [i for i, _ in runs], got)
        held.clear()
        runs.clear()

    for i, text in enumerate(texts):
        for hs in _hashes((text or b"").lower().split(), n):
            runs.append((i, len(held)))
            held += hs
            total[i] += len(hs)
            if len(held) >= CHUNK:
                flush()
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhash_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Unsigned 64-bit fingerprints of sets of hashes, none of them empty."""
    size, h = np.array([len(s) for s in sets]), np.concatenate(sets)
    ends, ones = np.cumsum(size), np.zeros((len(sets), 64), np.int64)
    for at in range(0, len(h), CHUNK):
        i, j = np.searchsorted(ends, [at, min(at + CHUNK, len(h)) - 1], "right")
        ones[i : j + 1] += _ones(h[at : at + CHUNK], np.maximum(ends[i : j + 1] - size[i : j + 1] - at, 0))
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fingerprint bigint): the 64 bits of each whole text, read as a signed number. One pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = simhash_texts(b.column(1).cast(pa.large_binary()).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fingerprint"])

    return docs.select(id_col, F.col(text_col)).mapInArrow(each, f"`{id_col}` {kind}, fingerprint bigint")


def gray_rank(c: Column) -> Column:
    """Place of a code in the reflected Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, k))
    return c


def divide(mask: int, parts: int) -> list[int]:
    """Masks of the children of a node: its own bits and one of `parts` blocks of its free bits each."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def local_components(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (smallest indices) after the links a-b are added to the roots in `parent`."""
    while len(a):
        parent = _find(parent)
        ra, rb = parent[a], parent[b]
        new = ra != rb
        if not new.any():
            break
        a, b, ra, rb = a[new], b[new], ra[new], rb[new]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    return _find(parent)


def _tree(codes: np.ndarray, d: int, parent: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Adds to `parent` the links of at most d bits within codes sorted by Gray rank, by a walk down pairs of nodes."""
    masks, values, starts = [np.full(len(codes), ~np.uint64(0))], [codes], [np.arange(len(codes))]
    while len(values[-1]) > FAN:
        m, v = masks[-1], values[-1]
        at = np.arange(0, len(v), FAN)
        every, some = np.bitwise_and.reduceat(v, at), np.bitwise_or.reduceat(v, at)
        masks.append(~(every ^ some) & np.bitwise_and.reduceat(m, at))
        values.append(every & masks[-1])
        starts.append(at * FAN ** (len(starts) - 1))
    grid = np.arange(FAN)
    todo = [(len(values) - 1, *np.triu_indices(len(values[-1])))]
    while todo:
        k, i, j = todo.pop()
        near = np.bitwise_count((values[k][i] ^ values[k][j]) & masks[k][i] & masks[k][j]) <= d
        if k == 0:
            near &= i < j
            parent = local_components(parent, i[near], j[near])
            continue
        low, high = np.minimum.reduceat(parent, starts[k]), np.maximum.reduceat(parent, starts[k])
        i, j = i[near], j[near]
        joined = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])  # one component already
        i, j = i[~joined], j[~joined]
        if len(i) * FAN * FAN > step and len(i) > 1:
            half = len(i) // 2
            todo += [(k, i[half:], j[half:]), (k, i[:half], j[:half])]
            continue
        ci = np.broadcast_to((i[:, None] * FAN + grid)[:, :, None], (len(i), FAN, FAN)).ravel()
        cj = np.broadcast_to((j[:, None] * FAN + grid)[:, None, :], (len(j), FAN, FAN)).ravel()
        inside = (cj < len(values[k - 1])) & (ci <= cj)
        todo.append((k - 1, ci[inside], cj[inside]))
    return parent


def link_sorted(codes: np.ndarray, ends: np.ndarray, d: int, small: int = 32) -> np.ndarray:
    """For codes sorted by group and, within one, Gray rank: the row of the root of each row's component, by links of at
    most d bits within a group. ends[i] is the row after the last one of i's group."""
    n = len(codes)
    parent = np.arange(n)
    rows, k = np.arange(n), 1
    while len(rows := rows[rows + k < ends[rows]]) and k < small:  # neighbours first: all pairs of a small group
        near = np.bitwise_count(codes[rows] ^ codes[rows + k]) <= d
        parent = local_components(parent, rows[near], rows[near] + k)
        k += 1
    heads = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if n else rows
    for a in heads[ends[heads] - heads > small]:
        b = ends[a]
        parent[a:b] = a + _tree(codes[a:b], d, parent[a:b] - a)
    return parent


def _stars(d: int, hold: int = 1 << 20):
    """mapInArrow over rows (mask, pattern, id, fingerprint) sorted by node and Gray rank: (a, b) from each row to its root."""

    def solve(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.r_[True, (x["mask"][1:] != x["mask"][:-1]) | (x["pattern"][1:] != x["pattern"][:-1])]
        heads = np.flatnonzero(new)
        ends = np.r_[heads[1:], len(new)][np.cumsum(new) - 1]
        parent = link_sorted(x["fingerprint"].view(np.uint64), ends, d)
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.RecordBatch.from_arrays([pa.array(x["id"][moved]), pa.array(x["id"][parent[moved]])], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        join = lambda: {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        for b in batches:
            if b.num_rows:
                held.append({k: b.column(k).to_numpy(zero_copy_only=False) for k in ("mask", "pattern", "id", "fingerprint")})
            if sum(len(h["id"]) for h in held) >= hold:
                x = join()
                last = np.flatnonzero((x["mask"] != x["mask"][-1]) | (x["pattern"] != x["pattern"][-1]))
                if len(last):  # the last node may go on in the next batch
                    at = last[-1] + 1
                    yield solve({k: v[:at] for k, v in x.items()})
                    held[:] = [{k: v[at:] for k, v in x.items()}]
                else:
                    held[:] = [x]
        if held:
            yield solve(join())

    return each


def link_fingerprints(found: DataFrame, distance: int = 3, node_rows: int = 4096) -> DataFrame:
    """(fingerprint, component_id) for the distinct fingerprints of (id bigint, fingerprint bigint).

    component_id is the smallest id reachable over links of at most `distance` differing bits. A node of more than
    `node_rows` distinct fingerprints is divided over its free bits, again and again: at distance 3 the free bits are 48,
    36, 27, 21, 16 and 12 at most, and a node of 12 free bits holds 4,096 fingerprints at most. Division ends by itself
    there, or, for a smaller `node_rows`, where there are no more free bits than parts. Rows with a null id are left out.
    """
    parts = distance + 1
    firsts = cut(found.where("id is not null and fingerprint is not null").groupBy("fingerprint").agg(F.min("id").alias("id")))
    masks = [signed(m) for m in divide(0, parts)]
    node = F.col("fingerprint").bitwiseAND(F.col("mask")).alias("pattern")
    rows = firsts.withColumn("mask", F.explode(F.array(*map(F.lit, masks)))).select("mask", node, "id", "fingerprint")
    done: list[DataFrame] = []
    while masks:
        hot = cut(rows.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_rows).drop("n"))
        masks = [r["mask"] for r in hot.select("mask").distinct().collect()]  # parts ** level of them at most
        masks = [m for m in masks if 64 - (m & (1 << 64) - 1).bit_count() > parts]
        if not masks:
            break
        hot = hot.where(F.col("mask").isin(masks))
        done.append(rows.join(hot, ["mask", "pattern"], "left_anti"))
        children = {m: [signed(c) for c in divide(m & (1 << 64) - 1, parts)] for m in masks}
        masks = [c for cs in children.values() for c in cs]
        below = F.create_map(*[x for m, cs in children.items() for x in (F.lit(m), F.array(*map(F.lit, cs)))])
        rows = rows.join(hot, ["mask", "pattern"], "left_semi").select(F.explode(below[F.col("mask")]).alias("mask"), "id", "fingerprint").select("mask", node, "id", "fingerprint")
    for other in done:
        rows = rows.unionByName(other)
    stars = rows.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", gray_rank(F.col("fingerprint"))).mapInArrow(_stars(distance), "a bigint, b bigint")
    groups = components(stars)
    return firsts.join(groups, firsts["id"] == groups["node"], "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(id_col, fingerprint bigint, component_id): every row of `docs` with the group of near duplicates it belongs to.

    Null and empty texts have fingerprint 0 and link like any other. A row with a null id gets a fingerprint and no
    component; repeated rows come back repeated. Extra columns are ignored. An empty table gives an empty result.
    """
    found = cut(fingerprints(docs, id_col, text_col, shingle))
    groups = link_fingerprints(found.select(F.col(id_col).alias("id"), "fingerprint"), distance)
    return found.join(groups, "fingerprint", "left").select(id_col, "fingerprint", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
