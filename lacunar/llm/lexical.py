"""Ranked lexical search: an index of posting lists in blocks of varying length, searched by block-max WAND.

Documents are read once. What stays of a document is its length and its occurrences of the terms that the queries ask
for; from this table come the counts that all documents decide (N, L and the terms' frequencies), and then the scores.
A shard is a stretch of the table that fits in memory, put in order of doc_id. There each term's postings are cut into
blocks by dynamic programming, so that the sum over all postings of (their block's largest score less their own) plus a
cost for each block is least. A search adds up the bounds of the blocks that lie over each document and takes the lists
by their largest scores: only a document of a list whose bound, with those of all lists after it, still reaches the
threshold can be a pivot, and only blocks are read over which the bounds reach it. Pivots are found for a shard at once,
in waves that each raise the threshold for the next; it also carries over to the next shard of a task. What leaves a
task are its best documents for each query, so nothing grows with the lists.

No shuffle moves postings, and no document depends on how many others hold its terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: A term of the contract, on UTF-8 bytes: ASCII letters and digits and all that isn't ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a long text that are taken apart at a time, and units that a posting list is cut into at most before blocks are chosen.
PIECE, UNITS = 1 << 20, 512


def term_counts(text: bytes | None) -> tuple[int, Counter]:
    """Number of terms, with repeats, and how often each occurs; A-Z count as a-z. Null has none."""
    text, at, counts = text or b"", 0, Counter()
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        counts.update(TERM.findall(text[at:end].lower()))
        at = end
    return counts.total(), counts


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id bigint, n bigint, terms array<int>, tfs array<int>): each document's length in terms, and the terms of the
    vocabulary that it holds, ascending, with their occurrences."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ends, terms, tfs = [], [0], [], []
            for text in b.column(1).cast(pa.large_binary()):
                n, counts = term_counts(text.as_py())
                held = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                lengths.append(n)
                ends.append(ends[-1] + len(held))
                terms += (t for t, _ in held)
                tfs += (c for _, c in held)
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], ["id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(each, "id bigint, n bigint, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    """A term's weight: floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What an occurrence count adds to the score, before its term's weight; n is the document's length."""
    m = 75 + 25 * n * n_docs // max(1, total)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def block_starts(scores: np.ndarray, begin: np.ndarray, cost: float = 4.0, longest: int = 64) -> np.ndarray:
    """Where blocks begin in posting lists that lie one after another; list i is scores[begin[i]:begin[i + 1]].

    The blocks of a list minimise the sum over its postings of (largest score in the block - own score), plus `cost`
    times the list's mean score for each block. Lists of up to UNITS postings are cut anywhere, longer ones between
    units of equal length; a block has `longest` units at most. All lists take the steps of the programme together: a
    step looks at the blocks that end in the next unit of each list.
    """
    size = np.diff(begin)
    run = -(-size // UNITS)
    units = np.where(size > 0, -(-size // np.maximum(run, 1)), 0)
    off = np.cumsum(units) - units
    owner = np.repeat(np.arange(len(size)), units)
    at = begin[:-1][owner] + (np.arange(len(owner)) - off[owner]) * run[owner]  # where each unit begins
    if not len(at):
        return at
    top = np.maximum.reduceat(scores, at).astype(float)
    count = np.diff(np.r_[at, len(scores)]).astype(float)
    price = cost * np.add.reduceat(scores, begin[:-1][size > 0]) / size[size > 0]
    order = np.argsort(-units[size > 0], kind="stable")
    first, n_units, price = off[size > 0][order], units[size > 0][order], price[order]
    chosen = np.zeros(len(at), np.int64)
    # of the blocks of 1, 2, ... units that end here: largest score, postings, and the best total before them
    most, held, before = (np.full((len(first), longest), fill) for fill in (0.0, 0.0, np.inf))
    best = np.zeros(len(first))
    for i in range(int(n_units[0])):
        k = int(np.searchsorted(-n_units, -i, side="left"))  # the lists that have a unit i
        here = first[:k] + i
        most, held, before, best = most[:k], held[:k], before[:k], best[:k]
        most[:, 1:] = np.maximum(most[:, :-1], top[here][:, None])
        held[:, 1:] = held[:, :-1] + count[here][:, None]
        before[:, 1:] = before[:, :-1]
        most[:, 0], held[:, 0], before[:, 0] = top[here], count[here], best
        total = before + most * held
        pick = total.argmin(1)
        chosen[here] = pick + 1
        best = total[np.arange(k), pick] + price[:k]
    is_start, left, base = np.zeros(len(at), bool), n_units.copy(), first
    while len(left):
        left = left - chosen[base + left - 1]
        is_start[base + left] = True
        base, left = base[left > 0], left[left > 0]
    return at[is_start]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0], ..., last[0] - 1, first[1], ... as one array."""
    size = last - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Shard:
    """The index of some documents: posting lists in blocks, documents numbered in order of their ids (null last)."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_docs: int, total: int, cost: float = 4.0):
        self.n_docs = len(ids)
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        score = impacts(tfs.astype(np.int64), n[doc], n_docs, total)
        order = np.argsort(terms, kind="stable")
        self.doc, self.score, terms = doc[order], score[order], terms[order]
        self.terms, begin = np.unique(terms, return_index=True)
        begin = np.r_[begin, len(terms)]
        self.key = np.repeat(np.arange(len(self.terms)), np.diff(begin)) * (self.n_docs + 1) + self.doc  # ascending: list, then document
        self.start = block_starts(self.score, begin, cost)
        self.end = np.r_[self.start[1:], len(terms)]
        self.low, self.high = (self.doc[self.start], self.doc[self.end - 1]) if len(terms) else (self.start, self.start)
        self.top = np.maximum.reduceat(self.score, self.start) if len(terms) else self.start
        self.most = np.maximum.reduceat(self.score, begin[:-1]) if len(terms) else self.start  # of each list
        self.blocks = np.searchsorted(self.start, begin)  # the blocks of list i: blocks[i] to blocks[i + 1]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1, wave: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with a score of `least` or more, best first, equal scores by number.

        Lists are taken by the largest score in them, highest first, until those left add up to less than the k-th best
        score so far: a document that stands in none of the lists taken can't be a pivot any more. Of a list only the
        blocks are read that hold a place where the bounds of the blocks there, of all lists, reach the threshold. Each
        wave of lists has twice the postings of the one before."""
        none = np.zeros(0, np.int64)
        at = np.searchsorted(self.terms, terms)
        there = (at < len(self.terms)) & (weights > 0)
        there[there] = self.terms[at[there]] == terms[there]
        at, weights = at[there], weights[there]
        if not len(at):
            return none, none
        order = np.argsort(-self.most[at] * weights, kind="stable")
        at, weights = at[order], weights[order]
        first, last = self.blocks[at], self.blocks[at + 1]
        b, edge = _ranges(first, last), self.n_docs + 1
        by = np.repeat(weights, last - first)
        # whole numbers below 2 ** 53, so sums of doubles are exact
        bound = np.cumsum(np.bincount(self.low[b], self.top[b] * by, edge) - np.bincount(self.high[b] + 1, self.top[b] * by, edge))[:-1]
        rest = np.cumsum((self.most[at] * weights)[::-1])[::-1]  # what the lists from here on can add to a score at most
        size = np.cumsum(self.end[last - 1] - self.start[first])
        found, scores, seen, j, least = none, none, np.zeros(self.n_docs, bool), 0, max(1, least)
        while j < len(at) and rest[j] >= least:
            to = max(j + 1, int(np.searchsorted(size, (size[j - 1] if j else 0) + wave, side="right")))
            live = (bound >= least) & ~seen
            before = np.r_[0, np.cumsum(live)]
            own = _ranges(first[j:to], last[j:to])
            own = own[before[self.high[own] + 1] > before[self.low[own]]]
            docs = np.unique(self.doc[_ranges(self.start[own], self.end[own])])
            docs = docs[live[docs]]
            seen[docs] = True
            sums = self._scores(at, weights, docs)
            good = sums >= least
            found, scores = np.r_[found, docs[good]], np.r_[scores, sums[good]]
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
            if len(found) == k:
                least = max(least, int(scores[-1]))
            j, wave = to, 2 * wave
        return found, scores

    def _scores(self, lists: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The documents' scores. Few documents are sought in every list; for more, the blocks that may hold them are read."""
        if not len(docs):
            return np.zeros(0, np.int64)
        first, last = self.blocks[lists], self.blocks[lists + 1]
        if 4 * len(docs) * len(lists) < (self.end[last - 1] - self.start[first]).sum():
            want = lists[:, None] * (self.n_docs + 1) + docs
            p = np.minimum(np.searchsorted(self.key, want.ravel()), len(self.key) - 1)
            hit = (self.key[p] == want.ravel()).reshape(want.shape)
            return (self.score[p].reshape(want.shape) * hit * weights[:, None]).sum(0)
        place = np.full(self.n_docs, -1)
        place[docs] = np.arange(len(docs))
        before = np.r_[0, np.cumsum(place >= 0)]
        b, by = _ranges(first, last), np.repeat(weights, last - first)
        met = before[self.high[b] + 1] > before[self.low[b]]
        b, by = b[met], by[met]
        p = _ranges(self.start[b], self.end[b])
        at = place[self.doc[p]]
        own = at >= 0
        return np.bincount(at[own], (self.score[p] * np.repeat(by, self.end[b] - self.start[b]))[own], len(docs)).astype(np.int64)


def _searched(queries: list[tuple[int | None, np.ndarray, np.ndarray]], n_docs: int, total: int, k: int, docs: int, postings: int, cost: float):
    """mapInArrow over occurrences(): the task's k best documents (item_id, doc_id, score) of every query."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int, int | None]]] = [[] for _ in queries]  # (-score, null last, id)

        def take(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.sort_by("id")  # nulls come last
            column = lambda c: t.column(c).combine_chunks() if t.num_rows else t.column(c).chunk(0)
            terms, tfs = column("terms"), column("tfs")
            ends = terms.offsets.to_numpy() - terms.offsets[0].as_py()
            ids = t.column("id").to_pylist()
            shard = Shard(np.arange(len(ids)), t.column("n").to_numpy(), ends, terms.flatten().to_numpy(), tfs.flatten().to_numpy(), n_docs, total, cost)
            for own, (_, asked, weights) in zip(best, queries, strict=True):
                least = -own[-1][0] if len(own) == k else 1
                for d, s in zip(*(x.tolist() for x in shard.search(asked, weights, k, least)), strict=True):
                    own.append((-s, ids[d] is None, ids[d]))
                own.sort(key=lambda x: (x[0], x[1], x[2] or 0))
                del own[k:]

        held, n = [], [0, 0]
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                ends = whole.column(2).offsets.to_numpy()[at : whole.num_rows + 1]
                room = max(1, min(docs - n[0], int(np.searchsorted(ends, ends[0] + postings - n[1], side="right")) - 1))
                part = whole.slice(at, room)
                at += part.num_rows
                held.append(part)
                n = [n[0] + part.num_rows, n[1] + int(ends[part.num_rows] - ends[0])]
                if n[0] >= docs or n[1] >= postings or at < whole.num_rows:
                    take(held)
                    held, n = [], [0, 0]
        if held:
            take(held)
        rows = [(q[0], i, -s) for q, own in zip(queries, best, strict=True) for s, _, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return each


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_docs: int = 1 << 14, shard_postings: int = 1 << 21, block_cost: float = 4.0, most_terms: int = 1 << 18) -> DataFrame:
    """(item_id bigint, rank int, doc_id bigint, score bigint): the k best documents for each item, all of them searched.

    The items are the query set: their terms are collected, `most_terms` (about 32 MB) at a time; if they have more,
    they are taken in groups, each searched against all documents. Rows that share an item id are one item with the
    terms of all of them, null is an id like any other; items without a term get no row. Null and empty documents have
    no term. Documents that share an id are ranked one by one, a null id stands last among equal scores. `shard_docs`
    and `shard_postings` bound a shard, and with it memory; `block_cost` is what a block costs (see block_starts()).
    Other columns are ignored.
    """
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # at most half as many terms
    groups = max(1, -(-size // (2 * most_terms)))
    out = [_group_search(docs, asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g) if groups > 1 else asked, k, id_col, text_col, shard_docs, shard_postings, block_cost) for g in range(groups)]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def _group_search(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, shard_docs: int, shard_postings: int, cost: float) -> DataFrame:
    bags: dict[int | None, Counter] = {}
    for r in asked.collect():
        bags.setdefault(r["item"], Counter()).update(term_counts((r["text"] or "").encode())[1])
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*bags.values())))}
    found = store(occurrences(docs, vocabulary, id_col, text_col), "postings")
    size = found.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, total = size["docs"] or 0, size["terms"] or 0
    df = {r["t"]: r["df"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}  # as long as the vocabulary
    queries = []
    for item, bag in bags.items():
        terms = np.array(sorted(vocabulary[t] for t in bag), np.int64)
        times = {vocabulary[t]: c for t, c in bag.items()}
        queries.append((item, terms, np.array([times[t] * weight(n_docs, df.get(t, 0)) for t in terms.tolist()], np.int64)))
    best = found.mapInArrow(_searched(queries, n_docs, total, k, shard_docs, shard_postings, cost), "item_id bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
