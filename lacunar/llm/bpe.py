"""Byte-level BPE encoding and decoding with a given rank file.

A word is one match of the splitting pattern. Its bytes are folded: the adjacent pair with the lowest rank, the first of
equals, becomes one piece until no pair has a rank. `with_ids` does so with Spark's higher-order functions over a literal
rank map, once for each distinct word. Texts stay where they are: one pass over them writes, block by block, each text as
numbers of words and the block's words; only the words move to be folded, and their ids move back to their block. Common
words, a table of fixed length, are folded beforehand and don't move. Decoding is higher-order functions too: the ids
index a literal array of pieces and the pieces are concatenated.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacunar.sources.shared import dealt, short_batches


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Piece and rank from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


NEVER = 1 << 60


SHORT = 64


def fold(word: bytes, ranks: dict[bytes, int], short: int = SHORT) -> list[int]:
    """Ids of one word. Up to `short` bytes the pairs' ranks are a list that is searched for its least; a heap of pairs
    keeps longer words near-linear."""
    if word in ranks:
        return [ranks[word]]
    return _fold_short(word, ranks) if len(word) <= short else _fold_long(word, ranks)


def _fold_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != NEVER:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that starts here
    before = list(range(-1, n - 1))  # start of the piece before
    alive = [True] * n
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not alive[i] or mid >= n or end[mid] != stop:
            continue  # one of the two has been merged since
        end[i], alive[mid] = stop, False
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Open(Exception):
    """A piece of a text that the next piece may belong to."""


class _Block(dict):
    """Words of some texts, numbered as they come, after the common ones. As a dictionary: the packed numbers of the words
    in a blank and a piece that has no blank, found when first asked for."""

    def __init__(self, split, blanks: bool, common: dict[str, int]):
        self.split, self.blanks, self.words, self.length = split, blanks, dict(common), 0
        self.name = int.from_bytes(os.urandom(8)) >> 1

    def pack(self, text: str) -> bytes:
        n = self.words
        return array("i", [n.setdefault(w, len(n)) for w in self.split(text)]).tobytes()

    @staticmethod
    def planes(packed: bytes) -> bytes:
        """The numbers' first bytes, then their second ones, and so on: high bytes are mostly zero and compress well so."""
        return np.frombuffer(packed, np.uint8).reshape(-1, 4).T.tobytes()

    @staticmethod
    def numbers(planes: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[-1].isspace():
            raise _Open
        if len(self) > 1 << 18:
            self.clear()
        self[piece] = packed = self.pack(" " + piece)
        return packed

    def add(self, text: str) -> bytes:
        """Packed numbers of a text's words."""
        pieces = text.split(" ") if self.blanks else [text]
        try:
            packed = b"".join([self.pack(pieces[0]), *map(self.__getitem__, pieces[1:-1])]) if len(pieces) > 1 and not pieces[0][-1:].isspace() else None
            packed = self.pack(text) if packed is None else packed + self.pack(" " + pieces[-1])
        except _Open:
            packed = self._runs(pieces)
        self.length += len(packed)
        return self.planes(packed)

    def _runs(self, pieces: list[str]) -> bytes:
        """As add(), for texts with blanks after other white space: pieces go together until one ends in something else."""
        out, run = [], pieces[0]
        for piece in pieces[1:]:
            if run and not run[-1].isspace():
                out.append(self[run[1:]] if out and " " not in run[1:] else self.pack(run))
                run = " " + piece
            else:
                run += " " + piece
        return b"".join([*out, self.pack(run)])


LONG = 256


def _common(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str, rows: int, most: int) -> pa.Table:
    """(word, ids) of the words that occur most, and twice at least, in about `rows` texts drawn from all; `most` at most."""
    spark = docs.sparkSession

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(pattern).findall, Counter()
        for b in batches:
            for text in b.column(0):
                seen.update(split(text.as_py() or ""))
            if len(seen) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    drawn = docs.select(F.col(text_col).alias("text")).sample(min(1.0, rows / max(1, docs.count())), 5)
    counts = drawn.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= LONG))
    words = spark.createDataFrame(counts.orderBy(F.desc("n"), "word").limit(most).select("word").toArrow())
    dealt_out = words.withColumn("at", F.monotonically_increasing_id()).repartition(2 * spark.sparkContext.defaultParallelism)
    return with_ids(dealt_out, F.col("word"), ranks).toArrow().sort_by("at")


def _numbered(docs: DataFrame, pattern: str, id_col: str, text_col: str, blanks: bool, hold: int, common: dict[str, int]) -> DataFrame:
    """(block, id, codes, words): a row for each text with its packed word numbers, and one for each block with its words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        block = None

        def rows(ids: pa.Array, codes: list[bytes]) -> pa.RecordBatch:
            n = len(codes)
            return pa.RecordBatch.from_arrays([pa.array([block.name] * n, pa.int64()), ids, pa.array(codes, pa.binary()), pa.nulls(n, pa.list_(pa.string()))], ["block", "id", "codes", "words"])

        def words(id_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block.name], pa.int64()), pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([list(islice(block.words, len(common), None))], pa.list_(pa.string()))], ["block", "id", "codes", "words"])

        for b in batches:
            at, codes, size, id_type = 0, [], 0, b.column(0).type
            for i in range(b.num_rows):
                block = _Block(split, blanks, common) if block is None else block  # one without pieces is false
                codes.append(block.add(b.column(1)[i].as_py() or ""))
                size += len(codes[-1])
                full = len(block.words) - len(common) > hold or block.length > 1 << 25
                if full or size > 1 << 24 or i == b.num_rows - 1:
                    yield rows(b.column(0).slice(at, len(codes)), codes)
                    at, codes, size = i + 1, [], 0
                if full:
                    yield words(id_type)
                    block = None
        if block is not None:
            yield words(id_type)

    return docs.select(id_col, F.col(text_col)).mapInArrow(each, f"block long, id {kind}, codes binary, words array<string>")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", blanks: bool = False, hold: int = 1 << 18, sample_rows: int = 8192, most: int = 1 << 17) -> DataFrame:
    """(id_col, ids array<int>): the ids of each whole text, without special tokens. Null and empty texts have none.

    Every row comes back once, repeated rows and null ids too; extra columns are ignored. `blanks` says that by this
    pattern no match goes on from a character that isn't white space into a blank, as is true of the usual ones: texts are
    then cut there first, and each distinct piece is matched once. The common words are `most` at most, from about
    `sample_rows` texts drawn from all. A block ends after a text by which it has more than `hold` other words, or 8 million
    words in all. Ids don't depend on these three. A word goes to one task with one row for each block that has it. Words
    over 256 bytes, for which the higher-order fold takes its square, are folded by a heap.
    """
    short_batches(docs.sparkSession)
    known = _common(docs, ranks, pattern, text_col, sample_rows, most)
    common = {w: i for i, w in enumerate(known.column("word").to_pylist())}
    known_ids = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(c.cast(pa.list_(pa.int32())) for c in known.column("ids").chunks)])
    known_flat, known_starts = known_ids.flatten().to_numpy(), np.cumsum([0, *known_ids.value_lengths().to_numpy()], dtype=np.int64)
    n = max(1, min(docs.rdd.getNumPartitions(), 100_000))
    kept = dealt(_numbered(docs, pattern, id_col, text_col, blanks, hold, common), n, ["block"], shuffle=False, codec="zstd")
    words = kept.where("words IS NOT NULL").select("block", F.posexplode("words").alias("code", "word"))
    words = words.repartition(max(n, docs.sparkSession.sparkContext.defaultParallelism), "word")
    same = Window.partitionBy("word").orderBy("block")
    words = words.withColumn("nth", F.row_number().over(same))
    long = F.octet_length("word") > LONG
    words = with_ids(words, F.when((F.col("nth") == 1) & ~long, F.col("word")), ranks)
    words = words.select("block", "code", F.first("ids", ignorenulls=True).over(same).alias("ids"), F.when(long, F.col("word")).alias("long"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def each(texts: pa.Table, words: pa.Table) -> pa.Table:
        words = words.combine_chunks().sort_by("code")
        of = words.column("ids").to_pylist() if words.column("long").null_count < words.num_rows else None
        if of is not None:
            of = [fold(w.encode(), ranks) if w is not None else x for x, w in zip(of, words.column("long").to_pylist(), strict=True)]
            ids = pa.array(of, pa.list_(pa.int32()))
        else:
            ids = pa.concat_arrays(words.column("ids").chunks) if words.num_rows else pa.array([], pa.list_(pa.int32()))
        flat = np.concatenate([known_flat, ids.flatten().to_numpy()])
        lens = np.concatenate([np.diff(known_starts), ids.value_lengths().to_numpy()])
        starts = np.cumsum(lens) - lens
        out = []
        for b in texts.to_batches(max_chunksize=1024):
            names, codes = b.column("id"), b.column("codes").to_pylist()
            at = 0
            while at < len(codes):
                end, size = at, 0
                while end < len(codes) and size < 1 << 22:
                    size += len(codes[end])
                    end += 1
                numbers = np.concatenate([_Block.numbers(c) for c in codes[at:end]])
                n = lens[numbers]
                ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                where = np.arange(ends[-1]) + np.repeat(starts[numbers] - ends[:-1], n)
                texts_end = ends[np.cumsum([0, *(len(c) // 4 for c in codes[at:end])])]
                out.append(pa.RecordBatch.from_arrays([names.slice(at, end - at), pa.ListArray.from_arrays(pa.array(texts_end, pa.int32()), pa.array(flat[where], pa.int32()))], [id_col, "ids"]))
                at = end
        return pa.Table.from_batches(out, pa.schema([(id_col, texts.schema.field("id").type), ("ids", pa.list_(pa.int32()))]))

    texts = kept.where("codes IS NOT NULL").select("block", "id", "codes")
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(each, f"`{id_col}` {id_type}, ids array<int>")


def with_bytes(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "bytes") -> DataFrame:
    """`rows` with the bytes that the column `ids` stands for; null ids give null. The pieces are joined as hexadecimal text,
    which takes time in proportion to their length, where binary values joined one by one would take its square. As in
    with_ids(), the literal table of pieces is a row that a scalar subquery hands over, so plans don't carry its text."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = rows.sparkSession.createDataFrame(pa.table({"pieces": pa.array([pieces], pa.list_(pa.string()))}))
    held = rows.withColumn("_pieces", table.scalar())  # this and the next projection become one
    return held.select(*rows.columns, F.unhex(F.array_join(F.transform(ids, lambda i: F.get("_pieces", i)), "")).alias(into))


def joined_ids(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


#: Bits of an id, of a place in the word, and of both. A rank above all others stands for none.
SHIFT, PLACE = 17, 28
ABOVE = SHIFT + PLACE
NONE = 1 << SHIFT + ABOVE


def _let(value: Column, use, like: Column | None = None) -> Column:
    """use(value) with the value computed once: lambdas know no common subexpressions, but bind their argument. What a
    transform returns is copied; where the result is an array and a column `like` it is there, an aggregate copies none."""
    return F.transform(F.array(value), use)[0] if like is None else F.aggregate(F.array(value), like, lambda _, x: use(x))


@lru_cache(4)
def _pair_table(pieces: tuple[bytes, ...]) -> tuple[np.ndarray, int, int]:
    """The rank of every pair of pieces that make a piece, as two hash tables in one list of numbers, each at the
    remainder of its key by a prime (cuckoo hashing): pair times 2 ** SHIFT plus rank, -1 where there is none."""
    known = {p: r for r, p in enumerate(pieces) if p}
    todo = [(known[p[:k]] << SHIFT | known[p[k:]], r) for p, r in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
    prime = lambda n: next(k for k in range(n, 2 * n) if all(k % d for d in range(2, int(k**0.5) + 1)))
    a = prime(max(7, len(todo)))
    b = prime(a + 2)
    held: list[tuple[int, int] | None] = [None] * (a + b)
    for item in todo:
        side = 0
        for _ in range(10_000):
            at = a + item[0] % b if side else item[0] % a
            held[at], item = item, held[at]
            if item is None:
                break
            side = 0 if at >= a else 1
        else:
            raise ValueError("the pairs don't fit their table")
    return np.array([x[0] << SHIFT | x[1] if x else -1 for x in held], np.int64), a, b


@lru_cache(4)
def _unreached(pieces: tuple[bytes, ...]) -> list[tuple[bytes, int]]:
    """Pieces, with their ranks, that folding their bytes doesn't lead to; trained vocabularies have none."""
    ranks = {p: r for r, p in enumerate(pieces) if p}
    return [(p, r) for p, r in ranks.items() if len(_fold_short(p, ranks) if len(p) <= SHORT else _fold_long(p, ranks)) > 1]


def _tables(spark: SparkSession, pieces: tuple[bytes, ...], buckets: int) -> DataFrame:
    """One row with what the fold looks up: `pairs` (see _pair_table), `start`, the elements of the fold for a byte and
    the next one (256: none) at place 0, and the ids of pieces that the fold doesn't reach in hexadecimal, as small maps
    found by hash since a map is searched from its start."""
    ranks = {p: r for r, p in enumerate(pieces) if p}
    start = [(ranks.get(bytes([x, y]), NONE >> ABOVE) << ABOVE if y < 256 else NONE) | ranks[bytes([x])] for x in range(256) for y in range(257)]
    columns = {"pairs": pa.array([_pair_table(pieces)[0]], pa.list_(pa.int64())), "start": pa.array([start], pa.list_(pa.int64()))}
    if left := _unreached(pieces):
        small: list[list[tuple[str, int]]] = [[] for _ in range(buckets)]
        for piece, r in left:
            small[crc32(piece) % buckets].append((piece.hex().upper(), r))
        columns["whole"] = pa.array([small], pa.list_(pa.map_(pa.string(), pa.int32())))
    return spark.createDataFrame(pa.table(columns)).select(F.struct(*columns).alias("t"))


def with_ids(words: DataFrame, word: Column, ranks: dict[bytes, int], buckets: int = 1 << 15) -> DataFrame:
    """`words` with the column `ids`: the ids of the column `word`, by higher-order functions alone.

    A word's bytes become elements: in one number the rank of the pair that an element makes with the next, the place of
    its first byte, and its id. The least element is the pair of the lowest rank, the first of equals. Each step of the
    fold merges it and looks up the two pairs that the merge makes. The rank tables are a literal row that a scalar
    subquery hands to the fold: written into the expression they would be part of every plan's text, some 9 MB that the
    driver builds and keeps for each query and update. A word of n bytes takes time in proportion to n squared; null words
    give null. Every single byte must be a piece, and ranks be below 131,072."""
    if max(ranks.values(), default=0) >= 1 << SHIFT or any(bytes([k]) not in ranks for k in range(256)):
        raise ValueError("every byte must have a rank, and ranks be below 131,072")
    by_rank = [b""] * (max(ranks.values()) + 1)
    for piece, r in ranks.items():
        by_rank[r] = piece
    pieces = tuple(by_rank)
    tables = _tables(words.sparkSession, pieces, buckets)
    _, a, b = _pair_table(pieces)
    none = F.array().cast("array<int>")
    id_bits, place_bits = F.lit((1 << SHIFT) - 1), F.lit((1 << ABOVE) - (1 << SHIFT))

    def ids_of(known: Column) -> Column:
        def id_(e: Column) -> Column:
            return e.bitwiseAND(id_bits)

        def element(x: Column, y: Column, low: Column) -> Column:
            """Of the ids x and y; `low` is the element's place and id."""

            def probe(k: Column) -> Column:
                held = [F.get(known["pairs"], at.cast("int")) for at in (k % a, k % b + a)]
                found = [(F.shiftright(e, SHIFT) == k, id_(e) * (1 << ABOVE)) for e in held]
                return F.when(*found[0]).when(*found[1]).otherwise(NONE) + low

            return _let(x * (1 << SHIFT) + y, probe)

        def merge(s: Column, _: Column) -> Column:
            def at(m: Column, i: Column) -> Column:
                new = F.shiftright(m, ABOVE)
                low = m.bitwiseAND(place_bits).bitwiseOR(new)
                after = F.slice(s, i + 2, F.size(s))
                right = F.when(i + 1 < F.size(s), element(new, id_(F.get(s, i + 1)), low)).otherwise(low + NONE)
                left = _let(F.get(s, i - 2), lambda e: element(id_(e), new, e.bitwiseAND(F.lit((1 << ABOVE) - 1))))
                return F.when(i > 1, F.concat(F.slice(s, F.lit(1), i - 2), F.array(left, right), after)).otherwise(F.concat(F.array(right), after))

            return _let(F.array_min(s), lambda m: F.when(m >= NONE, s).otherwise(_let(F.array_position(s, m).cast("int"), lambda i: at(m, i), like=s)), like=s)

        raw = F.encode(word, "UTF-8")
        letters = F.slice(F.split(F.decode(raw, "ISO-8859-1"), ""), F.lit(1), F.octet_length(word))
        begin = _let(F.transform(letters, F.ascii), lambda p: F.transform(p, lambda x, i: F.get(known["start"], x * 257 + F.coalesce(F.get(p, i + 1), F.lit(256))) + i * (1 << SHIFT)))
        steps = F.transform(F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), begin, merge), lambda e: id_(e).cast("int"))
        if _unreached(pieces):
            whole = F.element_at(F.get(known["whole"], (F.crc32(raw) % buckets).cast("int")), F.hex(raw))
            steps = _let(whole, lambda w: F.when(w.isNotNull(), F.array(w)).otherwise(steps))
        return F.when(F.octet_length(word) == 0, none).otherwise(steps)

    # the subquery is a column for the analyser only, which wants none within a higher-order function; the two projections
    # become one
    held = words.withColumn("_rank_tables", tables.scalar())
    return held.select(*words.columns, F.when(word.isNotNull(), _let(F.col("_rank_tables"), ids_of)).alias("ids"))


def fold_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """(word_col, ids array<int>) for a table of distinct words."""
    return with_ids(words.select(word_col), F.col(word_col), ranks)
