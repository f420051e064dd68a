"""Removal of lines that many documents repeat, without moving text through the counting steps.

Every long line leaves its document as a row (128-bit hash of its key, document, position). The rows are partitioned by
range of (hash, document descending) and sorted by position on top, so a line that stands in a third of all documents
is cut between documents and spread over many partitions. In that order the rows stream past once: a run of equal
(hash, document) is one document that holds the line, the first row of a run of one hash is its first occurrence,
which stays. Each partition leaves one row per run of a hash, its number of documents and its first one; runs that go
on in the next partition are joined by these rows alone.

What comes back to a document is a compressed bitmap of the lines to keep, never text: words of 64 lines, of which
those that are all ones are left out and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, cut, row_of, store

HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def stripped(line: Column) -> Column:
    """The line without white space at its ends. The general trim is slow, so it only sees lines that need it."""
    ends = F.substring(line, 1, 1).isin(*WHITE) | F.substring(line, -1, 1).isin(*WHITE)
    return F.when(ends, F.btrim(line, F.lit(WHITE))).otherwise(line)


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, after, version, pos) of the lines whose keys have `min_chars` code points or more.

    `after` is the id with its bits turned, which puts documents in descending order without overflow; `version` is a
    hash of the whole text and tells rows that share an id apart."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.bitwise_not(F.col(id_col).cast("long")).alias("after"), F.xxhash64(text_col).alias("version"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    rows = rows.where(F.octet_length("line") >= min_chars).withColumn("line", stripped(F.col("line"))).where(F.char_length("line") >= min_chars)
    rows = rows.withColumn("key", ascii_lower(F.col("line")))
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "after", "version", "pos")


def first_occurrences(rows: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, first) of the hashes that `min_docs` documents hold: `first` is the document that keeps its lines."""
    ranged = rows.repartitionByRange(*HASH, "after").sortWithinPartitions(*HASH, "after", "pos")
    # the range partitions hold each (hash, document) whole and in order, so this window streams over them as they are;
    # of the aggregate, one row per partition and hash is shuffled
    firsts = ranged.withColumn("place", F.row_number().over(Window.partitionBy(*HASH, "after").orderBy("pos"))).where("place = 1")
    runs = firsts.groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"), F.min("after").alias("first"))
    return runs.where(F.col("docs") >= min_docs).select(*HASH, "first")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, broadcast_rows: int = 1 << 20) -> DataFrame:
    """(id, version, keep array<struct<gap int, bits bigint>>, n_dropped bigint) for the documents that lose lines.

    `keep` lists words of 64 lines in order: bit p % 64 of a word says whether line p stays; `gap` words of all ones were
    left out before it, and all that follow the last. A key of at least `min_chars` code points that stands in at least
    `min_docs` documents keeps only its lines in the document with the largest id. Null texts have one empty line, which
    always stays. Rows with a null id count as no document and lose nothing; rows that share an id count as one
    document. Extra columns are ignored.

    Up to `broadcast_rows` hashes that repeat (32 MB) go to the executors as they are; more are joined by a shuffle,
    where both sides are plain, so that Spark can split the rows of a hot hash.
    """
    rows = store(line_rows(docs, id_col, text_col, min_chars), "lines")
    firsts = cut(first_occurrences(rows, min_docs))
    gone = rows.join(F.broadcast(firsts) if firsts.count() <= broadcast_rows else firsts, HASH).where(F.col("after") > F.col("first"))
    words = gone.groupBy("after", "version", F.shiftright("pos", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("gone"))
    found = words.groupBy("after", "version").agg(F.array_sort(F.collect_list(F.struct("w", F.bitwise_not("gone").alias("bits")))).alias("words"), F.sum(F.bit_count("gone")).alias("n_dropped"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("words", i - 1)["w"])
    keep = F.transform("words", lambda x, i: F.struct((x["w"] - before(i) - 1).alias("gap"), x["bits"].alias("bits")))
    return found.select(F.bitwise_not("after").alias("id"), "version", keep.alias("keep"), "n_dropped")


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that stay, joined by \\n; without a bitmap the text as it is (null: empty)."""
    words = F.flatten(F.transform(keep, lambda k: F.concat(F.array_repeat(F.lit(-1).cast("long"), k["gap"]), F.array(k["bits"]))))
    stays = lambda w, i: F.coalesce(F.getbit(F.get(w, F.shiftright(i, 6)), (i % 64).cast("int")), F.lit(1)) == 1
    # the array of one element holds the unpacked words, so that they are unpacked once for all lines
    kept = F.transform(F.array(words), lambda w: F.array_join(F.filter(lines_of(text), lambda _, i: stays(w, i)), "\n"))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(kept[0])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """`docs` with repeated lines taken out of `text_col`, and n_lines and n_dropped added (replaced, if there).

    Columns of `docs` travel in a struct, so none of them can clash with the names used here."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(row_of(docs), F.col(id_col).cast("long").alias("own"), F.xxhash64(text_col).alias("hash"))
    out = rows.join(maps, (F.col("own") == F.col("id")) & (F.col("hash") == F.col("version")), "left")
    text = F.col("row")[text_col]
    new = {text_col: kept_text(text, F.col("keep")), "n_lines": F.size(lines_of(text)).cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long")}
    names = [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)]
    return out.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in names))
