"""Exact digests of the canonical form of documents.

Canonical form: compatibility composition (NFKC), full case folding, composition again, runs of white space folded to
one space and trimmed. The digest is two xxhash64 under different seeds, 128 bits. Documents with equal digests are
compared byte by byte: equal strings are equal bytes in Spark, so the smallest and the largest canonical form of a
bucket tell whether all are equal. A bucket that fails has the SHA-256 of the form added to its digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacunar.operators.tensor import with_ordinal

from .common import cut, row_of

#: White_Space of Unicode as a Java class; the composition before has folded most of it to U+0020.
SPACES = r"[\x09-\x0D\x20\x85\xA0  -     　]+"
KEY = ["k1", "k2"]


def canonical(text: Column) -> Column:
    """Canonical form; null counts as empty. ASCII texts need no Unicode tables. The others go to ICU, which Spark
    ships, by Spark's own function for Java methods."""
    text = F.coalesce(text, F.lit(""))
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(compose(fold(compose(text))))
    return F.trim(F.regexp_replace(folded, SPACES, " "))


def digest(form: Column) -> Column:
    """32 hexadecimal digits; a seed of its own for each half."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(form)), half(F.xxhash64(F.lit(1), form)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2): rows with a key of 128 bits that rows of equal id and text share, a null id too."""
    named = F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull())
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), named.alias("k2"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bad: list[str] | None = None) -> DataFrame:
    """(id, k1, k2, n, d) of every row, cut off: its key, length and digest, with the digests in `bad` told apart. (ICU's results are taken for not
    deterministic by Spark, which then computes an expression as often as it is named; forms are columns of their own
    for that reason.)"""
    forms = keyed(docs, id_col, text_col).select("id", *KEY, F.coalesce(F.char_length("text"), F.lit(0)).alias("n"), canonical(F.col("text")).alias("form"))
    return cut(forms.select("id", *KEY, "n", told_apart(digest(F.col("form")), F.col("form"), bad or []).alias("d")))


def mixed_buckets(forms: DataFrame) -> list[str]:
    """Digests of (d, form) that stand for more than one form: the forms of a bucket meet as their minimum and maximum,
    taken before the shuffle, so a bucket of any size sends two per task."""
    bad = forms.groupBy("d").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b")
    return [r["d"] for r in bad.select("d").collect()]  # two texts under one 128-bit hash: none in practice


def colliding(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1 << 20, known: DataFrame | None = None) -> list[str]:
    """Digests that stand for more than one canonical form.

    Only documents whose digest another shares are read again and compared. Their keys, and the digests that occur
    twice, go to all executors while they are at most `broadcast_rows` (40 MB), by a join beyond that. known: digests().
    """

    def small(df: DataFrame) -> DataFrame:
        df = cut(df)
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    known = digests(docs, id_col, text_col) if known is None else known
    twice = known.groupBy("d").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("d")
    again = known.join(small(twice), "d").select(*KEY).distinct()
    some = keyed(docs, id_col, text_col).join(small(again), KEY)
    return mixed_buckets(some.select(canonical(F.col("text")).alias("form")).select(digest(F.col("form")).alias("d"), "form"))


def told_apart(d: Column, form: Column, bad: list[str]) -> Column:
    """The digest `d` of a form, with its SHA-256 added if the digest stands for more than one form."""
    return F.when(d.isin(bad), F.concat(d, F.sha2(form, 256))).otherwise(d) if bad else d


def with_fingerprint(docs: DataFrame, text_col: str, into: str, bad: list[str]) -> DataFrame:
    """`docs` with the fingerprints of a text column in the column `into`, which is replaced if it is there."""
    rows = docs.select(row_of(docs), canonical(F.col(text_col)).alias("form"))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != into), told_apart(digest(F.col("form")), F.col("form"), bad).alias(into))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """`docs` with its texts' fingerprints: equal exactly for equal canonical forms. Null and empty texts are equal."""
    return with_fingerprint(docs, text_col, into, colliding(docs, id_col, text_col))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, n, first_id): each document with the size and smallest id of its group of equal forms."""
    rows = with_fingerprint(docs.select(id_col, text_col), text_col, "fingerprint", colliding(docs, id_col, text_col)).select(id_col, "fingerprint")
    groups = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"))
    return rows.join(groups, "fingerprint").select(id_col, "fingerprint", "n", "first_id")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(id_col, text_col, n, d, next_d, head): every row with its length and digest, the digest of the document that
    follows by descending id (after the last comes the first), and as many code points of that one's beginning as a third
    of its own, rounded down. known: digests().

    Rows that share an id follow one another in the order of a hash, null ids come last; of equal rows each but the last
    is followed by its like. Only numbers and digests are put in order. A text is shuffled once, by a hash of its row,
    and from there its head goes to the one row that needs it. Extra columns are left out.
    """
    known = digests(docs, id_col, text_col) if known is None else known
    one = known.groupBy(*KEY).agg(F.first("id").alias("id"), F.first("n").alias("n"), F.first("d").alias("d"), F.count(F.lit(1)).alias("copies"))
    ordered = with_ordinal(one, [F.col("id").desc_nulls_last(), *map(F.col, KEY)])
    total = max(1, ordered.count())
    after = ordered.select(F.pmod(F.col("ordinal") - 1, F.lit(total)).alias("ordinal"), F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.col("d").alias("next_d"))
    pairs = cut(ordered.join(after, "ordinal").select(*KEY, "n", "d", "copies", "to1", "to2", "next_d"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))
    texts = keyed(docs, id_col, text_col).repartition(*KEY).withColumn("place", place)
    third = lambda n: F.floor(n / 3).cast("int")
    wanted = pairs.select(F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.col("k1").alias("for1"), F.col("k2").alias("for2"), third(F.col("n")).alias("third"))
    heads = texts.where("place = 1").join(wanted, KEY).select(F.col("for1").alias("k1"), F.col("for2").alias("k2"), F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.col("third")).alias("head"))
    out = texts.join(pairs.drop("to1", "to2"), KEY).join(heads, KEY)
    own = F.col("place") < F.col("copies")
    mine = F.substring(F.coalesce("text", F.lit("")), F.lit(1), third(F.col("n")))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n", "d", F.when(own, F.col("d")).otherwise(F.col("next_d")).alias("next_d"), F.when(own, mine).otherwise(F.col("head")).alias("head"))


def edited_text(text: Column, n: Column, head: Column) -> Column:
    """A text of `n` code points with its last third (rounded down) replaced by `head`."""
    return F.concat(F.substring(F.coalesce(text, F.lit("")), F.lit(1), (n - F.floor(n / 3)).cast("int")), head)
