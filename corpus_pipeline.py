"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Counted with the subpackage of the training-data operators; nothing else imports it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.llm import bpe, toxicity
from lacunar.llm.common import shared_dir, table
from lacunar.llm.jaccard import without_copies
from lacunar.llm.linededup import dedup_lines
from lacunar.llm.mixing import mixed_documents
from lacunar.sources.shared import forget, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; all others stay as they are, documents with a null id too."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more repeat go, except in the last of them; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays: links are a Jaccard similarity of 0.8 on 5 words, found by
    the SimHash index of op2 on those shingles, and beyond its distance by MinHash bands, and verified on the shingles.
    Different texts under one doc_id are judged one by one."""
    return without_copies(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them: a doc_id may come back several times or not at all."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and their digests: the token ids of each document of the mix."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, blanks=True)
    return bpe.with_bytes(ids, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.joined_ids(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Neither the classifier nor the hashes of the other stages can be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table. The stages' tables lie in the shared folder; a table goes once the next one is
    written, and with it all that the stage left there on its way. Of a run that fails nothing stays."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for i, (_, stage) in enumerate(STAGES):
            with scratch(spark):
                stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
            if i:
                forget(spark, f"{base}/{i - 1}")
    except Exception:
        forget(spark, base)
        raise
    return docs
