"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs.
"""

from __future__ import annotations

from shardloom.llm.common import table
from shardloom.llm.exact_dedup import keep_exact
from shardloom.llm.jaccard_join import one_of_each
from shardloom.llm.language_id import keep_identified
from shardloom.llm.packing import pack_documents
from shardloom.llm.secrets import redact_documents
from shardloom.scratch import scope, scratch_path


def language_id(spark, docs, sf_dir):
    """Documents that language identification doesn't reject."""
    return keep_identified(docs)


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the document with the largest id."""
    return keep_exact(docs)


def jaccard_join(spark, docs, sf_dir):
    """Of each group of near duplicates the document with the least id."""
    return one_of_each(docs)


def secret_scan(spark, docs, sf_dir):
    """All documents, their secrets replaced and n_chars brought up to date."""
    return redact_documents(docs, n_chars="n_chars")


def packing(spark, docs, sf_dir):
    """The documents' pieces, each with its sequence and its place there."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join), ("secret_scan", secret_scan), ("packing", packing)]

#: No stage but the second can be expressed in SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scope(spark):  # what a stage wrote for itself goes once its result is there
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
