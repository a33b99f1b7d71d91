"""Corpus pipeline: toxicity, line dedup, near-duplicates, mixing to target weights, encoding.

The near-duplicate stage (`near_copies`) takes operator 8's SimHash fingerprints over five-word shingles and its links within two
bits, then an index of minima for pairs that these can't see; every link is verified on shingle sets (0.8 or more). Operator 8's
own query has another contract. Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's
result to the shared folder and reads it again, so a lost executor costs one stage at most. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import bpe, line_dedup, mixing, near_copies, toxicity
from panelwright.llm.common import DOC_COLUMNS, shared_root, stored, stored_once, table

#: Targets of the pipeline's mixture: as many tokens as there are, no leaf more than twice.
MIXTURE = mixing.Mixture(weights={"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2}}, max_epochs=2, seed="pipeline")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labelled ones among docs."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs.select(*DOC_COLUMNS), model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars counts what is left."""
    short = line_dedup.drop_frequent_lines(docs.select(*DOC_COLUMNS))
    left = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return short.withColumn("n_chars", left).select(*DOC_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group that similarities of five-word shingles of 0.8 or more link."""
    return near_copies.representatives(docs.select(*DOC_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixture's proportions: a row for each epoch that takes a document."""
    return mixing.mixed_documents(docs.select(*DOC_COLUMNS), MIXTURE, mixing.domain_of_source(F.col("source")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with counts and digests of what they decode to."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: A learned model and 64-bit hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The last stage's result. A run that is started again with its run_id goes on after the last complete stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        if run_id is None:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        else:
            docs = stored_once(spark, f"{shared_root(spark)}/pipeline-{run_id}/{name}", lambda: stage(spark, docs, sf_dir))  # noqa: B023  called at once
    return docs
