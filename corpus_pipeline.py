"""A training-data pipeline over ``documents``: five stages, each one of the corpus operators.

Every stage takes what its predecessor kept and returns the columns of documents, the last one its result. A stage is
written and read again before the next, so that a lost executor costs one stage's work at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from tidewatch.llm.common import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Rows that go to a worker at once. Texts are long, so Arrow's usual 10,000 would hold tens of megabytes on either side.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def short_batches(spark: SparkSession) -> None:
    """Set BATCH, unless the session has a value of its own."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose texts the toxicity model rejects go."""
    short_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; a document that loses its whole text goes.

    n_chars, where there is one, follows the text; no other column changes.
    """
    short_batches(spark)
    changed = F.col("n_removed") > 0
    kept = line_dedup.clean(docs).filter(~(changed & (F.trim("text") == "")))
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast("long") if "n_chars" in docs.columns else None}
    return kept.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest doc_id stays."""
    short_batches(spark)
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: dropped, once, or repeated."""
    short_batches(spark)
    return mixing.repeat(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, for every row."""
    short_batches(spark)
    return bpe.encode_and_decode(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: The stages fit models, follow links and draw coins: SQL can't express them. Tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = scratch.write(made, name)
        docs = scratch.read(path, made.schema)
        if before:
            scratch.drop(before)  # what a stage took is no longer read once it is written
        before = path
    return docs
