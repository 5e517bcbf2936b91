"""A corpus pipeline of five operators: clean documents in, token ids of the mix out.

Each stage takes (spark, docs, sf_dir), works on every document that the one before it kept, and returns the columns
of documents; the last returns ids. docs of a stage must be a stored table, as run() makes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, jaccard, mixing, pii, toxicity
from ridgeline.llm._common import stored, table
from ridgeline.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; the model learns from labelled rows of the input."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near copies."""
    return jaccard.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.PATTERN, bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", one_of_each_class), ("pii", redact_personal_data), ("mixing", mix_sources), ("byte_bpe", encode)]

#: Models, rounding and merges are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
