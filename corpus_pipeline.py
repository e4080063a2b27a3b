"""A corpus pipeline of five stages over `documents`: toxicity, near-dedup, substring dedup, secret scan, packing.

Each stage takes the rows that the one before it kept, with the columns of documents, and what it keeps is written for the
next; a table is deleted when the next stage's is written, and scratch tables with the stage that made them, also after a
failure. In all stages rows with a null id, null, empty or very long texts and repeated rows are whole rows of their own,
an empty table stays empty, and columns that documents has beyond its own pass through but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import minhash, packing, secrets, substrings, toxicity
from tidefold.llm.common import discard, materialize, scratch, small_batches, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; a sample of about 20,000 of the labelled rows at most trains the lexicon.

    Null and empty texts score as texts without a match and stay; so does everything where no row is labelled.
    """
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "toxicity")
    return toxicity.score(docs, lexicon, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id: five-word shingles, similarity of 0.8 or more.

    Texts without words are in no group, and stay; unlike texts of one id stay; of equal rows one stays, but for null ids.
    """
    return minhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are taken out; all rows stay, n_chars follows; null texts stay null."""
    return substrings.remove_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all rows stay, n_chars follows; null texts stay null."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The cleaned texts laid into sequences, whole, with the ids of their documents and where each stands.

    One document of each near-duplicate group is left here, so that clusters are the texts that the stages before made
    equal. Null texts are pieces of no words.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", redact_secrets), ("packing", pack)]

#: Learning, sketches and sequential packing have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with small_batches(spark), scratch(spark):
            after = materialize(stage(spark, docs, sf_dir), name, keep=True)
        discard(docs)
        docs = after
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out
