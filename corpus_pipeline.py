"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept. Toxic documents go; one document of each class of near-duplicates
stays; words of passages that an earlier document has are cut; documents of under-represented domains are repeated, as
often as the targets ask in a total that follows from them (rates of at least one: no document is lost, so soft toxic
mass, whose target is zero, stays); texts are encoded.

Defined results: null, empty and wordless texts are never toxic, are in classes of their own, lose no words, have no
tokens to mix and encode to no ids, so their rows stay to the end; of rows that repeat an id and its text one stays, rows
of one id with different texts and rows without an id all stay; where documents are equally near, the smallest id of a
class stays; further columns of documents are carried to the last stage, whatever their names; without usable labels
nothing is toxic and domains are equally likely; empty tables give an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.llm import bpe, mixing, neardup, substrings, toxicity
from echoline.llm.base import delete, scratch, table, tidy, work_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the lexicon is learned from the labelled rows of ``documents``."""
    lexicon = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: toxicity.crc_of_id(c) % 5 != 0)
    return toxicity.keep_clean(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that earlier documents have; n_chars follows the text."""
    tidy(spark)
    return substrings.drop_repeats(docs).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes) of each document, or of each of its copies."""
    tidy(spark)
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("mixing", mix_domains),
    ("byte_bpe", encode),
]

#: Learned lexicons, sampled signatures and merge loops have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables go when it is written, its input when it has been read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{work_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
