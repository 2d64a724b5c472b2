"""A corpus from raw documents: five stages, each with one operator of `tidebin.llm`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as
Parquet to the cluster's shared folder and rereads as the documents of the next one.
All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebin.llm import bpe, jaccard, mixing, secrets, toxicity
from tidebin.llm.catalogue import MIX_WEIGHTS, mix_levels, toxicity_model
from tidebin.llm.shared import few, settle, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay."""
    scored = toxicity.score(docs, "text", toxicity_model(spark, sf_dir, docs), docs.columns)
    return scored.filter("score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays.

    Of rows that repeat an id, the first by their other columns stays; rows without an id are
    in no group and stay.
    """
    groups = jaccard.join(docs, "doc_id", "text")
    times = F.sum((F.col("doc_id") == F.col("component_id")).cast("long")).alias("times")
    kept = settle(groups.filter("doc_id is not null").groupBy("doc_id").agg(times))
    copies, repeated = (settle(kept.filter(which).select("doc_id")) for which in ("times = 0", "times > 1"))
    once = docs.join(few(copies), "doc_id", "left_anti").join(few(repeated), "doc_id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"]))
    again = docs.join(few(repeated), "doc_id", "left_semi").withColumn("__rank", rank).filter("__rank = 1")
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked and `n_chars` counted anew."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = secrets.scan(docs, "text", path, pattern, docs.columns)
    clean = found.withColumn("text", secrets.masked("text", "spans"))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, once each, so that no copy comes back.

    A document at the end of its source's budget stays whole.
    """
    levels, tokens, seed = mix_levels(), mixing.word_count("text"), 11
    mixed = mixing.mix(docs, "doc_id", levels, tokens, MIX_WEIGHTS, share=0.8, max_epochs=1, seed=seed)
    return mixing.taken(docs, "doc_id", levels, tokens, settle(mixing.cuts(mixed, list(levels), seed)), seed)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed as little-endian unsigned 32-bit integers."""
    return bpe.encode(docs, "text", public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
