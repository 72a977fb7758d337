"""A corpus pipeline of five stages, each written as Parquet and read by the next one.

Rejected are toxic documents, exact copies (the largest doc_id stays), near copies (the smallest
doc_id of a group stays) and what sampling to tempered shares leaves out. What remains is
packed into windows of token ids.

A stage begins when the result of the one before it has been written; it then removes the tables
that one has held. The session goes on with small batches for Python workers, as executors run all stages
one after the other and keep the most that any of them needed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, jaccard, mixing, packing, toxicity
from plumbline.llm.common import hold, own_tables
from plumbline.session import small_batches

#: Marginals are the token shares to this power; rounds of raking.
POWER, ROUNDS = 0.9, 8


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _alone(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        with own_tables(spark, "stage"):
            return stage(spark, docs, sf_dir)
    return run_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones, scores below 0.5."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_score(docs, net, out="__toxicity")
    return scored.filter(F.col("__toxicity") < 0.5).drop("__toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    found = exact_dedup.group_equal_texts(docs, "doc_id", "text", keep="largest")
    gone = hold(found.filter("NOT kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by shingle similarity the one with the smallest doc_id."""
    found = jaccard.near_duplicates(docs, "doc_id", "text", words=5, percent=80)
    gone = hold(found.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow tempered shares of source, language and topic."""
    whole = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").alias("key"), F.col("row.source").alias("source"), F.col("row.lang").alias("lang"),
        mixing.topic_of(F.col("row.text")).alias("topic"), mixing.token_weight(F.col("row.text")).alias("tokens"))
    mixed = mixing.sample_to_targets(whole, ["source", "lang", "topic"], "key", "tokens", power=POWER, rounds=ROUNDS)
    return mixed.filter("kept").select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text", size=4096, eos=2)


STAGES = [(name, _alone(stage)) for name, stage in (
    ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources), ("packing", pack_windows))]
#: Models and packing have no SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = hold(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
