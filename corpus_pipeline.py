"""A training corpus from ``documents``: language ID, near-dedup, decontamination, mixing, sharding.

Each stage reads what its predecessor wrote. All but the last keep the columns of the
documents; the last adds size, text_crc32, shard and slot. An empty table stays empty through
all stages, with the same columns; columns besides doc_id, text, lang and source are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm._common import Scratch
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.language_id import keep_identified
from tessera.llm.mixing import mixed_documents
from tessera.llm.near_dedup import drop_near_duplicates
from tessera.llm.sharding import shards


#: What the last stage adds.
ADDED = ("size", "text_crc32", "shard", "slot")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null and empty texts, those without letters and those that
    no language explains. Null ids and null languages are kept, repeated rows are judged alike; where nothing has
    a language there is nothing to learn from and all go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (shingles of five words, similarity 0.8): the one of least
    id. Rows that repeat id and text are one document; rows of one id with different texts, and those without
    an id, are told apart by their texts; texts without words are linked with nothing."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth lies in benchmark windows go. Null texts have no words and stay;
    repeated rows are judged alike; an empty benchmark takes nothing away."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or cut down to their target weights. A null source is one of its own; texts without words
    have size 0 and are not taken; each of repeated rows is taken by itself. One document of a source is cut, so
    that the source meets its target to the word."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in 16 shards of near equal bytes, with each row's place in its shard. Null texts have size 1,
    null ids come first among equal texts, repeated rows get places of their own. Columns of the documents that
    have a name of the added ones give way to them."""
    own = [c for c in docs.columns if c not in ADDED]
    return shards(docs, carry=tuple(c for c in own if c != "doc_id")).select(*own, *ADDED)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Code lengths of context trees can't be expressed in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, f"pipeline-{uuid.uuid4().hex[:6]}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
