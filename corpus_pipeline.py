"""A training corpus from the documents table: each stage takes (spark, docs, sf_dir); its result is stored and is the next one's docs."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rosterlake.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from rosterlake.llm.common import table
from rosterlake.session import ensure_checkpoint_dir


SEED = 20240607  # of the training order
# In every stage NULL and empty texts have no words; a NULL doc_id or source is a value like any other; repeated rows are documents each;
# very long texts are handled whole; an empty table gives an empty one; columns of other names are carried along.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go, those without words among them; the others lose the lines that too many documents of their source repeat."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays, that of the smallest doc_id (NULL last); texts without words are similar to nothing."""
    return ngram_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; items without words have no window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources again, up to the repetition limit."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot. Slots are the training order: all first uses, then all second uses, each permuted by a hash."""
    return sharding.assign(docs, seed=SEED)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("mixture", mixture), ("shards", shards)]
ORACLE_SQL = None  # the near-duplicate classes are connected components of a similarity join; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
