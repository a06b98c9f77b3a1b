"""Jump consistent hashing: stable keys to shards without a table of ring points."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import HASH_BITS, hash60, join_sized, row_key, spill, table

N_SHARDS = 16
ROWS_PER_BLOCK = 2_000
STEP = np.uint64(2862933555777941757)  # fixed multiplier of the published algorithm


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of each 64-bit key among ``n``; with one shard more a key stays or moves to the new shard."""
    k = keys.astype(np.uint64)
    last, at, live = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), np.arange(len(k))
    while len(live):
        last[live] = at[live]
        k[live] = k[live] * STEP + np.uint64(1)
        at[live] = np.floor((last[live] + 1) * (2147483648.0 / ((k[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[at[live] < n]
    return last


def _jump_column(n: int):
    @F.pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(), n), dtype="int32")

    return shard


def assign(docs: DataFrame, n_shards: int = N_SHARDS, rows_per_block: int = ROWS_PER_BLOCK, seed: int | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, shard, slot and grown_shard (the shard among one more).

    The key is a hash of the doc_id as text (NULL: of the text ``~null``), so the shard depends on it and the number of shards alone.
    Inside a shard rows are ordered by that hash, then doc_id, text checksum and size; slots count from 0 without a gap. With ``seed``
    the slots are a training order: the first uses of all documents in hash order, then the second uses in another hash order and so on,
    so that the repeats of a document lie epochs apart. The range of the order is cut into blocks of about ``rows_per_block`` rows that
    are numbered on their own and shifted by the counts of the blocks before them, so that no task holds a shard.

    Rows with one doc_id, NULL among them, are one key: they belong to one shard by law and are numbered in one task. Repeated rows get
    slots of their own; empty and NULL texts have size 1; a very long text is moved whole; an input column of the same name is replaced; an empty table gives an empty
    result.
    """
    made = ["size", "text_crc32", "shard", "slot", "grown_shard"]
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    bits = max(0, math.ceil(math.log2(max(1, docs.count()) / (n_shards * rows_per_block))))

    def placed(rows: DataFrame) -> DataFrame:
        """Adds the shard, and epoch and block of the order."""
        rows = rows.withColumn("epoch", F.lit(1) if seed is None else F.row_number().over(Window.partitionBy("rid").orderBy("rid")))
        order = F.col("key") if seed is None else hash60(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("rid")))
        rows = rows.withColumn("order", order).withColumn("shard", _jump_column(n_shards)("key"))
        return rows.withColumn("block", F.shiftright("order", HASH_BITS - bits))

    key, rid = hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("~null"))).alias("key"), row_key(F.col("doc_id"), F.col("text")).alias("rid")
    full = placed(docs.select(row.alias("row"), key, *([] if seed is None else [rid]), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    full = full.withColumn("grown_shard", _jump_column(n_shards + 1)("key"))
    blocks = placed(docs.select(key, *([] if seed is None else [rid]))).groupBy("shard", "epoch", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("epoch", "block").rowsBetween(Window.unboundedPreceding, -1)
    shift = spill(blocks.select("shard", "epoch", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    within = Window.partitionBy("shard", "epoch", "block").orderBy("order", F.col("row.doc_id"), "text_crc32", "size")
    out = join_sized(full.withColumn("at", F.row_number().over(within) - 1), shift, ["shard", "epoch", "block"])
    return out.select("row.*", "size", "text_crc32", "shard", (F.col("shift") + F.col("at")).cast("long").alias("slot"), "grown_shard")


def op5_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def jump_sql(source: str, n: int, name: str) -> str:
    """Recursive steps of the hash for ``source(id, key)``; the table ``name`` has (id, shard)."""
    mod = "18446744073709551616::UHUGEINT"
    nxt = "((k * 2862933555777941757::UHUGEINT + 1) % " + mod + ")"
    jumped = "floor(({b} + 1) * (2147483648.0::DOUBLE / ((" + nxt + " >> 33) + 1)::DOUBLE))::BIGINT"
    return f"""{name}_steps AS (
 SELECT id, {nxt} AS k, 0::BIGINT AS b, {jumped.format(b="0::DOUBLE")} AS j FROM (SELECT id, key::UHUGEINT AS k FROM {source})
 UNION ALL SELECT id, {nxt}, j, {jumped.format(b="j::DOUBLE")} FROM {name}_steps WHERE j < {n}),
{name} AS (SELECT id, b::INT AS shard FROM {name}_steps WHERE j >= {n})"""


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text FROM documents),
ids AS (SELECT doc_id AS id, key FROM d),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT doc_id AS id, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM d, tab),
{jump_sql('ids', N_SHARDS, 'now')},
{jump_sql('ids', N_SHARDS + 1, 'grown')}
SELECT doc_id, size::BIGINT AS size, 'key' AS law, now.shard AS shard, (row_number() OVER (PARTITION BY now.shard ORDER BY key, doc_id) - 1)::BIGINT AS slot, grown.shard AS grown_shard,
 text_crc32
FROM d JOIN crc ON crc.id = doc_id JOIN now ON now.id = doc_id JOIN grown ON grown.id = doc_id
"""
