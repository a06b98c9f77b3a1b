"""Helpers shared by the operators of this package: row keys, tables on the shared folder, size-checked joins, components."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rosterlake.session import ensure_checkpoint_dir

HASH_BITS = 60  # hexadecimal digits are taken fifteen at a time, so that a key is never negative
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
LETTERS_UP, LETTERS_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(text: Column) -> Column:
    """The first fifteen hexadecimal digits of the MD5 of a string, as a number below 2**60."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def row_key(*columns: Column) -> Column:
    """One string per distinct row content; equal rows share it, NULL differs from the empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.md5(F.concat_ws("\u0001", *parts))


def stored(df: DataFrame) -> str:
    """Write the rows as Parquet under the shared checkpoint folder; returns where."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def spill(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet under the shared checkpoint folder and read them back; later stages restart from there."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: texts can be long, and a batch is held whole by a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_columns(df: DataFrame, inputs: list[str], fields: str, fn: Callable[..., list], drop: list[str] | None = None) -> DataFrame:
    """Append the columns ``fields`` that ``fn`` makes, one list or Arrow array each, from the lists of the input columns of a batch; drop ``drop``."""
    drop, new = inputs if drop is None else drop, T.StructType.fromDDL(fields)
    kept = [f.name for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*[df.schema[c] for c in kept], *new.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            out = fn(*[b.column(c).to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays([*[b.column(c).cast(arrow.field(c).type) for c in kept], *[v.cast(arrow.field(f.name).type) if isinstance(v, pa.Array) else pa.array(v, arrow.field(f.name).type) for v, f in zip(out, new.fields)]], schema=arrow)

    return df.mapInArrow(run, schema)


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a stored table: sent to all executors only where its counted rows are at most ``limit`` and weigh at most ``most_bytes``, else by shuffle."""
    wide = [F.octet_length(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.size(f.name) * 8 for f in right.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType))]
    weight = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(8 * len(right.columns))).cast("long")
    rows, weighs = right.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    return left.join(F.broadcast(right) if rows <= limit and weighs <= most_bytes else right, on, how)


def components(edges: DataFrame) -> DataFrame:
    """Smallest connected node of every node of ``edges(a, b)``: minimum labels spread and jump until nothing changes.

    Every round is written to the shared folder. Returns (node, root); an edge table without rows gives none.
    """
    both = spill(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = spill(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(seen, "node").select("node", "root", F.least("root", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("root").alias("up"))
        new = spill(step.join(up, "low").select("node", F.col("root").alias("was"), F.least("low", "up").alias("root")))
        if not new.where("root <> was").limit(1).count():
            return new.select("node", "root")
        label = new.select("node", "root")

