"""Tables that micro-batches change: every batch writes the rows it changes under its own number, and the last one of a row holds."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 16  # folders of a batch, by the hash of ``split``
START = -1  # the number under which the table begins


@dataclass(frozen=True)
class Changes:
    """``key`` names a row; rows are looked up, and laid out in folders, by ``split``, which is in the row and never changes."""

    key: tuple[str, ...]
    split: tuple[str, ...]

    def part(self, by: Sequence[str] | None = None):
        return F.pmod(F.xxhash64(*(by or self.split)), F.lit(PARTS)).cast("int")

    def write(self, rows: DataFrame, folder: str, number: int) -> None:
        """Rows changed by a batch. The same batch run again replaces its own rows."""
        typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema(rows.sparkSession, folder)])
        typed.withColumn("part", self.part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/batch={number}")

    def start(self, rows: DataFrame, folder: str) -> None:
        rows.limit(0).write.mode("overwrite").parquet(f"{folder}-schema")
        self.write(rows, folder, START)

    def schema(self, spark: SparkSession, folder: str) -> T.StructType:
        return spark.read.parquet(f"{folder}-schema").schema

    def every(self, spark: SparkSession, folder: str) -> DataFrame:
        """All written rows with the number of their batch."""
        placed = T.StructType([*self.schema(spark, folder).fields, T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType())])
        return spark.read.schema(placed).option("basePath", folder).parquet(folder)

    def current(self, spark: SparkSession, folder: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows as the batches before ``before`` left them, with ``keys`` only those whose ``split`` is among them.

        Folders of other batches and of parts without a key are not read.
        """
        rows = self.every(spark, folder)
        columns = [c for c in rows.columns if c not in ("batch", "part")]
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if keys is not None:
            keys = keys.select(*self.split).distinct()
            parts = [r[0] for r in keys.select(self.part().alias("part")).distinct().collect()]  # at most PARTS numbers
            rows = rows.where(F.col("part").isin(parts)).join(keys, list(self.split), "left_semi")
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*columns), "batch").alias("r"))
        return last.select(*[F.col(f"r.`{c}`").alias(c) for c in columns])

    def compact(self, spark: SparkSession, folder: str, target: str) -> None:
        """The table as it is, as the start of a new folder."""
        self.start(self.current(spark, folder), target)
