"""Tracking log: one `ts|type|id|ip|agent|referrer` line per hit, one file per day."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["ts", "event_type", "tracking_id", "ip_address", "user_agent", "referrer"]


def parse_lines(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns; a line with fewer than six fields gives NULLs at its end, a bad time a NULL time."""
    p = F.split(F.col(value), r"\|", 6)
    cols = [F.try_to_timestamp(F.get(p, F.lit(0))).alias("ts")] + [F.get(p, F.lit(i)).alias(c) for i, c in enumerate(FIELDS) if i]
    return lines.select(*keep, *cols)


def format_line() -> Column:
    return F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), *[F.coalesce(F.col(c), F.lit("")) for c in FIELDS[1:]])


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def stream_tracking(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return parse_lines(r.text(path))


def write_tracking(events: DataFrame, path: str, mode: str = "append") -> None:
    """Sink: one folder per day, lines as above."""
    out = events.select(format_line().alias("value"), F.to_date("ts").alias("date"))
    out.write.mode(mode).partitionBy("date").text(path)
