"""Rule tables as DataFrames, for joins and for lexicons kept outside the code."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from rosterlake.functions.text import map_of
from pyspark.sql import functions as F

LEXICON_SCHEMA = "kind string, category string, keyword string, weight double, rank int"


def lexicon(spark: SparkSession, kind: str, table: dict[str, Sequence[str]], weight: float = 1.0) -> DataFrame:
    """(kind, category, keyword, weight, rank); rank is the order in the list, lower case as matched."""
    rows = [(kind, c, w.lower(), weight, i) for c, ws in table.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEXICON_SCHEMA).option("header", True).csv(path)


def taxonomy(spark: SparkSession, kinds: dict[str, dict[str, Sequence[str]]]) -> DataFrame:
    """(org_type, kind, value) rows: titles, subtypes, keywords of each organization type."""
    out = None
    for kind, table in kinds.items():
        part = spark.range(1).select(F.explode(map_of(table)).alias("org_type", "vs")).select(
            "org_type", F.lit(kind).alias("kind"), F.explode("vs").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
