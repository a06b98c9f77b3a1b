"""Set operations on tables and on ordered lists."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.urls import normalize_url


def labelled_union(parts: dict[str, DataFrame], label: str = "kind") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn(label, F.lit(k)) for k, d in parts.items()])


def union_all(*parts: DataFrame) -> DataFrame:
    """Union by name; a column one side lacks becomes NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.select(normalize_url(url).alias(url)).distinct()


def except_known(df: DataFrame, *known: DataFrame, on: str = "url") -> DataFrame:
    for k in known:
        df = df.join(k.select(on), on, "left_anti")
    return df


def ordered_union(*lists: Column) -> Column:
    """Lists one after another, each value at its first place."""
    return F.array_distinct(F.concat(*lists))


def overlap(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def in_both(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))
