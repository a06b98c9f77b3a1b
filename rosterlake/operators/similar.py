"""Names within a few edits of each other, without pairs inside a group: an edit-distance join on pieces of the names."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.session import stored

SPARE, WIDTH = 3, 4  # pieces that two similar names share at least; characters of a piece where the edits leave the choice


def edits_allowed(length: Column, percent: int) -> Column:
    """Edits by which a name of this length may differ from a shorter one: similarity 1 - edits / length, in whole percent."""
    return F.floor(length * (100 - percent) / 100).cast("int")


def _pieces(length: Column, edits: Column) -> Column:
    """(i, start, width) of the pieces of a name, as equal as can be."""
    n = F.greatest(edits + SPARE, F.floor(length / WIDTH).cast("int"))
    base, short = F.floor(length / n).cast("int"), n - length % n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), (i * base + F.greatest(F.lit(0), i - short) + 1).alias("start"), (base + (i >= short).cast("int")).alias("width")))


def similar_names(names: DataFrame, by: Sequence[str], name: str, percent: int = 85) -> DataFrame:
    """(by, a, b): pairs a < b of distinct names of a group whose Levenshtein distance is at most (100 - percent) % of the longer length.

    A name is cut into more pieces than it may have edits. A similar name no longer than it holds all pieces but as many as there are
    edits, each shifted by no more than the edits allow. So of every name one piece more than its edits is filed, the rarest ones; one of
    them is shared in any case, and words that all names of a group have in common do not bring them together. Shorter names look
    for the pieces of all lengths they can be similar to; the distance decides at the end. NULL and empty names, and groups with a NULL
    in ``by``, have no pairs. Pieces are many times the names they are planned by, so they are joined by sorting and never broadcast.
    """
    keys = list(by)
    distinct = stored(names.select(*keys, F.col(name).alias("name")).where(F.length(name) > 0).dropna(subset=keys).distinct().withColumn("length", F.length("name")))
    filed = distinct.withColumn("edits", edits_allowed(F.col("length"), percent)).where("edits > 0").select(
        *keys, F.col("name").alias("long"), "length", F.inline(_pieces(F.col("length"), edits_allowed(F.col("length"), percent))))
    filed = filed.select(*keys, "long", "length", "i", F.expr("substring(long, start, width)").alias("piece"))
    place = [*keys, "length", "i", "piece"]
    common = filed.groupBy(*place).agg(F.count("*").alias("n"))
    ranked = filed.join(common.hint("merge"), place).groupBy(*keys, "long", "length").agg(F.array_sort(F.collect_list(F.struct("n", "i", "piece"))).alias("p"))  # a name has few pieces
    filed = ranked.select(*keys, "long", "length", F.inline(F.slice("p", F.lit(1), edits_allowed(F.col("length"), percent) + 1))).drop("n")
    asks = distinct.select(*keys, F.col("name").alias("short"), F.col("length").alias("l"),
                           F.explode(F.sequence("length", F.floor(F.col("length") * 100 / percent).cast("int"))).alias("length"))
    asks = asks.withColumn("edits", edits_allowed(F.col("length"), percent)).where("edits > 0 AND length - l <= edits")
    asks = asks.select(*keys, "short", "l", "length", "edits", F.inline(_pieces(F.col("length"), F.col("edits"))))
    first = F.greatest(F.lit(1), F.col("start") - F.floor((F.col("edits") + F.col("length") - F.col("l")) / 2).cast("int"))
    last = F.least(F.col("l") - F.col("width") + 1, F.col("start") + F.floor((F.col("edits") - F.col("length") + F.col("l")) / 2).cast("int"))
    asks = asks.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("at", F.explode(F.sequence("first", "last")))
    asks = asks.select(*keys, "short", "length", "i", "edits", F.expr("substring(short, at, width)").alias("piece")).distinct()
    near = asks.join(filed.hint("merge"), place).where("short <> long").select(*keys, F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"), "edits").distinct()
    return near.where(F.levenshtein("a", "b") <= F.col("edits")).select(*keys, "a", "b")
