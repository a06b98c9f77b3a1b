"""Containment join: which keywords of a lexicon of any size occur in which texts, in the JVM and with one scan of the texts.

Texts and keywords fall into tokens, runs without white space. Where a keyword occurs in a text, its inner pieces are whole tokens of
the text, its first piece ends one and its last piece begins one; a keyword of one piece lies inside a token. So a keyword is filed
under one piece, the rarest, and which tokens agree with it is decided once on the distinct tokens of the texts. Only keywords with
white space are then tested on texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import marked
from rosterlake.session import stored

SPACE = r"\s+"
GRAM = 3
COMMON_SHARE = 1e-6  # of all pairs of text and token: at most a million tokens can have it; the others are joined by shuffling


def tokens_of(text: Column) -> Column:
    """Runs without white space; the empty one may be among them."""
    return F.split(text, SPACE)


def _grams(text: Column, k: int) -> Column:
    """All substrings of ``k`` characters."""
    n = F.length(text) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def _pieces(form: Column) -> Column:
    """Tokens of a keyword, each with how a token of the text has to agree with it; white space alone is one empty piece."""
    found = F.filter(tokens_of(form), lambda x: x != "")
    last = F.size(found) - 1

    def piece(token: Column, i: Column) -> Column:
        left, right = (i == 0) & ~form.rlike(r"^\s"), (i == last) & ~form.rlike(r"\s$")
        kind = F.when(left & right, "inside").when(left, "end").when(right, "begin").otherwise("whole")
        return F.struct(kind.alias("kind"), token.alias("piece"))

    return F.when(last < 0, F.array(F.struct(F.lit("whole").alias("kind"), F.lit("").alias("piece")))).otherwise(F.transform(found, piece))


def contained_terms(texts: DataFrame, lexicon: DataFrame, key: str, text: str, gram: int = GRAM, boundary: bool = False) -> DataFrame:
    """One row per text row and lexicon row whose keyword occurs in the text, case-insensitive.

    With ``boundary`` a keyword that begins or ends with a word character must begin or end at the edge of a word there. Categories and
    weights are joined to the hits by keyword. Repeated text rows, NULL keys, repeated lexicon rows and NULL weights all count as they
    are; NULL texts and empty or NULL keywords hit nothing; a very long text has one row per distinct token.

    A keyword is filed under its rarest piece: whole tokens by the texts that hold them, other pieces by their rarest run of ``gram``
    characters among the tokens of the texts. What agrees with the piece is decided on distinct tokens; a keyword without white space
    is then settled, others are tested on the texts that hold the token. Nothing of either side comes to the driver.

    A token brings all its keywords as one array. Tokens with COMMON_SHARE of the pairs are few at any size and meet the texts as a small
    table; only the others are shuffled, and none of these is hot. A text's keywords come together where the text is, so the
    pairs of text and keyword, many times as large as the texts, are never shuffled.
    """
    lex = lexicon.select("category", F.lower("keyword").alias("keyword"), "weight").filter(F.length("keyword") > 0)
    same = marked if boundary else (lambda c: c)
    keywords = lex.select("keyword").distinct().withColumn("form", same(F.col("keyword"))).withColumn("pieces", _pieces(F.col("form")))
    pieces = stored(keywords.select("keyword", "form", (F.col("pieces")[0]["piece"] == F.col("form")).alias("sure"), F.explode("pieces").alias("p")).select("keyword", "form", "sure", "p.kind", "p.piece"))
    spaced = not pieces.where("NOT sure").isEmpty()  # only then the texts themselves are looked at
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), F.lower(text).alias("_t")).filter("_t IS NOT NULL")
    # a text is marked once, not once for each keyword that is tested on it
    rows = rows.select("row", "_key", same(F.col("_t")).alias("_t"))
    rows = stored(rows.select("row", "_key", *(["_t"] if spaced else []), F.array_union(tokens_of(F.col("_t")), F.array(F.lit(""))).alias("tokens")))
    vocabulary = stored(rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")))
    # dealt by token, so that all keywords of a token come together without another shuffle; in a fixed number of parts, as their rows grow after it
    held = vocabulary.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token").select("token", "df", F.explode(F.array_distinct(F.concat(*[_grams(F.col("token"), k) for k in range(1, gram + 1)]))).alias("gram"))
    whole = pieces.where("kind = 'whole'").select("kind", "piece").distinct().join(vocabulary.withColumnRenamed("token", "piece"), "piece", "left")
    whole = whole.select("kind", "piece", F.lit("").alias("gram"), F.coalesce("df", F.lit(0)).alias("most"))
    partly = pieces.where("kind <> 'whole'").select("kind", "piece").distinct()
    partly = partly.withColumn("gram", F.explode(F.when(F.length("piece") < gram, F.array("piece")).otherwise(F.array_distinct(_grams(F.col("piece"), gram)))))
    grams = vocabulary.select("df", F.explode(F.array_distinct(F.concat(*[_grams(F.col("token"), k) for k in range(1, gram + 1)]))).alias("gram"))
    partly = partly.join(grams.groupBy("gram").agg(F.sum("df").alias("df")), "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    partly = partly.groupBy("kind", "piece").agg(F.min(F.struct("df", "gram")).alias("m")).select("kind", "piece", "m.gram", F.col("m.df").alias("most"))
    best = pieces.join(whole.union(partly), ["kind", "piece"]).groupBy("keyword").agg(F.min(F.struct("most", "kind", "piece", "gram")).alias("b"), F.first("sure").alias("sure"), F.first("form").alias("form"))
    # from here on a keyword is a number, negative if it has to be tested
    best = stored(best.where("b.most > 0").select(F.monotonically_increasing_id().alias("word"), "keyword", "form", "b.kind", "b.piece", "b.gram", "sure"))
    filed_as = best.groupBy("kind", "piece", "gram").agg(F.collect_list(F.when(F.col("sure"), F.col("word")).otherwise(-1 - F.col("word"))).alias("words"))
    agrees = (F.when(F.col("kind") == "inside", F.col("token").contains(F.col("piece"))).when(F.col("kind") == "end", F.col("token").endswith(F.col("piece")))
              .otherwise(F.col("token").startswith(F.col("piece"))))
    found = held.join(filed_as.where("kind <> 'whole'"), "gram").where(agrees)
    if spaced:
        found = found.select("token", "df", "words").union(vocabulary.join(filed_as.where("kind = 'whole'").withColumnRenamed("piece", "token"), "token").select("token", "df", "words"))
    filed = stored(found.groupBy("token").agg(F.first("df").alias("df"), F.array_sort(F.flatten(F.collect_list("words"))).alias("words")))
    least = COMMON_SHARE * (vocabulary.agg(F.sum("df")).first()[0] or 0)
    common = stored(filed.where(F.col("df") >= least).select("token", "words"))
    rare = rows.select("row", F.explode("tokens").alias("token")).join(common.select("token"), "token", "left_anti").join(filed.where(F.col("df") < least).select("token", "words"), "token")
    rare = rare.groupBy("row").agg(F.flatten(F.collect_list("words")).alias("rare"))
    # the rare tokens' keywords ride on the empty token, which every text has once
    near = rows.select("row", "_key", "tokens").repartition("row").join(rare, "row", "left").select("row", "_key", "rare", F.explode("tokens").alias("token")).join(common, "token", "left")
    words = F.concat(F.coalesce("words", F.array().cast("array<bigint>")), F.when((F.col("token") == "") & F.col("rare").isNotNull(), F.col("rare")).otherwise(F.array().cast("array<bigint>")))
    near = near.select("row", "_key", F.explode(words).alias("word")).distinct()
    hits = near.select("_key", "word")
    if spaced:
        tested = near.where("word < 0").select("row", "_key", (-1 - F.col("word")).alias("word")).join(best.select("word", "form"), "word").join(rows.select("row", "_t"), "row")
        hits = hits.where("word >= 0").union(tested.where(F.col("_t").contains(F.col("form"))).select("_key", "word"))
    return hits.join(stored(lex.join(best.select("word", "keyword"), "keyword")), "word").select(F.col("_key").alias(key), "category", "keyword", "weight")
