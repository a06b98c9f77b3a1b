"""Search answers and vendor records -> rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import blank_to_null, nonblank
from rosterlake.functions.urls import host_without_www

ITEM = ("struct<link:string,url:string,formattedUrl:string,title:string,snippet:string,"
        "pagemap:struct<metatags:array<map<string,string>>>>")


def ingest_results(answers: DataFrame, body: str = "body", keep: Sequence[str] = ("query",)) -> DataFrame:
    """A stored answer is a list of items or an object with `items`. Address and title come from the first field that
    has them; an item with neither is dropped."""
    listed = F.from_json(body, f"array<{ITEM}>")
    wrapped = F.from_json(body, f"struct<items:array<{ITEM}>>")["items"]
    items = F.when(F.trim(body).startswith("["), listed).otherwise(wrapped)
    q = answers.select(*keep, F.posexplode(items).alias("pos", "i"))
    q = q.select(*keep, "pos", F.coalesce(blank_to_null("i.link"), blank_to_null("i.url"), blank_to_null("i.formattedUrl")).alias("url"),
                 F.coalesce(blank_to_null("i.title"), F.get("i.pagemap.metatags", F.lit(0))["og:title"]).alias("title"),
                 F.coalesce("i.snippet", F.lit("")).alias("snippet"))
    return q.filter(F.col("url").isNotNull() | F.col("title").isNotNull())


def normalize_results(results: DataFrame, method: str = "search") -> DataFrame:
    """Adds domain and method; category, state and query stay as given."""
    return results.filter(nonblank("url")).select("query", "pos", "url", "title", "snippet", "category", "state",
                                                  host_without_www("url").alias("domain"), F.lit(method).alias("discovery_method"))


COMPANY = ("struct<id:string,name:string,website_url:string,industry:string,short_description:string,phone:string,"
           "city:string,state:string,street_address:string,postal_code:string>")


def vendor_organizations(records: DataFrame, body: str = "body", seq: str = "seq", limit: int | None = None) -> DataFrame:
    """Nested company JSON -> organization columns, in record order, cut to ``limit`` when given."""
    q = records.select(seq, "org_type", F.from_json(body, f"struct<organization:{COMPANY}>")["organization"].alias("o")).filter(nonblank("o.name"))
    q = q.select(seq, F.col("o.name").alias("name"), "org_type", F.col("o.website_url").alias("website"), F.col("o.short_description").alias("description"),
                 F.col("o.phone").alias("phone"), F.col("o.city").alias("city"), F.col("o.state").alias("state"), F.col("o.street_address").alias("address"),
                 F.col("o.postal_code").alias("zip_code"))
    return q if limit is None else q.orderBy(seq).limit(limit)


def extracted_organizations(answers: DataFrame, body: str = "body", url: str = "url", known_types: Sequence[str] = (), lexicon: dict | None = None) -> DataFrame:
    """Organizations from free-text answers that hold JSON: a name is needed, an unknown type is read from the words,
    relevance is ten times the confidence (0.5 when missing), at most 10."""
    from rosterlake.functions.content import json_records
    from rosterlake.operators.scoring import type_by_keyword_count
    rec = json_records(body, "array<struct<name:string,org_type:string,description:string,state:string,confidence_score:double>>")
    q = answers.select(url, F.posexplode(rec).alias("pos", "o")).select(F.col(url).alias("source_url"), "pos", "o.*").filter(nonblank("name"))
    words = F.concat_ws(" ", "name", F.coalesce("description", F.lit("")))
    guess = type_by_keyword_count(words, lexicon) if lexicon else type_by_keyword_count(words)
    return (q.withColumn("org_type", F.when(F.col("org_type").isin(list(known_types)), F.col("org_type")).otherwise(guess))
            .withColumn("relevance_score", F.least(F.lit(10.0), F.coalesce("confidence_score", F.lit(0.5)) * 10))
            .withColumn("discovery_method", F.lit("content_extraction")))
