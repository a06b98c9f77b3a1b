"""Stored tables: typed reads, exports and run logs."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.operators.predicates import ts

CONTACT_SCHEMA = ("id long, organization_id long, first_name string, last_name string, job_title string, email string, phone string, assigned_to string, "
                  "email_draft_created boolean, email_draft_date timestamp, email_draft_id string, email_sent boolean, status string, contact_type string, "
                  "discovery_method string, contact_confidence_score double, contact_relevance_score double, email_valid boolean, notes string, "
                  "date_added timestamp, last_updated timestamp")
ORGANIZATION_SCHEMA = ("id long, name string, org_type string, subtype string, website string, address string, city string, state string, zip_code string, "
                       "county string, phone string, description string, source_url string, date_added timestamp, last_crawled timestamp, confidence_score double, "
                       "relevance_score double, data_quality_score double, infrastructure_score double, process_complexity_score double, automation_level double, "
                       "is_competitor boolean, integration_opportunity_score double, extended_data string, contact_discovery_status string")


def read_entities(spark: SparkSession, path: str, schema: str, by: str = "id") -> DataFrame:
    """Full scan of an entity table in id order."""
    return spark.read.schema(schema).parquet(path).orderBy(by)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Cast to the schema; a missing column becomes NULL, extra columns are dropped."""
    want = T.StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def append_table(df: DataFrame, path: str, *partition_by: str) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# ---- settings -------------------------------------------------------------------------------

def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """JSON settings `{"org type": "user", ...}`, one object per file -> (org_type, assigned_to, rank)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,string>")
    return raw.select(F.posexplode(F.map_entries(m)).alias("rank", "e")).select(
        F.col("e.key").alias("org_type"), F.col("e.value").alias("assigned_to"), "rank")


def bounded_setting(c: Column, default: float = 0.7) -> Column:
    """Thresholds outside [0, 1], or missing, fall back to the default."""
    return F.when(c.between(0, 1), c).otherwise(F.lit(default))


def read_hurdles(spark: SparkSession, path: str) -> dict[str, float]:
    """The two validation thresholds as numbers; a settings file is one row."""
    row = (spark.read.schema("org_confidence_hurdle double, name_confidence_hurdle double").option("multiLine", True).json(path)
           .select(*[bounded_setting(F.col(c)).alias(c) for c in ("org_confidence_hurdle", "name_confidence_hurdle")]).limit(1).collect())
    return row[0].asDict() if row else {"org_confidence_hurdle": 0.7, "name_confidence_hurdle": 0.7}


# ---- run metrics and run log ----------------------------------------------------------------

def run_metrics(counters: DataFrame, as_of: dt.datetime, runtime_seconds: int, errors: int = 0) -> DataFrame:
    """One metrics row from a one-row frame of counters."""
    return counters.select(ts(as_of).alias("metric_date"), "*", F.lit(runtime_seconds).alias("runtime_seconds"), F.lit(errors).alias("errors_count"))


def run_started(runs: DataFrame, at: str = "started_at") -> DataFrame:
    """Open log rows: state `running`, no counts yet."""
    return runs.select("id", "process_type", F.col(at).alias("at"), F.lit("running").alias("status"), F.lit(None).cast("int").alias("items_processed"),
                       F.lit(None).cast("int").alias("items_added"), F.lit(None).cast("string").alias("details"))


def run_finished(runs: DataFrame, at: str, details: list[str]) -> DataFrame:
    return runs.select("id", "process_type", F.col(at).alias("at"), "status", "items_processed", "items_added", F.to_json(F.struct(*details)).alias("details"))


def latest_runs(log: DataFrame) -> DataFrame:
    """Current state of every run from its appended rows; a closing row beats an opening one of the same time."""
    order = F.struct("at", (F.col("status") != "running").alias("closed"), "status", "items_processed", "items_added")
    return log.groupBy("id").agg(F.max_by(F.struct("process_type", "status", "items_processed", "items_added", "details"), order).alias("r"),
                                 F.min("at").alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("completed_at")).select(
        "id", "r.*", "started_at", "completed_at")
