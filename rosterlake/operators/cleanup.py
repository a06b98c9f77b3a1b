"""Clean-up of stored organizations whose name is really the title of a web page."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.people import webpage_title
from rosterlake.functions.text import nonblank
from rosterlake.operators.merge import move_contacts, upsert_organizations
from rosterlake.operators.reports import one_row


class FixedOrganizations(NamedTuple):
    organizations: DataFrame
    contacts: DataFrame
    moves: DataFrame
    statistics: DataFrame


def fix_title_organizations(orgs: DataFrame, contacts: DataFrame, extracted: DataFrame) -> FixedOrganizations:
    """Replace title-like organizations by the ones read from them.

    ``extracted`` holds one row per title (``title_id`` and organization columns). They are upserted by (name, state);
    new rows get a number derived from name and state, so a repeated run gives the same ids; the contacts move.
    """
    titles = orgs.filter(webpage_title("name")).select(F.col("id").alias("title_id"))
    real = extracted.filter(nonblank("name")).join(titles, "title_id", "left_semi").withColumn("seq", F.col("title_id"))
    merged = upsert_organizations(orgs, real, raise_confidence=True, fill_description=True, default_type="water")
    # below zero: never meets a stored id
    made = -F.abs(F.xxhash64("name", "state") % F.lit(2**62)) - 1
    merged = merged.withColumn("id", F.coalesce("id", made))
    ids = merged.groupBy("name", "state").agg(F.min(F.struct((F.col("id") < 0).alias("new"), "id"))["id"].alias("new_id"))
    moves = real.join(ids, ["name", "state"]).select(F.col("title_id").alias("old_id"), "new_id")
    n = contacts.groupBy(F.col("organization_id").alias("old_id")).agg(F.count("*").alias("n"))
    stats = one_row(
        orgs.agg(F.count("*").alias("total_orgs"), F.count_if(webpage_title("name")).alias("webpage_titles")),
        moves.join(n, "old_id", "left").agg(F.count("*").alias("fixed_orgs"), F.coalesce(F.sum("n"), F.lit(0)).alias("moved_contacts")))
    stats = stats.withColumn("skipped", F.col("webpage_titles") - F.col("fixed_orgs"))
    return FixedOrganizations(merged, move_contacts(contacts, moves), moves, stats)
