"""Groups of names of one organisation: known ones and those confirmed in a run, merged where they share a name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ALIAS_GROUPS
from ..functions.names import with_nfkc
from ..functions.orgs import acronym, org_key
from .components import components
from .store import settle


@dataclass
class Aliases:
    """keys (k, canon): the key of a name and that of its group; acronyms (acr, canon); names (canon, name)."""

    keys: DataFrame
    acronyms: DataFrame
    names: DataFrame


def known_groups(spark: SparkSession) -> DataFrame:
    """The groups that are known from the start: group_id, name."""
    return spark.createDataFrame([(k, n) for k, g in enumerate(ALIAS_GROUPS) for n in g], "group_id long, name string")


def alias_table(groups: DataFrame, known: DataFrame | None = None) -> Aliases:
    """One table of aliases from groups (group_id, name) and groups known from the start (known_groups() by default).

    Groups that share the key of a name are one, however long the chain between them. A merged group goes by the longest key of the
    known group in it with the smallest group_id, or, where there is none, by the longest of all its keys; of keys of one length by the last in order. The result does not
    depend on the order of the groups. An acronym of four letters or more that stands for several groups goes to the one first in order.
    """
    known = known_groups(groups.sparkSession) if known is None else known
    every = known.select(F.lit(0).alias("late"), F.col("group_id").cast("string").alias("group_id"), "name").unionByName(groups.select(F.lit(1).alias("late"), F.col("group_id").cast("string").alias("group_id"), "name"))
    keyed = with_nfkc(every, "name", "_c").select("late", "group_id", "name", org_key(F.col("_c")).alias("k"), acronym(F.col("_c")).alias("acr")).where("k != ''")
    keyed = settle(keyed.distinct())
    star = keyed.groupBy("late", "group_id").agg(F.min("k").alias("hub"))
    found = settle(components(keyed.join(star, ["late", "group_id"]).select("k", "hub"), "k", "hub").withColumnRenamed("node", "k"))
    placed = keyed.join(found, "k")
    rank = F.struct(F.when(F.col("late") == 0, -F.col("group_id").try_cast("long")), F.length("k"), F.col("k"))  # nulls are smallest
    canon = placed.groupBy("component").agg(F.max_by("k", rank).alias("canon"))
    placed = settle(placed.join(canon, "component").select("name", "k", "acr", "canon").distinct())
    return Aliases(
        placed.select("k", "canon").distinct(),
        placed.where(F.length("acr") >= 4).groupBy("acr").agg(F.min("canon").alias("canon")),
        placed.select("canon", "name").distinct(),
    )


def by_group(keyed: DataFrame, aliases: Aliases) -> DataFrame:
    """keyed (own, acr, ...) with canonical, the key of the alias group: by the own key, or an acronym of four letters or more, else the own key."""
    out = keyed.join(aliases.keys.toDF("own", "_by_key"), "own", "left").join(aliases.acronyms.toDF("acr", "_by_acr"), "acr", "left")
    return out.withColumn("canonical", F.coalesce("_by_key", "_by_acr", "own")).drop("_by_key", "_by_acr")


def canonical(names: DataFrame, column: str, aliases: Aliases) -> DataFrame:
    """names with canonical, the key of their alias group."""
    own = with_nfkc(names.select(column).distinct(), column, "_c").select(column, org_key(F.col("_c")).alias("own"), acronym(F.col("_c")).alias("acr"))
    return names.join(by_group(own, aliases).select(column, "canonical"), column, "left")
