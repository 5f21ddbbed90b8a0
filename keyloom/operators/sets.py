"""Sets: (key, member), distinct rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add(log: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """SADD: members after all additions."""
    rows = log.select("key", "member")
    return (rows if state is None else state.unionByName(rows)).distinct()


def added(log: DataFrame, state: DataFrame) -> DataFrame:
    """How many members each key gains by SADD."""
    return log.select("key", "member").distinct().join(state, ["key", "member"], "left_anti").groupBy("key").agg(F.count("*").alias("n_added"))


def remove(state: DataFrame, requests: DataFrame) -> DataFrame:
    """SREM: what is left."""
    return state.join(requests.select("key", "member"), ["key", "member"], "left_anti")


def removed(state: DataFrame, requests: DataFrame) -> DataFrame:
    """SREM's reply: how many members each key loses."""
    return state.join(requests.select("key", "member"), ["key", "member"], "left_semi").groupBy("key").agg(F.count("*").alias("n_removed"))


def is_member(requests: DataFrame, state: DataFrame) -> DataFrame:
    """SISMEMBER: requests with ``found``."""
    held = state.select("key", "member", F.lit(True).alias("held"))
    return requests.join(held, ["key", "member"], "left").withColumn("found", F.coalesce("held", F.lit(False))).drop("held")


def cardinality(state: DataFrame) -> DataFrame:
    """SCARD of every set."""
    return state.groupBy("key").agg(F.count("*").alias("n_members"))


def members(state: DataFrame) -> DataFrame:
    """SMEMBERS of every set, in order. A set is one value here, so it has to fit in memory; the rows of ``state`` are the same answer for those that don't."""
    return state.groupBy("key").agg(F.array_sort(F.collect_list("member")).alias("members"))


def pop(state: DataFrame, count: int) -> DataFrame:
    """SPOP: ``count`` members of every set, chosen by hash, the same each time."""
    rn = F.row_number().over(Window.partitionBy("key").orderBy(F.md5("member"), "member"))
    return state.withColumn("rn", rn).where(F.col("rn") <= count).drop("rn")


def left_after_pop(state: DataFrame, count: int) -> DataFrame:
    """What SPOP leaves of every set; sets without members are gone."""
    return state.join(pop(state, count).select("key", "member"), ["key", "member"], "left_anti")
