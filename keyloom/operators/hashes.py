"""Hashes: (key, field, value), one row a field. A hash without rows does not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_fields(log: DataFrame) -> DataFrame:
    """HSET and HMSET: the last write of each field; ``log`` has (seq, key, field, value)."""
    return log.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def get_fields(requests: DataFrame, state: DataFrame) -> DataFrame:
    """HGET and HMGET: requests (key, field, ...) with the value or null."""
    return requests.join(state, ["key", "field"], "left")


def has_field(requests: DataFrame, state: DataFrame) -> DataFrame:
    """HEXISTS: requests with ``found``."""
    held = state.select("key", "field", F.lit(True).alias("held"))
    return requests.join(held, ["key", "field"], "left").withColumn("found", F.coalesce("held", F.lit(False))).drop("held")


def delete_fields(state: DataFrame, requests: DataFrame) -> DataFrame:
    """HDEL: what is left; hashes without fields are gone."""
    return state.join(requests.select("key", "field"), ["key", "field"], "left_anti")


def added(log: DataFrame, state: DataFrame) -> DataFrame:
    """HSET's reply: how many new fields each key gains."""
    return log.select("key", "field").distinct().join(state, ["key", "field"], "left_anti").groupBy("key").agg(F.count("*").alias("n_added"))


def deleted(state: DataFrame, requests: DataFrame) -> DataFrame:
    """HDEL's reply: how many fields each key loses."""
    return state.join(requests.select("key", "field"), ["key", "field"], "left_semi").groupBy("key").agg(F.count("*").alias("n_removed"))


def _sorted(column: Column) -> Column:
    return F.array_sort(F.collect_list(column))


def get_all(state: DataFrame) -> DataFrame:
    """HGETALL and HLEN of every hash, fields in order. A hash is one value, so it has to fit in memory;
    the rows of ``state`` are the same answer for those that don't."""
    entries = _sorted(F.struct("field", "value"))
    return state.groupBy("key").agg(entries.alias("e")).select(
        "key", F.transform("e", lambda x: x["field"]).alias("fields"), F.transform("e", lambda x: x["value"]).alias("values"), F.size("e").cast("bigint").alias("n_fields"))


def keys(state: DataFrame) -> DataFrame:
    """HKEYS of every hash, in order; values aren't read."""
    return state.groupBy("key").agg(_sorted(F.col("field")).alias("fields"))


def values(state: DataFrame) -> DataFrame:
    """HVALS of every hash, in the order of the fields."""
    return get_all(state).select("key", "values")


def as_map(state: DataFrame) -> DataFrame:
    """Each hash as a map column."""
    return state.groupBy("key").agg(F.map_from_entries(_sorted(F.struct("field", "value"))).alias("hash"))


def increase(log: DataFrame, delta: Column) -> DataFrame:
    """HINCRBY: the total of each field."""
    return log.groupBy("key", "field").agg(F.sum(delta).cast("bigint").alias("total"))
