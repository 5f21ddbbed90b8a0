"""State tables made of the driver's tables: strings, hashes, lists, sets, scored sets, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time of every registered query; never the wall clock.
NOW_MS = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value, deadline_ms): customer names; two thirds have a deadline around NOW_MS."""
    c = F.col("c_custkey")
    deadline = F.when(c % 3 != 0, F.lit(NOW_MS) + (c % 7 - 3) * 1500)
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), c).alias("key"), F.col("c_name").alias("value"), deadline.alias("deadline_ms"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, field, value): the last properties of each user's event types."""
    return (table(spark, sf_dir, "events").groupBy(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("field"))
            .agg(F.max_by("props", "event_id").alias("value")))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, pos, value): the roles of each conversation's turns."""
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv:"), "conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("value"))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, member): the order priorities of each customer, distinct."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.col("o_orderpriority").alias("member")).distinct()


def zsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, member, score): customers of each segment by balance."""
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, label, vec): embeddings by label."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("emb:"), "label").alias("key"), F.col("vec_id").alias("label"), F.col("embedding").alias("vec"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts_ms, key, kind, value, props): the operations log of the registered queries."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.concat(F.lit("user:"), "user_id").alias("key"),
        F.col("event_type").alias("kind"), "value", "props")


#: The same tables for DuckDB.
SQL = {
    "strings": "SELECT 'customer:' || c_custkey AS key, c_name AS value, CASE WHEN c_custkey % 3 <> 0 THEN 1700000000000 + (c_custkey % 7 - 3) * 1500 END AS deadline_ms FROM customer",
    "hashes": "SELECT 'user:' || user_id AS key, event_type AS field, arg_max(props, event_id) AS value FROM events GROUP BY ALL",
    "lists": "SELECT 'conv:' || conv_id AS key, turn AS pos, role AS value FROM conversations",
    "sets": "SELECT DISTINCT 'cust:' || o_custkey AS key, o_orderpriority AS member FROM orders",
    "zsets": "SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer",
    "vectors": "SELECT 'emb:' || label AS key, vec_id AS label, embedding AS vec FROM embeddings",
    "log": "SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, 'user:' || user_id AS key, event_type AS kind, value, props FROM events",
}
