"""Metrics over operation logs: percentiles, histograms, rates, shard balance and roll-ups.

An operation is a row (seq, ts_ms, key, kind, micros).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import ordered

BUCKETS = 512
MAX_MICROS = 60e6
_STEP = math.log(MAX_MICROS) / BUCKETS


def bucket(micros: Column) -> Column:
    """The geometric latency bucket of a number of microseconds: 0 below 1, at most 511."""
    return F.when(micros < 1, 0).otherwise(F.least(F.lit(BUCKETS - 1), (F.floor(F.log(micros) / F.lit(_STEP)) + 1).cast("int"))).cast("int")


def histogram(ops: DataFrame, *by: str) -> DataFrame:
    """(by..., bucket, n, cumulative): counts of latency buckets and their running sum."""
    counts = ops.groupBy(*by, bucket(F.col("micros")).alias("bucket")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("cumulative", running)


def bucket_percentile(ops: DataFrame, q: float, *by: str) -> DataFrame:
    """(by..., bucket): the first bucket whose running sum reaches the share ``q``."""
    h = histogram(ops, *by).withColumn("total", F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)]))))
    return h.where(F.col("cumulative") >= F.ceil(F.col("total") * F.lit(q))).groupBy(*by).agg(F.min("bucket").alias("bucket"))


def percentiles(ops: DataFrame, *by: str) -> DataFrame:
    """Exact 50th, 90th and 99th percentile and mean.

    Distinct values are counted and numbered in slices of a group, so no task holds a group;
    a percentile lies between the values of the two ranks beside it.
    """
    keyed = ops.select(F.struct(*by).alias("key") if by else F.lit(0).alias("key"), F.col("micros").alias("value"))
    means = keyed.groupBy("key").agg(F.avg("value").alias("mean"), F.count("value").alias("all"))
    counts = keyed.where("value is not null").groupBy("key", "value").agg(F.count("*").alias("n"))
    upto = ordered.running_sum(counts, ordered.uneven_slices(counts, "value"), "value", F.col("n"), "upto").join(means.select("key", "all"), "key")
    quantiles = {f"p{int(q * 100)}": F.lit(q) * (F.col("all") - 1) for q in (0.5, 0.9, 0.99)}
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    ends = [at(side(x)).alias(p + end) for p, x in quantiles.items() for side, end in ((F.floor, "_low"), (F.ceil, "_high"))]
    found = means.join(upto.groupBy("key").agg(*ends), "key", "left")
    value = lambda p, x: F.when(F.floor(x) == F.ceil(x), F.col(p + "_low")).otherwise((F.ceil(x) - x) * F.col(p + "_low") + (x - F.floor(x)) * F.col(p + "_high"))
    return found.select(*[F.col("key")[b].alias(b) for b in by], *[F.round(value(p, x).cast("double"), 6).alias(p) for p, x in quantiles.items()], F.round("mean", 6).alias("mean"))


def shard_balance(ops: DataFrame, shard: Column) -> DataFrame:
    """(shard, n_ops, share): each shard's operations and its share of all."""
    counts = ops.groupBy(shard.alias("shard")).agg(F.count("*").alias("n_ops"))
    # a row for each shard
    return counts.withColumn("share", F.round(F.col("n_ops") / F.sum("n_ops").over(Window.partitionBy(F.lit(0))), 6))


def rates(ops: DataFrame, interval_ms: int, *by: str) -> DataFrame:
    """(by..., tick, n_ops, per_s, change): throughput of each interval and its change.

    The first interval has rate 0, later ones the operations since over the time since.
    """
    ticks = ops.groupBy(*by, F.floor(F.col("ts_ms") / F.lit(interval_ms)).cast("bigint").alias("tick")).agg(F.count("*").alias("n_ops"))
    w = Window.partitionBy(*by).orderBy("tick")
    seconds = (F.col("tick") - F.lag("tick").over(w)) * F.lit(interval_ms / 1000.0)
    per_s = F.round(F.coalesce(F.col("n_ops") / seconds, F.lit(0.0)), 6)
    before = F.lag("n_ops").over(w)
    return ticks.withColumn("per_s", per_s).withColumn("change", F.round((F.col("n_ops") - before) / before, 6))


def rolling(ops: DataFrame, interval_ms: int, samples: int, *by: str) -> DataFrame:
    """(by..., tick, n_ops, window_ops): sums over the last ``samples`` ticks that occur."""
    ticks = ops.groupBy(*by, F.floor(F.col("ts_ms") / F.lit(interval_ms)).cast("bigint").alias("tick")).agg(F.count("*").alias("n_ops"))
    w = Window.partitionBy(*by).orderBy("tick").rowsBetween(1 - samples, 0)
    return ticks.withColumn("window_ops", F.sum("n_ops").over(w))


def hit_rate(requests: DataFrame, found: Column, *by: str) -> DataFrame:
    """(by..., hits, misses, rate) of lookups."""
    counts = requests.groupBy(*by).agg(F.count_if(found).alias("hits"), F.count_if(~found).alias("misses"))
    return counts.withColumn("rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))


def read_ratio(ops: DataFrame, is_read: Column, *by: str) -> DataFrame:
    """(by..., reads, writes, ratio)."""
    counts = ops.groupBy(*by).agg(F.count_if(is_read).alias("reads"), F.count_if(~is_read).alias("writes"))
    return counts.withColumn("ratio", F.round(F.col("reads") / (F.col("reads") + F.col("writes")), 6))


def info(keys: DataFrame, state: DataFrame, ops: DataFrame, now_ms: int) -> DataFrame:
    """(section, field, value): INFO as a roll-up; each table is read once."""
    dead = F.coalesce(F.col("deadline_ms") <= now_ms, F.lit(False))
    size = F.octet_length("key") + F.octet_length("value") + 48
    parts = (
        (keys, {("keyspace", "keys"): F.count("*")}),
        (state, {("keyspace", "expires"): F.count_if(F.col("deadline_ms") > now_ms), ("keyspace", "expired"): F.count_if(dead), ("memory", "used"): F.coalesce(F.sum(F.when(~dead, size)), F.lit(0))}),
        (ops, {("stats", "commands"): F.count("*")}),
    )
    out = None
    for df, fields in parts:
        values = df.agg(*[v.cast("bigint").alias(f"v{i}") for i, v in enumerate(fields.values())])
        rows = values.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), F.col(f"v{i}").alias("value")) for i, (s, f) in enumerate(fields)])))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Buckets of the exposition: so many of the histogram's in one.
COARSE = 8


def bound_seconds(coarse: Column) -> Column:
    """The upper bound, in seconds, of a bucket of the exposition."""
    return F.exp(F.lit(_STEP) * F.least((coarse + 1) * COARSE, F.lit(BUCKETS))) / F.lit(1e6)


def by_shard(ops: DataFrame, keys: DataFrame, shard: Column, is_read: Column) -> DataFrame:
    """(shard, commands, reads, writes, keys, memory) of operations and live keys (key, bytes), both sharded by ``shard`` of their key."""
    done = ops.groupBy(shard.alias("shard")).agg(F.count("*").alias("commands"), F.count_if(is_read).alias("reads"), F.count_if(~is_read).alias("writes"))
    held = keys.groupBy(shard.alias("shard")).agg(F.count("*").alias("keys"), F.sum("bytes").cast("bigint").alias("memory"))
    return done.join(held, "shard", "full").select("shard", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("commands", "reads", "writes", "keys", "memory")])


def exposition(ops: DataFrame, keys: DataFrame, shard: Column, is_read: Column) -> DataFrame:
    """(name, label, value): a text exposition's samples: counters and gauges by shard, and the latency
    histogram of all shards, its buckets cumulative and none of them left out. ``exposition_line`` is their text."""
    each = by_shard(ops, keys, shard, is_read)
    sample = lambda name, label, value: F.struct(F.lit(name).alias("name"), label.alias("label"), value.cast("double").alias("value"))
    label = F.format_string('shard="%d"', "shard")
    counters = each.select(F.inline(F.array(*[sample(n, label, F.col(c)) for n, c in (("commands_total", "commands"), ("reads_total", "reads"), ("writes_total", "writes"), ("keys", "keys"), ("memory_bytes", "memory"))])))
    counts = ops.groupBy(F.floor(bucket(F.col("micros")) / COARSE).cast("int").alias("coarse")).agg(F.count("*").alias("n"))
    every = ops.sparkSession.range(BUCKETS // COARSE).select(F.col("id").cast("int").alias("coarse")).join(counts, "coarse", "left")
    # a row for each bucket
    upto = every.select("coarse", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("coarse")), F.lit(0)).alias("upto"))
    buckets = upto.select(F.lit("latency_seconds_bucket").alias("name"), F.format_string('le="%.9f"', bound_seconds(F.col("coarse"))).alias("label"), F.col("upto").cast("double").alias("value"))
    total = upto.agg(F.sum("n").alias("n"), F.sum(F.col("n") * bound_seconds(F.col("coarse"))).alias("s"))
    ends = total.select(F.inline(F.array(sample("latency_seconds_bucket", F.lit('le="+Inf"'), F.col("n")), sample("latency_seconds_count", F.lit(""), F.col("n")), sample("latency_seconds_sum", F.lit(""), F.col("s")))))
    return counters.unionByName(buckets).unionByName(ends)


def exposition_line(samples: DataFrame) -> DataFrame:
    """(line): samples as text; whole numbers without a fraction, others with six decimals."""
    value = F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.format_string("%.6f", "value"))
    label = F.when(F.col("label") != "", F.concat(F.lit("{"), "label", F.lit("}"))).otherwise(F.lit(""))
    return samples.select(F.concat("name", label, F.lit(" "), value).alias("line"))


def dashboard(ops: DataFrame, keys: DataFrame, shard: Column, is_read: Column) -> DataFrame:
    """One row (json): totals, latency percentiles by bucket, and an array of shards."""
    each = by_shard(ops, keys, shard, is_read)
    shards = F.array_sort(F.collect_list(F.struct("shard", "commands", "keys", "memory", "reads", "writes")))
    totals = each.agg(F.count("*").alias("shard_count"), *[F.sum(c).alias(c) for c in ("commands", "keys", "memory")], shards.alias("shards"))
    # one row each
    for q in (50, 99):
        totals = totals.crossJoin(bucket_percentile(ops, q / 100).select(F.col("bucket").alias(f"p{q}_bucket")))
    columns = ["shard_count", "commands", "keys", "memory", "p50_bucket", "p99_bucket", "shards"]
    return totals.select(F.to_json(F.struct(*columns)).alias("json"))
