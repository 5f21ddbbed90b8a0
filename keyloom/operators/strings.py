"""Strings: lookups, writes folded from an ordered log, byte ranges and counters.

State tables have (key, value, deadline_ms); requests have a ``key`` and whatever identifies
them; a log has (seq, key, value). Lookups are left joins that keep every request; writes are
one grouped aggregate by key, so a hot key is combined before it is shuffled; replies of every
write are computed within slices of a key's log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.keys import live, slice_bounds
from keyloom.functions.ordered import even_slices, previous, running_sum


def get(requests: DataFrame, state: DataFrame, now_ms: int) -> DataFrame:
    """GET and MGET: each request with its live value or null."""
    return requests.join(live(state, now_ms).select("key", "value"), "key", "left")


def set_last(log: DataFrame) -> DataFrame:
    """SET: the last write of each key."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def set_many(log: DataFrame) -> DataFrame:
    """MSET: the single writes of a log (seq, pairs); of one key twice in a command the last counts."""
    each = log.select("seq", F.posexplode("pairs").alias("at", "pair")).select("seq", "at", "pair.key", "pair.value")
    return each.groupBy("seq", "key").agg(F.max_by("value", "at").alias("value"))


def set_absent(log: DataFrame, keys: DataFrame) -> DataFrame:
    """SETNX: the first write of each key that isn't among ``keys``, the live keys of all types."""
    return log.join(keys.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by("value", "seq").alias("value"))


def set_present(log: DataFrame, keys: DataFrame) -> DataFrame:
    """SET XX: the last write of each key that is among ``keys``, the live keys of all types."""
    return log.join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def set_expiring(log: DataFrame, ttl_ms: int) -> DataFrame:
    """SETEX and PSETEX: the last write and its deadline; ``log`` has ts_ms."""
    last = F.max_by(F.struct("value", (F.col("ts_ms") + ttl_ms).alias("deadline_ms")), F.col("seq"))
    return log.groupBy("key").agg(last.alias("w")).select("key", "w.value", "w.deadline_ms")


def set_keeping_ttl(log: DataFrame, state: DataFrame, keep: bool, now_ms: int) -> DataFrame:
    """SET with or without KEEPTTL over the live ``state``: untouched keys stay as they are."""
    last = set_last(log).withColumnRenamed("value", "new")
    joined = live(state, now_ms).join(last, "key", "full")
    deadline = F.col("deadline_ms") if keep else F.when(F.col("new").isNull(), F.col("deadline_ms"))
    return joined.select("key", F.coalesce("new", "value").alias("value"), deadline.alias("deadline_ms"))


def set_with_options(log: DataFrame, state: DataFrame, now_ms: int) -> DataFrame:
    """SET with any options: the live ``state`` after a log (seq, key, value, only, keep, in_ms, at_ms).

    only: nx, xx or null. keep: KEEPTTL. in_ms: EX or PX as milliseconds from ``now_ms``; at_ms: EXAT
    or PXAT as milliseconds; a deadline comes before KEEPTTL, and one that isn't above 0 makes the
    write an error, which changes nothing. The log is one moment, so no deadline passes within it.

    A missing key's first write that isn't XX makes it; before it XX, after it NX does nothing.
    """
    sound = (F.coalesce("in_ms", F.lit(1)) > 0) & (F.coalesce("at_ms", F.lit(1)) > 0)
    held = live(state, now_ms).select("key", F.col("value").alias("old"), F.col("deadline_ms").alias("old_deadline"), F.lit(True).alias("held"))
    writes = log.where(sound)
    made = writes.where("only is null or only <> 'xx'").groupBy("key").agg(F.min("seq").alias("made"))
    joined = writes.join(held.select("key", "held"), "key", "left").join(made, "key", "left")
    only, seq = F.coalesce("only", F.lit("")), F.col("seq")
    done = F.when(F.col("held"), only != "nx").otherwise((seq == F.col("made")) | ((seq > F.col("made")) & (only != "nx")))
    own = F.coalesce(F.col("at_ms"), F.lit(now_ms) + F.col("in_ms"))
    resets = own.isNotNull() | ~F.coalesce("keep", F.lit(False))
    folded = joined.where(done).groupBy("key").agg(
        F.max_by("value", "seq").alias("new"), F.max_by(F.struct(own.alias("deadline")), F.when(resets, seq)).alias("reset"), F.lit(True).alias("written"))
    out = held.join(folded, "key", "full")
    deadline = F.when(F.col("reset").isNotNull(), F.col("reset.deadline")).otherwise(F.col("old_deadline"))
    return out.select("key", F.when(F.col("written"), F.col("new")).otherwise(F.col("old")).alias("value"), deadline.alias("deadline_ms"))


def get_set(log: DataFrame) -> DataFrame:
    """GETSET and SET GET: every write with the value before it."""
    return previous(log, even_slices(log, "seq"), "seq", "value", "previous")


def append(log: DataFrame) -> DataFrame:
    """APPEND: the concatenation of each key's writes in order, and its bytes. A string is one value, so it has to fit in memory."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    joined = F.array_join(F.transform(parts, lambda p: p["value"]), "")
    return log.groupBy("key").agg(joined.alias("value")).withColumn("n_bytes", F.octet_length("value").cast("bigint"))


def strlen(requests: DataFrame, state: DataFrame, now_ms: int) -> DataFrame:
    """STRLEN: bytes, 0 for a missing key."""
    return get(requests, state, now_ms).withColumn("n_bytes", F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint")).drop("value")


def byte_range(value: Column, start: int, stop: int) -> Column:
    """GETRANGE of a column: bytes start..stop, both included, negative from the end."""
    data = F.encode(F.coalesce(value, F.lit("")), "utf-8")
    first, last = slice_bounds(start, stop, F.octet_length(data))
    return F.when(last >= first, F.substring(data, first + 1, last - first + 1)).otherwise(F.lit(b""))


def set_range(value: Column, offset: int, patch: str) -> Column:
    """SETRANGE of a column: overwritten from a byte offset, padded with NUL."""
    data = F.encode(F.coalesce(value, F.lit("")), "utf-8")
    size = F.greatest(F.octet_length(data), F.lit(offset))
    padded = F.when(F.octet_length(data) >= offset, data).otherwise(F.rpad(data, size, F.unhex(F.lit("00"))))
    return F.overlay(padded, F.encode(F.lit(patch), "utf-8"), F.lit(offset + 1))


def increase(log: DataFrame, delta: Column, name: str = "total") -> DataFrame:
    """INCR, DECR, INCRBY, DECRBY, INCRBYFLOAT: each key's total."""
    return log.groupBy("key").agg(F.sum(delta).alias(name))


def running(log: DataFrame, delta: Column, name: str = "running") -> DataFrame:
    """Every counter operation with the value that it replies."""
    return running_sum(log, even_slices(log, "seq"), "seq", delta, name)


def increase_checked(log: DataFrame, delta: Column) -> DataFrame:
    """As ``increase`` for whole numbers of up to 38 digits; null where the total overflows 64 bits, whatever the order of the sum."""
    return log.groupBy("key").agg(F.try_sum(delta.cast("decimal(38,0)")).try_cast("bigint").alias("total"))
