"""Lists: (key, pos, value), ordered by pos, unique in a key, which needn't be gapless."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from keyloom.functions.keys import slice_bounds
from keyloom.functions.ordered import even_slices, numbered


def _by_key() -> WindowSpec:
    return Window.partitionBy("key")


def push(log: DataFrame, left: bool = False) -> DataFrame:
    """RPUSH or LPUSH of a log (seq, key, value): lists with places from 0."""
    part = even_slices(log, "seq")
    order = F.col("seq").desc() if left else F.col("seq")
    return numbered(log.select("key", "seq", "value"), -part if left and part is not None else part, [order], "pos").select("key", "pos", "value")


def push_lengths(log: DataFrame, state: DataFrame) -> DataFrame:
    """The reply of every push (seq, key, value): (seq, key, length) after it, over lists that are there."""
    placed = numbered(log.select("key", "seq"), even_slices(log, "seq"), [F.col("seq")], "before")
    return placed.join(length(state), "key", "left").select("seq", "key", (F.col("before") + 1 + F.coalesce("length", F.lit(0))).alias("length"))


def length(state: DataFrame) -> DataFrame:
    """LLEN of every list."""
    return state.groupBy("key").agg(F.count("*").alias("length"))


def _placed(state: DataFrame) -> DataFrame:
    """``state`` with ``place`` from 0 and ``length``; a long list is numbered in slices, by many tasks."""
    return numbered(state.select("key", "pos", "value"), even_slices(state, "pos"), [F.col("pos")], "place").join(length(state), "key")


def slices(state: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE of every list: (key, place, value), ends included, negative from the end."""
    if start < 0 and stop < 0:
        placed = state.withColumn("rn", F.row_number().over(_by_key().orderBy(F.col("pos").desc())))
        found = placed.where((F.col("rn") <= -start) & (F.col("rn") >= -stop)).join(length(state), "key")
        return found.select("key", (F.col("length") - F.col("rn")).alias("place"), "value")
    if start >= 0 and stop >= 0:
        placed = state.withColumn("rn", F.row_number().over(_by_key().orderBy("pos")))
        found = placed.where((F.col("rn") <= stop + 1) & (F.col("rn") > start))
        return found.select("key", (F.col("rn") - 1).cast("bigint").alias("place"), "value")
    first, last = slice_bounds(start, stop, F.col("length"))
    return _placed(state).where((F.col("place") >= first) & (F.col("place") <= last)).select("key", "place", "value")


def element(state: DataFrame, index: int) -> DataFrame:
    """LINDEX of every list: (key, value), null where it is out of range.

    Only the rows up to the element, from its nearer end, outlive the first step of the window.
    """
    order, nth = (F.col("pos"), index + 1) if index >= 0 else (F.col("pos").desc(), -index)
    near = state.withColumn("rn", F.row_number().over(_by_key().orderBy(order))).where(F.col("rn") <= nth)
    return near.groupBy("key").agg(F.max(F.when(F.col("rn") == nth, F.col("value"))).alias("value"))


def _end(state: DataFrame, index: int) -> DataFrame:
    """(key, pos) of the element at ``index`` of every list that is long enough."""
    order, nth = (F.col("pos"), index + 1) if index >= 0 else (F.col("pos").desc(), -index)
    near = state.select("key", "pos").withColumn("rn", F.row_number().over(_by_key().orderBy(order))).where(F.col("rn") <= nth)
    return near.where(F.col("rn") == nth).select("key", "pos")


def set_element(state: DataFrame, index: int, value: str) -> DataFrame:
    """LSET of every list that is long enough; others stay as they are.

    Only the rows up to the element, from its nearer end, are numbered.
    """
    at = _end(state, index).withColumn("hit", F.lit(True))
    return state.join(at, ["key", "pos"], "left").select("key", "pos", F.when(F.col("hit"), F.lit(value)).otherwise(F.col("value")).alias("value"))


def set_replies(requests: DataFrame, state: DataFrame) -> DataFrame:
    """LSET's replies: requests (key, index, ...) with ``error``, null where the element is there."""
    index, n = F.col("index"), F.col("length")
    error = F.when(n.isNull(), F.lit("no such key")).when((index >= n) | (index < -n), F.lit("index out of range"))
    return requests.join(length(state), "key", "left").withColumn("error", error).drop("length")


def pop(state: DataFrame, count: int, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """LPOP or RPOP of ``count`` elements of every list: (popped, left over)."""
    order = F.col("pos") if left else F.col("pos").desc()
    gone = state.withColumn("rn", F.row_number().over(_by_key().orderBy(order))).where(F.col("rn") <= count)
    popped = gone.select("key", (F.col("rn") - 1).cast("bigint").alias("place"), "value")
    return popped, state.join(gone.select("key", "pos"), ["key", "pos"], "left_anti").select("key", "pos", "value")
