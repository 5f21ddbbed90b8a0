"""Scored sets: (key, member, score), one row a member, ordered by score and member."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from keyloom.functions.keys import slice_bounds
from keyloom.functions.ordered import even_slices, numbered, running_sum, uneven_slices


def _by_key() -> WindowSpec:
    return Window.partitionBy("key")


def add(log: DataFrame, rule: str = "last", state: DataFrame | None = None) -> DataFrame:
    """ZADD of a log (seq, key, member, score) over ``state``.

    rule: last (plain), nx (only new members, first write), xx (only members of ``state``, last
    write), gt or lt (scores only rise or fall; new members are added), incr (scores add up).
    """
    best = {"last": F.max_by("score", "seq"), "nx": F.min_by("score", "seq"), "xx": F.max_by("score", "seq"), "gt": F.max("score"), "lt": F.min("score"), "incr": F.sum("score")}
    if rule not in best:
        raise ValueError(f"unknown rule {rule}")
    if state is None:
        rows = log.where(F.lit(rule != "xx"))
    elif rule == "nx":
        return state.unionByName(log.join(state, ["key", "member"], "left_anti").groupBy("key", "member").agg(best["nx"].alias("score")).select("key", "member", "score"))
    elif rule == "xx":
        new = log.groupBy("key", "member").agg(best["xx"].alias("new"))
        return state.join(new, ["key", "member"], "left").select("key", "member", F.coalesce("new", "score").alias("score"))
    else:
        rows = log.select("seq", "key", "member", "score").unionByName(state.select(F.lit(None).cast("bigint").alias("seq"), "key", "member", "score"))
        if rule == "last":
            rows = rows.withColumn("seq", F.coalesce("seq", F.lit(-(1 << 62))))
    return rows.groupBy("key", "member").agg(best[rule].alias("score"))


def update(log: DataFrame, state: DataFrame, only: str | None = None, toward: str | None = None, incr: bool = False) -> DataFrame:
    """ZADD with any options: (key, member, score) after a log (seq, key, member, score).

    only: new (NX) or old (XX) members. toward: up (GT) or down (LT), which rules members that are
    there; new ones are added all the same. incr: scores are added to the one before. Contradictory
    options, which NX with GT or LT is too, are refused.
    """
    if only not in (None, "new", "old") or toward not in (None, "up", "down") or (only == "new" and toward):
        raise ValueError(f"no such options: {only}, {toward}")
    first = F.min_by("score", "seq")
    if incr:
        step = F.col("score") if toward is None else F.greatest("score", F.lit(0.0)) if toward == "up" else F.least("score", F.lit(0.0))
        rest = F.sum(step) - F.min_by(step, F.col("seq"))
        # a new member's first score counts whatever its direction; those of the old ones all have to point it
        made, moved = first + rest, F.col("score") + F.col("step")
    else:
        step = None
        best = {None: F.max_by("score", "seq"), "up": F.max("score"), "down": F.min("score")}[toward]
        made, moved = best, {None: F.col("step"), "up": F.greatest("score", "step"), "down": F.least("score", "step")}[toward]
    if only == "new":
        made = first
    folded = log.groupBy("key", "member").agg(made.alias("made"), (F.sum(step) if incr else best).alias("step"))
    joined = state.withColumn("held", F.lit(True)).join(folded, ["key", "member"], "left" if only == "old" else "full")
    after = F.when(F.col("held").isNull(), F.col("made")).when(F.col("step").isNull() | F.lit(only == "new"), F.col("score")).otherwise(moved)
    return joined.select("key", "member", after.alias("score"))


def added(log: DataFrame, state: DataFrame) -> DataFrame:
    """ZADD's reply: how many new members each key gains."""
    return log.select("key", "member").distinct().join(state, ["key", "member"], "left_anti").groupBy("key").agg(F.count("*").alias("n_added"))


def increments(log: DataFrame, state: DataFrame) -> DataFrame:
    """The reply of every ZINCRBY and ZADD INCR: (seq, key, member, reply), the member's score after it."""
    each = log.select("seq", F.struct("key", "member").alias("key"), "score")
    sums = running_sum(each, even_slices(each, "seq"), "seq", F.col("score"), "sum").select("seq", "key.key", "key.member", "sum")
    return sums.join(state, ["key", "member"], "left").select("seq", "key", "member", (F.coalesce("score", F.lit(0.0)) + F.col("sum")).alias("reply"))


def changed(log: DataFrame, state: DataFrame) -> DataFrame:
    """ZADD CH: how many members of each key are new or get another score."""
    new = add(log).withColumnRenamed("score", "new")
    joined = new.join(state, ["key", "member"], "left")
    return joined.where(F.col("score").isNull() | (F.col("score") != F.col("new"))).groupBy("key").agg(F.count("*").alias("n_changed"))


def remove(state: DataFrame, requests: DataFrame) -> DataFrame:
    """ZREM: what is left."""
    return state.join(requests.select("key", "member"), ["key", "member"], "left_anti")


def removed(state: DataFrame, requests: DataFrame) -> DataFrame:
    """ZREM's reply: how many members each key loses."""
    return state.join(requests.select("key", "member"), ["key", "member"], "left_semi").groupBy("key").agg(F.count("*").alias("n_removed"))


def score(requests: DataFrame, state: DataFrame) -> DataFrame:
    """ZSCORE: requests with the score or null."""
    return requests.join(state, ["key", "member"], "left")


def cardinality(state: DataFrame) -> DataFrame:
    """ZCARD of every set."""
    return state.groupBy("key").agg(F.count("*").alias("n_members"))


def rank(state: DataFrame) -> DataFrame:
    """ZRANK of every member, from 0."""
    return numbered(state.select("key", "member", "score"), uneven_slices(state, "score"), ["score", "member"], "rank").select("key", "member", "rank")


def by_rank(state: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """ZRANGE of every set: (key, rank, member, score), negative ranks from the end.

    With both ends from the front the predicate stands on the window's own column, so Spark
    keeps only the first rows of each group before it shuffles and sorts. With both from the
    end the order is turned round, which comes to the same.
    """
    if start < 0 and stop < 0:
        back = by_rank(state, -1 - stop, -1 - start, not reverse) if start <= stop else state.where(F.lit(False)).select("key", F.lit(0).cast("bigint").alias("rank"), "member", "score")
        return back.join(cardinality(state), "key").select("key", (F.col("n_members") - 1 - F.col("rank")).alias("rank"), "member", "score")
    if start >= 0 and stop >= 0:
        order = [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]
        placed = state.withColumn("rn", F.row_number().over(_by_key().orderBy(*order)))
        found = placed.where(F.col("rn") <= stop + 1).where(F.col("rn") > start)
        return found.select("key", (F.col("rn") - 1).cast("bigint").alias("rank"), "member", "score")
    # one end from each side: a large set is numbered in slices, by many tasks
    rows = state.select("key", "member", "score")
    placed = numbered(rows, uneven_slices(rows, "score"), ["score", "member"], "rank").join(cardinality(state), "key")
    place = F.col("n_members") - 1 - F.col("rank") if reverse else F.col("rank")
    first, last = slice_bounds(start, stop, F.col("n_members"))
    return placed.where((place >= first) & (place <= last)).select("key", place.alias("rank"), "member", "score")


def _bound(text: str) -> tuple[float, bool]:
    """A score bound and whether it is excluded; ``(`` before it excludes it."""
    return (float(text[1:]), True) if text.startswith("(") else (float(text), False)


def by_score(state: DataFrame, low: str, high: str, offset: int = 0, count: int = -1) -> DataFrame:
    """ZRANGEBYSCORE of every set; the bounds reach the scan. LIMIT by offset and count."""
    (a, a_out), (b, b_out) = _bound(low), _bound(high)
    s = F.col("score")
    found = state.where(((s > a) if a_out else (s >= a)) & ((s < b) if b_out else (s <= b)))
    if offset <= 0 and count < 0:
        return found.select("key", "member", "score")
    found = found.withColumn("rn", F.row_number().over(_by_key().orderBy("score", "member")))
    if count >= 0:
        found = found.where(F.col("rn") <= max(offset, 0) + count)
    return found.where(F.col("rn") > max(offset, 0)).select("key", "member", "score")
