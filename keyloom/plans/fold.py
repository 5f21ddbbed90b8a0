"""State from an ordered log: snapshot and log to state.

A log row is (seq, ts_ms, key, op, arg). Commutative and last-writer operations are grouped
aggregates (``fold_counters``); lists after mixed pushes and pops are running sums within slices
of a key (``replay_lists``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import ordered
from keyloom.functions.keys import parse_int


def barrier(log: DataFrame) -> DataFrame:
    """The rows after the last FLUSH of the log and the last DEL of their key."""
    flush = log.agg(F.max(F.when(F.col("op") == "flush", F.col("seq"))).alias("flushed"))
    cut = log.where("op = 'del'").groupBy("key").agg(F.max("seq").alias("deleted"))
    kept = log.where("op not in ('flush', 'del')").join(F.broadcast(flush)).where(F.col("flushed").isNull() | (F.col("seq") > F.col("flushed")))
    return kept.join(cut, "key", "left").where(F.col("deleted").isNull() | (F.col("seq") > F.col("deleted"))).drop("flushed", "deleted")


def fold_counters(log: DataFrame) -> DataFrame:
    """(key, value, max_seq) of SET and INCRBY rows: the last SET plus what came after it.

    One aggregate for the last SET by key and one for the sums; partial sums meet by key, so
    a hot key costs a row from each task.
    """
    sets = log.where("op = 'set'").groupBy("key").agg(F.max_by(F.struct("seq", "arg"), F.col("seq")).alias("s"))
    base = sets.select("key", F.col("s.seq").alias("set_seq"), F.col("s.arg").alias("base"))
    joined = log.join(base, "key", "left")
    delta = F.when((F.col("op") == "incrby") & (F.col("set_seq").isNull() | (F.col("seq") > F.col("set_seq"))), F.col("arg")).otherwise(F.lit(0))
    return joined.groupBy("key").agg((F.coalesce(F.max("base"), F.lit(0)) + F.sum(delta)).cast("bigint").alias("value"), F.max("seq").alias("max_seq"))


def fold_log(log: DataFrame) -> DataFrame:
    """``fold_counters`` of what stands after the last FLUSH and each key's last DEL."""
    return fold_counters(barrier(log))


def snapshot_and_log(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """``fold_log`` over a snapshot (key, value, max_seq) and the rows that are newer than it.

    Rows that the snapshot already holds are left out, so nothing is applied twice; a DEL or FLUSH
    after it takes its keys too. A FLUSH counts for every key.
    """
    mark = snapshot.select("key", F.col("max_seq").alias("held"))
    tail = log.join(mark, "key", "left").where((F.col("op") == "flush") | F.col("held").isNull() | (F.col("seq") > F.col("held")))
    base = snapshot.select(F.col("max_seq").alias("seq"), "key", F.lit("set").alias("op"), F.col("value").alias("arg"))
    return fold_log(base.unionByName(tail.select("seq", "key", "op", F.col("arg").cast("bigint").alias("arg"))))


def commands_to_log(commands: DataFrame) -> DataFrame:
    """(seq, key, op, arg) of framed commands (seq, argv): SET, INCR, INCRBY, DECR, DECRBY, DEL, UNLINK and FLUSH.

    Other commands, those with a wrong number of words and amounts that aren't whole numbers are left out.
    """
    word = lambda i: F.try_element_at(F.col("argv"), F.lit(i + 1)).cast("string")
    name, n = F.lower(word(0)), F.size("argv")
    one = F.when(name == "incr", F.lit("1")).when(name == "decr", F.lit("-1")).when(name == "decrby", F.concat(F.lit("-"), word(2))).otherwise(word(2))
    amount = parse_int(F.regexp_replace(one, "^--", ""))
    op = (F.when((name == "set") & (n == 3), "set").when(name.isin("incrby", "decrby") & (n == 3), "incrby").when(name.isin("incr", "decr") & (n == 2), "incrby")
          .when(name.isin("flushall", "flushdb"), "flush").when(name.isin("del", "unlink") & (n > 1), "del"))
    keys = F.when(op == "del", F.slice("argv", 2, F.greatest(n - 1, F.lit(1)))).when(op == "flush", F.array(F.lit(None).cast("binary"))).otherwise(F.slice("argv", 2, 1))
    each = commands.select("seq", op.alias("op"), amount.alias("arg"), F.explode(keys).alias("key")).where("op is not null")
    return each.where("op in ('del', 'flush') or arg is not null").select("seq", F.col("key").cast("string").alias("key"), "op", "arg")


def replay_lists(log: DataFrame) -> DataFrame:
    """Lists (key, pos, value) after mixed pushes and pops in the order of seq.

    No key is held by one task. A list's size is the prefix sum of pushes and pops minus its running
    minimum, which tells the pops that meet a value. Running sums of pushes and such pops are the places
    of both ends; the last push to each place between the final ends is the list. All of it is done
    in slices of a key along seq, joined with one row a slice. Rows without a key are left out.
    """
    rows = log.select("key", "op", "arg", "seq").where("key is not null and op in ('rpush', 'lpush', 'rpop', 'lpop', 'del')")
    part = ordered.even_slices(rows, "seq")
    cut = rows.withColumn("slice", F.lit(0) if part is None else part)
    in_order = Window.partitionBy("key", "slice").orderBy("seq", "op", "arg")
    own = in_order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    step = F.when(F.col("op").isin("rpush", "lpush"), 1).otherwise(-1)

    # what stands after the key's last DEL
    deleted = cut.groupBy("key", "slice").agg(F.max(F.when(F.col("op") == "del", F.col("seq"))).alias("n")).select("key", "slice", F.max("n").over(whole).alias("deleted"))
    live = cut.join(deleted, ["key", "slice"]).where(F.col("deleted").isNull() | (F.col("seq") > F.col("deleted"))).drop("deleted")

    # pops that meet a value: those that make no new minimum of the prefix sums
    placed = live.withColumn("sum", F.sum(step).over(own)).withColumn("least", F.min("sum").over(earlier))
    slices = placed.groupBy("key", "slice").agg(F.sum(step).alias("n"), F.min("sum").alias("low"))
    slices = slices.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    slices = slices.select("key", "slice", "base", F.least(F.lit(0), F.min(F.col("base") + F.col("low")).over(before)).alias("floor"))
    met = F.col("base") + F.col("sum") >= F.least("floor", F.col("base") + F.col("least"))
    right = F.when(F.col("op") == "rpush", 1).when((F.col("op") == "rpop") & met, -1).otherwise(0)
    left = F.when(F.col("op") == "lpush", -1).when((F.col("op") == "lpop") & met, 1).otherwise(0)
    moved = placed.join(slices, ["key", "slice"]).select("key", "slice", "seq", "op", "arg", right.alias("right"), left.alias("left"))

    # both ends after each row, and the last push to each place that is left
    ends = moved.groupBy("key", "slice").agg(F.sum("right").alias("r"), F.sum("left").alias("l"))
    ends = ends.select("key", "slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "rl"], *[F.sum(c).over(whole).alias(f"{c}_end") for c in "rl"])
    now = moved.withColumn("r", F.sum("right").over(own)).withColumn("l", F.sum("left").over(own)).where("op in ('rpush', 'lpush')").join(ends, ["key", "slice"])
    place = F.when(F.col("op") == "rpush", F.col("r_before") + F.col("r") - 1).otherwise(F.col("l_before") + F.col("l"))
    there = now.withColumn("place", place).where("place >= l_end and place < r_end")
    return there.groupBy("key", (F.col("place") - F.col("l_end")).alias("pos")).agg(F.max_by("arg", F.struct("seq", "op", "arg")).alias("value"))
