"""State tables of all types from a log of framed commands.

A log is (seq, argv) and holds commands that took effect, as a store writes them. Each command becomes
rows (n, key, kind, op, item, value), where ``n`` is its place and the word's; what stands before a key's last
DEL, or the last FLUSH, goes. Items of strings, hashes, sets and scored sets fold alike: the last write after the
last removal, and what was added since, in two grouped aggregates. Lists fold by ``fold.replay_lists``.

Left out are deadlines relative to the time of a command, which a log doesn't hold, and LSET, GETRANGE and other
commands that aren't in ``operations``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.keys import parse_double, parse_int
from keyloom.operators import sketches
from keyloom.plans import fold

#: Words of one command, at most.
WORDS = 1 << 20
_SCHEMA = "array<struct<at:int,key:string,kind:string,op:string,item:string,value:string>>"


def operations(commands: DataFrame) -> DataFrame:
    """(n, key, kind, op, item, value) of commands (seq, argv): a row for each pair, member or element.

    op: set, add, remove; push and pop by side for lists; del and flush. Commands with too few words are left out.
    """
    argv = F.transform("argv", lambda w: w.cast("string"))
    named = commands.select("seq", argv.alias("w"), F.lower(F.element_at(argv, 1)).alias("name"), F.size("argv").alias("size"))
    w, name, size = F.col("w"), F.col("name"), F.col("size")
    key = F.get(w, F.lit(1))
    row = lambda kind, op, item, value=None, at=None, k=None: F.struct(
        (F.lit(0) if at is None else at).cast("int").alias("at"), (key if k is None else k).alias("key"), F.lit(kind).alias("kind"), F.lit(op).alias("op"),
        item.alias("item"), (F.lit(None) if value is None else value).cast("string").alias("value"))
    word = lambda i: F.get(w, i if isinstance(i, Column) else F.lit(i))
    places = lambda first, step=1: F.when(size > first, F.sequence(F.lit(first), size - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    each = lambda first, kind, op: F.transform(places(first), lambda i: row(kind, op, word(i), at=i))
    pairs = lambda first, kind, item_first: F.transform(places(first, 2), lambda i: row(kind, "set", word(i if item_first else i + 1), word(i + 1 if item_first else i), at=i))
    none = F.lit("")
    one = lambda kind, op, item, value: F.array(row(kind, op, item, value))
    negative = F.regexp_replace(F.concat(F.lit("-"), word(2)), "^--", "")
    times = F.greatest(F.coalesce(parse_int(word(2)), F.when(size == 2, 1), F.lit(0)), F.lit(0)).cast("int")
    cases = [
        (name.isin("set", "setnx", "getset") & (size > 2), one("string", "set", none, word(2))), (name.isin("setex", "psetex") & (size > 3), one("string", "set", none, word(3))),
        ((name == "mset") & (size > 2), F.transform(places(1, 2), lambda i: row("string", "set", none, word(i + 1), at=i, k=word(i)))),
        (name.isin("incr", "decr") & (size == 2), one("string", "add", none, F.when(name == "incr", "1").otherwise("-1"))),
        (name.isin("incrby", "incrbyfloat") & (size > 2), one("string", "add", none, word(2))), ((name == "decrby") & (size > 2), one("string", "add", none, negative)),
        (name.isin("hset", "hmset") & (size > 3), pairs(2, "hash", True)), ((name == "hincrby") & (size > 3), one("hash", "add", word(2), word(3))), (name == "hdel", each(2, "hash", "remove")),
        (name == "sadd", each(2, "set", "set")), (name == "srem", each(2, "set", "remove")),
        ((name == "zadd") & (size > 3), pairs(2, "zset", False)), ((name == "zincrby") & (size > 3), one("zset", "add", word(3), word(2))), (name == "zrem", each(2, "zset", "remove")),
        (name.isin("lpush", "rpush"), F.transform(places(2), lambda i: F.struct(i.alias("at"), key.alias("key"), F.lit("list").alias("kind"), name.alias("op"), none.alias("item"), word(i).alias("value")))),
        (name.isin("lpop", "rpop"), F.transform(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")),
                                                lambda i: F.struct(i.alias("at"), key.alias("key"), F.lit("list").alias("kind"), name.alias("op"), none.alias("item"), F.lit(None).cast("string").alias("value")))),
        (name == "pfadd", each(2, "sketch", "set")),
        (name.isin("del", "unlink"), F.transform(places(1), lambda i: row("any", "del", none, at=i, k=word(i)))), (name.isin("flushall", "flushdb"), one("any", "flush", none, None)),
    ]
    rows = F.lit(None).cast(_SCHEMA)
    for test, made in reversed(cases):
        rows = F.when(test, made.cast(_SCHEMA)).otherwise(rows)
    return named.select("seq", F.inline(rows)).select((F.col("seq") * WORDS + F.col("at")).alias("n"), "key", "kind", "op", "item", "value")


def standing(ops: DataFrame) -> DataFrame:
    """The rows after the last FLUSH and their key's last DEL."""
    return fold.barrier(ops.withColumnRenamed("n", "seq")).withColumnRenamed("seq", "n")


def items(ops: DataFrame, kind: str) -> DataFrame:
    """(key, item, value, added) of what stands of a kind: the last write after the last removal, null if there is none, and what was added since."""
    rows = ops.where((F.col("kind") == kind) & F.col("op").isin("set", "add", "remove"))
    when = lambda op, c: F.when(F.col("op") == op, c)
    last = rows.groupBy("key", "item").agg(
        F.max(when("remove", F.col("n"))).alias("gone"), F.max(when("set", F.col("n"))).alias("at"), F.max_by("value", when("set", F.col("n"))).alias("value"), F.max("n").alias("end"))
    last = last.where(F.col("gone").isNull() | (F.col("end") > F.col("gone")))
    fresh = F.col("gone").isNull() | (F.col("at") > F.col("gone"))
    last = last.select("key", "item", F.when(fresh, F.col("value")).alias("value"), F.greatest("gone", "at").alias("since"))
    adds = rows.where("op = 'add'").join(last.select("key", "item", "since"), ["key", "item"]).where(F.col("since").isNull() | (F.col("n") > F.col("since")))
    sums = adds.groupBy("key", "item").agg(F.sum(parse_double(F.col("value"))).alias("added"), F.sum(parse_int(F.col("value"))).alias("whole"))
    return last.join(sums, ["key", "item"], "left").select("key", "item", "value", "added", "whole")


def replay(commands: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """The state tables strings, hashes, sets, zsets, lists and sketches of commands (seq, argv).

    ``path``: a fresh folder that executors share; the log is parsed once and the rows of its commands are written
    there, then those that stand, by kind, so that each table reads its own. Without it every table parses the log again.
    """
    ops = operations(commands)
    if path is not None:
        ops.write.parquet(f"{path}/all")
        ops = standing(commands.sparkSession.read.schema(ops.schema).parquet(f"{path}/all"))
        ops.write.partitionBy("kind").parquet(f"{path}/standing")
        ops = commands.sparkSession.read.schema(ops.schema).parquet(f"{path}/standing")
    else:
        ops = standing(ops)
    text = F.when(F.col("whole").isNull(), F.col("value")).otherwise((F.coalesce(parse_int(F.col("value")), F.lit(0)) + F.col("whole")).cast("string"))
    score = F.coalesce(parse_double(F.col("value")), F.lit(0.0)) + F.coalesce("added", F.lit(0.0))
    lists = ops.where("kind = 'list'").select("key", "op", F.col("value").alias("arg"), F.col("n").alias("seq"))
    return {
        "strings": items(ops, "string").select("key", text.alias("value")),
        "hashes": items(ops, "hash").select("key", F.col("item").alias("field"), text.alias("value")),
        "sets": items(ops, "set").select("key", F.col("item").alias("member")),
        "zsets": items(ops, "zset").select("key", F.col("item").alias("member"), score.alias("score")),
        "lists": fold.replay_lists(lists),
        "sketches": sketches.add(ops.where("kind = 'sketch'").select("key", F.col("item").alias("element"))),
    }
