"""The table of commands that the engine answers, and how keys stand in their arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, number of words (negative: at least), group, whether it writes, first, last and step of keys.
COMMANDS = (
    ("get", 2, "string", False, 1, 1, 1), ("set", -3, "string", True, 1, 1, 1), ("setnx", 3, "string", True, 1, 1, 1),
    ("setex", 4, "string", True, 1, 1, 1), ("psetex", 4, "string", True, 1, 1, 1), ("getset", 3, "string", True, 1, 1, 1),
    ("append", 3, "string", True, 1, 1, 1), ("strlen", 2, "string", False, 1, 1, 1), ("incr", 2, "string", True, 1, 1, 1),
    ("decr", 2, "string", True, 1, 1, 1), ("incrby", 3, "string", True, 1, 1, 1), ("decrby", 3, "string", True, 1, 1, 1),
    ("incrbyfloat", 3, "string", True, 1, 1, 1), ("mget", -2, "string", False, 1, -1, 1), ("mset", -3, "string", True, 1, -1, 2),
    ("getrange", 4, "string", False, 1, 1, 1), ("setrange", 4, "string", True, 1, 1, 1),
    ("del", -2, "generic", True, 1, -1, 1), ("unlink", -2, "generic", True, 1, -1, 1), ("exists", -2, "generic", False, 1, -1, 1),
    ("touch", -2, "generic", False, 1, -1, 1), ("expire", 3, "generic", True, 1, 1, 1), ("pexpire", 3, "generic", True, 1, 1, 1),
    ("expireat", 3, "generic", True, 1, 1, 1), ("ttl", 2, "generic", False, 1, 1, 1), ("pttl", 2, "generic", False, 1, 1, 1),
    ("persist", 2, "generic", True, 1, 1, 1), ("type", 2, "generic", False, 1, 1, 1), ("keys", 2, "generic", False, 0, 0, 0),
    ("scan", -2, "generic", False, 0, 0, 0), ("rename", 3, "generic", True, 1, 2, 1), ("randomkey", 1, "generic", False, 0, 0, 0),
    ("object", -2, "generic", False, 2, 2, 1),
    ("hset", -4, "hash", True, 1, 1, 1), ("hmset", -4, "hash", True, 1, 1, 1), ("hget", 3, "hash", False, 1, 1, 1),
    ("hdel", -3, "hash", True, 1, 1, 1), ("hexists", 3, "hash", False, 1, 1, 1), ("hgetall", 2, "hash", False, 1, 1, 1),
    ("hkeys", 2, "hash", False, 1, 1, 1), ("hvals", 2, "hash", False, 1, 1, 1), ("hlen", 2, "hash", False, 1, 1, 1),
    ("hincrby", 4, "hash", True, 1, 1, 1), ("hmget", -3, "hash", False, 1, 1, 1),
    ("lpush", -3, "list", True, 1, 1, 1), ("rpush", -3, "list", True, 1, 1, 1), ("lpop", -2, "list", True, 1, 1, 1),
    ("rpop", -2, "list", True, 1, 1, 1), ("llen", 2, "list", False, 1, 1, 1), ("lrange", 4, "list", False, 1, 1, 1),
    ("lindex", 3, "list", False, 1, 1, 1), ("lset", 4, "list", True, 1, 1, 1),
    ("sadd", -3, "set", True, 1, 1, 1), ("srem", -3, "set", True, 1, 1, 1), ("sismember", 3, "set", False, 1, 1, 1),
    ("scard", 2, "set", False, 1, 1, 1), ("smembers", 2, "set", False, 1, 1, 1), ("spop", -2, "set", True, 1, 1, 1),
    ("zadd", -4, "zset", True, 1, 1, 1), ("zrem", -3, "zset", True, 1, 1, 1), ("zscore", 3, "zset", False, 1, 1, 1),
    ("zcard", 2, "zset", False, 1, 1, 1), ("zrank", 3, "zset", False, 1, 1, 1), ("zrange", -4, "zset", False, 1, 1, 1),
    ("zrangebyscore", -4, "zset", False, 1, 1, 1), ("zincrby", 4, "zset", True, 1, 1, 1),
    ("pfadd", -2, "sketch", True, 1, 1, 1), ("pfcount", -2, "sketch", False, 1, -1, 1), ("pfmerge", -2, "sketch", True, 1, -1, 1),
    ("vadd", -4, "vector", True, 1, 1, 1), ("vsim", -4, "vector", False, 1, 1, 1), ("vcard", 2, "vector", False, 1, 1, 1),
    ("vrem", 3, "vector", True, 1, 1, 1),
    ("command", -1, "server", False, 0, 0, 0), ("info", -1, "server", False, 0, 0, 0), ("dbsize", 1, "server", False, 0, 0, 0),
    ("flushall", -1, "server", True, 0, 0, 0), ("flushdb", -1, "server", True, 0, 0, 0),
)


def table(spark: SparkSession) -> DataFrame:
    """COMMAND: (name, arity, kind, writes, first, last, step)."""
    return spark.createDataFrame(COMMANDS, "name string, arity int, kind string, writes boolean, first int, last int, step int")


def keys_in(argv: Column, first: Column, last: Column, step: Column) -> Column:
    """The keys among a command's words; ``last`` counts from the end if negative."""
    stop = F.when(last < 0, F.size(argv) + last).otherwise(last)
    return F.when((first > 0) & (stop >= first), F.transform(F.sequence(first, stop, F.greatest(step, F.lit(1))), lambda i: argv[i])).otherwise(F.array().cast("array<string>"))


def checked(log: DataFrame, commands: DataFrame) -> DataFrame:
    """(seq, argv) with ``name``, ``keys`` and ``error`` (unknown command, wrong arity or null)."""
    named = log.withColumn("name", F.lower(F.col("argv")[0])).join(F.broadcast(commands), "name", "left")
    n = F.size("argv")
    wrong = F.when(F.col("arity") >= 0, n != F.col("arity")).otherwise(n < -F.col("arity")) | ((F.col("name") == "mset") & (n % 2 == 0))
    error = F.when(F.col("arity").isNull(), "unknown command").when(wrong, "wrong number of arguments")
    keys = F.when(error.isNull(), keys_in(F.col("argv"), F.col("first"), F.col("last"), F.col("step")))
    return named.select("seq", "argv", "name", keys.alias("keys"), error.alias("error"))
