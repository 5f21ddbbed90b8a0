"""Keyspace operators: existence, deletion, expiry, types, scans and renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.keys import WHOLE_NUMBER, glob, live

TYPES = ("string", "list", "hash", "set", "zset")
#: What OBJECT ENCODING says of each type but strings.
ENCODINGS = {"list": "quicklist", "hash": "hashtable", "set": "hashtable", "zset": "skiplist"}


def exists(requests: DataFrame, state: DataFrame, now_ms: int) -> DataFrame:
    """EXISTS and TOUCH: the requests that name a live key, repeated ones as often."""
    return requests.join(live(state, now_ms).select("key"), "key", "left_semi")


def delete(state: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """DEL and UNLINK: the live state without the requested keys."""
    return live(state, now_ms).join(requests.select("key"), "key", "left_anti")


def deleted(state: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """The live rows that DEL and UNLINK remove."""
    return live(state, now_ms).join(requests.select("key"), "key", "left_semi")


def _folded(requests: DataFrame, deadline: Column, now_ms: int) -> DataFrame:
    """(key, asked, killed): the last deadline asked for each key, and the first request that leaves it dead.

    ``killed`` is that request's seq; as later ones find no key, the deadline is ``now_ms`` then.
    """
    dead = deadline <= now_ms
    folded = requests.groupBy("key").agg(F.max_by(deadline, F.col("seq")).alias("last"), F.min(F.when(dead, F.col("seq"))).alias("killed"))
    return folded.select("key", F.when(F.col("killed").isNull(), F.col("last")).otherwise(F.lit(now_ms)).alias("asked"), "killed")


def _relative(now_ms: int) -> Column:
    return F.lit(now_ms) + F.greatest(F.col("ttl_ms"), F.lit(0))


def _absolute() -> Column:
    return F.greatest(F.col("at_s"), F.lit(0)) * 1000


def _with_deadlines(state: DataFrame, folded: DataFrame, now_ms: int) -> DataFrame:
    joined = live(state, now_ms).join(folded.select("key", "asked"), "key", "left")
    return joined.withColumn("deadline_ms", F.coalesce("asked", "deadline_ms")).drop("asked")


def expire(state: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """EXPIRE, PEXPIRE: the live state with the last deadline asked; requests have (seq, key, ttl_ms).

    A time of 0 or less ends a key at once: its row keeps the deadline ``now_ms``, dead to every reader.
    """
    return _with_deadlines(state, _folded(requests, _relative(now_ms), now_ms), now_ms)


def expire_at(state: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """EXPIREAT: as ``expire`` with absolute times; requests have (seq, key, at_s)."""
    return _with_deadlines(state, _folded(requests, _absolute(), now_ms), now_ms)


def expire_replies(state: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """EXPIRE's replies: requests (seq, key, ttl_ms) with ``reply``, 1 if they found a live key."""
    folded = _folded(requests, _relative(now_ms), now_ms).select("key", "killed")
    held = live(state, now_ms).select("key", F.lit(True).alias("held"))
    found = F.coalesce("held", F.lit(False)) & (F.col("killed").isNull() | (F.col("seq") <= F.col("killed")))
    return requests.join(held, "key", "left").join(folded, "key", "left").withColumn("reply", found.cast("int")).drop("held", "killed")


def persist(state: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """PERSIST: live state, requested keys without deadline; ``persisted`` if one had any."""
    asked = requests.select("key").distinct().withColumn("asked", F.lit(True))
    joined = live(state, now_ms).join(asked, "key", "left")
    had = F.coalesce("asked", F.lit(False)) & F.col("deadline_ms").isNotNull()
    return joined.select("key", "value", F.when(~had, F.col("deadline_ms")).alias("deadline_ms"), had.alias("persisted"))


def ttl(requests: DataFrame, state: DataFrame, now_ms: int) -> DataFrame:
    """TTL and PTTL: -2 missing, -1 without deadline, else what is left (seconds rounded up)."""
    held = live(state, now_ms).select("key", "deadline_ms", F.lit(True).alias("held"))
    left = F.greatest(F.col("deadline_ms") - now_ms, F.lit(0))
    none = F.when(F.col("held").isNull(), F.lit(-2)).when(F.col("deadline_ms").isNull(), F.lit(-1))
    return requests.join(held, "key", "left").withColumns({
        "ttl_s": none.otherwise(F.floor((left + 999) / 1000)).cast("bigint"), "ttl_ms": none.otherwise(left).cast("bigint")}).drop("deadline_ms", "held")


def keys_of(now_ms: int, **tables: DataFrame) -> DataFrame:
    """(key, type) of the live keys of state tables by type; each key once."""
    out = None
    for kind, df in tables.items():
        held = live(df, now_ms) if "deadline_ms" in df.columns else df
        one = held.select("key").distinct().withColumn("type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def wrong_type(requests: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """Requests with ``error``: WRONGTYPE where their key is live with another type than ``kind``, else null."""
    held = keys.select("key", F.col("type").alias("held"))
    error = F.when(F.col("held") != kind, F.lit("WRONGTYPE Operation against a key holding the wrong kind of value"))
    return requests.join(held, "key", "left").withColumn("error", error).drop("held")


def type_of(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """TYPE: the type of each requested key, none for a missing one."""
    return requests.join(keys, "key", "left").withColumn("type", F.coalesce("type", F.lit("none")))


def scan(keys: DataFrame, match: str = "*", kind: str | None = None) -> DataFrame:
    """KEYS and SCAN: keys that match a pattern and, if given, a type."""
    if kind is not None and kind not in TYPES:
        raise ValueError(f"unknown type {kind}")
    found = keys.where(glob(F.col("key"), match))
    return found if kind is None else found.where(F.col("type") == kind)


def page(keys: DataFrame, after: str | None, count: int) -> DataFrame:
    """A page of a scan in key order: ``count`` keys after a given one."""
    return (keys if after is None else keys.where(F.col("key") > after)).orderBy("key").limit(count)


def random_key(keys: DataFrame) -> DataFrame:
    """RANDOMKEY: one key, the same each time: that of the smallest hash."""
    return keys.orderBy(F.md5("key"), "key").limit(1)


def rename(state: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """RENAME in bulk over the live state; requests have (seq, key, new).

    All of them see the state as it was. The first request moves a key, later ones find it gone.
    What stood at a target goes; of several keys with one target the last request's stays.
    """
    first = requests.groupBy("key").agg(F.min_by("new", "seq").alias("new"), F.min("seq").alias("seq"))
    rows = live(state, now_ms)
    others = [c for c in state.columns if c != "key"]
    moved = rows.join(first, "key").groupBy("new").agg(F.max_by(F.struct(*others), F.col("seq")).alias("row"))
    moved = moved.select(F.col("new").alias("key"), *[F.col("row")[c].alias(c) for c in others])
    rest = rows.join(first.select("key"), "key", "left_anti").join(moved.select("key"), "key", "left_anti")
    return rest.select("key", *others).unionByName(moved)


def rename_replies(state: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """RENAME's replies: requests (seq, key, new) with ``error``, null where a live key was moved."""
    first = requests.groupBy("key").agg(F.min("seq").alias("first"))
    held = live(state, now_ms).select("key", F.lit(True).alias("held"))
    error = F.when(F.col("held").isNull() | (F.col("seq") > F.col("first")), F.lit("no such key"))
    return requests.join(held, "key", "left").join(first, "key", "left").withColumn("error", error).drop("held", "first")


def encoding(kind: Column, value: Column) -> Column:
    """OBJECT ENCODING: int for whole-number strings, embstr for others, else by type."""
    out = F.when(kind == "string", F.when(value.rlike(WHOLE_NUMBER) & value.try_cast("bigint").isNotNull(), "int").otherwise("embstr"))
    for name, text in ENCODINGS.items():
        out = out.when(kind == name, F.lit(text))
    return out


def object_info(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """OBJECT REFCOUNT, IDLETIME and FREQ: 1, 0 and 0 of a live key, null of a missing one."""
    held = keys.select("key", F.lit(1).alias("refcount"), F.lit(0).alias("idletime"), F.lit(0).alias("freq"))
    return requests.join(held, "key", "left")


def memory_usage(now_ms: int, **tables: DataFrame) -> DataFrame:
    """(type, keys, bytes) of the live keys of state tables by type: 48 bytes a key, the bytes of its texts, 8 a number."""
    out = None
    for kind, df in tables.items():
        rows = live(df, now_ms) if "deadline_ms" in df.columns else df
        parts = [f.name for f in rows.schema.fields if f.name not in ("key", "deadline_ms")]
        sizes = [F.octet_length(c) if rows.schema[c].dataType.simpleString() == "string" else F.lit(8) for c in parts]
        by_key = rows.groupBy("key").agg(F.sum(sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(0))).alias("n"))
        one = by_key.agg(F.count("*").alias("keys"), F.coalesce(F.sum(F.col("n") + F.octet_length("key") + 48), F.lit(0)).cast("bigint").alias("bytes"))
        one = one.select(F.lit(kind).alias("type"), "keys", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def active_expire(state: DataFrame, now_ms: int, budget: int | None = None) -> DataFrame:
    """Keys whose deadline has passed; at most ``budget`` of them, the earliest first."""
    dead = state.where(F.col("deadline_ms") <= now_ms).select("key", "deadline_ms")
    return dead if budget is None else dead.orderBy("deadline_ms", "key").limit(budget)
