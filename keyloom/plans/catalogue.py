"""The registered queries over the state tables, each with its SQL for DuckDB.

Every query asks its question of whole tables. ``{strings}`` and the like in the SQL stand for
the state tables of ``sources.state``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.keys import live, parse_double, parse_int, shard_of
from keyloom.operators import commands, generic, hashes, lists, metrics, sets, sketches, strings, vectors, zsets
from keyloom.plans import fold, replay
from keyloom.sources import oplog, state
from keyloom.sources.scratch import scratch
from keyloom.sources.state import NOW_MS, table
from keyloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql
            for name, own in state.SQL.items():
                text = text.replace("{" + name + "}", f"({own})")
            ORACLE_SQL[f.__name__] = text.replace("{now}", str(NOW_MS)).replace("{live}", f"(SELECT * FROM ({state.SQL['strings']}) WHERE deadline_ms IS NULL OR deadline_ms > {NOW_MS})")
        return f

    return register


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Requests: the customer of each order, and customers that don't exist."""
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("customer:"), F.col("o_custkey") * 2 - 50).alias("key"))


_ORDERS = "(SELECT o_orderkey, 'customer:' || (o_custkey * 2 - 50) AS key FROM orders)"


def _keys(spark, d):
    """The live keys of all types."""
    return generic.keys_of(NOW_MS, string=state.strings(spark, d), hash=state.hashes(spark, d), list=state.lists(spark, d), set=state.sets(spark, d), zset=state.zsets(spark, d))


_KEYS = "(" + " UNION ALL ".join(f"SELECT DISTINCT key, '{t}' AS type FROM {{{n}}}" for t, n in (("string", "live"), ("hash", "hashes"), ("list", "lists"), ("set", "sets"), ("zset", "zsets"))) + ")"


# ---- strings

@query(f"SELECT o_orderkey, r.key, s.value FROM {_ORDERS} r LEFT JOIN {{live}} s USING (key)")
def get_point(spark, d):
    return strings.get(_orders(spark, d), state.strings(spark, d), NOW_MS).select("o_orderkey", "key", "value")


@query("""SELECT o_custkey * 100 + pos AS slot, 'customer:' || (o_custkey + pos * 700) AS key, s.value
FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT unnest([0, 1, 2]) AS pos) LEFT JOIN {live} s ON s.key = 'customer:' || (o_custkey + pos * 700)""")
def mget_ordered(spark, d):
    asked = table(spark, d, "orders").select("o_custkey").distinct().select("o_custkey", F.posexplode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.concat(F.lit("customer:"), F.col("o_custkey") + i * 700))).alias("pos", "key"))
    return strings.get(asked, state.strings(spark, d), NOW_MS).select((F.col("o_custkey") * 100 + F.col("pos")).alias("slot"), "key", "value")


@query(f"SELECT count(*)::BIGINT AS n FROM {_ORDERS} r WHERE r.key IN (SELECT key FROM {{live}})")
def exists_count(spark, d):
    return generic.exists(_orders(spark, d), state.strings(spark, d), NOW_MS).agg(F.count("*").alias("n"))


@query("SELECT key, arg_max(props, seq) AS value FROM {log} GROUP BY key")
def set_lww(spark, d):
    return strings.set_last(state.events(spark, d).select("seq", "key", F.col("props").alias("value")))


_WRITES = "(SELECT seq, ts_ms, 'customer:' || (seq % 2000) AS key, props AS value FROM {log})"
#: Writes to keys that are strings, hashes, or not there.
_MIXED = "(SELECT seq, CASE seq % 3 WHEN 0 THEN 'user:' || (seq % 500) ELSE 'customer:' || (seq % 2000) END AS key, props AS value FROM {log})"


def _writes(spark, d):
    e = state.events(spark, d)
    return e.select("seq", "ts_ms", F.concat(F.lit("customer:"), F.col("seq") % 2000).alias("key"), F.col("props").alias("value"))


def _mixed(spark, d):
    seq = F.col("seq")
    key = F.when(seq % 3 == 0, F.concat(F.lit("user:"), seq % 500)).otherwise(F.concat(F.lit("customer:"), seq % 2000))
    return state.events(spark, d).select("seq", key.alias("key"), F.col("props").alias("value"))


@query(f"SELECT key, arg_min(value, seq) AS value FROM {_MIXED} WHERE key NOT IN (SELECT key FROM {_KEYS}) GROUP BY key")
def setnx_first(spark, d):
    return strings.set_absent(_mixed(spark, d), _keys(spark, d))


@query(f"SELECT key, arg_max(value, seq) AS value FROM {_MIXED} WHERE key IN (SELECT key FROM {_KEYS}) GROUP BY key")
def set_xx(spark, d):
    return strings.set_present(_mixed(spark, d), _keys(spark, d))


@query(f"""WITH w AS (SELECT seq, key, value, CASE seq % 5 WHEN 0 THEN 'nx' WHEN 1 THEN 'xx' END AS condition, seq % 4 = 0 AS keep,
  CASE WHEN seq % 7 = 0 THEN seq % 3 * 1000 END AS in_ms, CASE WHEN seq % 11 = 0 THEN {{now}} + seq END AS at_ms FROM {_WRITES}),
sound AS (SELECT *, coalesce(at_ms, {{now}} + in_ms) AS own FROM w WHERE coalesce(in_ms, 1) > 0 AND coalesce(at_ms, 1) > 0),
made AS (SELECT key, min(seq) FILTER (condition IS NULL OR condition <> 'xx') AS made FROM sound GROUP BY key),
done AS (SELECT sound.* FROM sound JOIN made USING (key) LEFT JOIN {{live}} s USING (key)
  WHERE CASE WHEN s.key IS NOT NULL THEN coalesce(condition, '') <> 'nx' ELSE seq = made OR (seq > made AND coalesce(condition, '') <> 'nx') END),
last AS (SELECT key, arg_max(value, seq) AS value, max(seq) FILTER (own IS NOT NULL OR NOT keep) AS reset FROM done GROUP BY key),
ended AS (SELECT last.*, d.own FROM last LEFT JOIN done d ON d.key = last.key AND d.seq = last.reset)
SELECT coalesce(s.key, e.key) AS key, coalesce(e.value, s.value) AS value, (CASE WHEN e.reset IS NOT NULL THEN e.own ELSE s.deadline_ms END)::BIGINT AS deadline_ms FROM {{live}} s FULL JOIN ended e ON s.key = e.key""")
def set_options(spark, d):
    seq = F.col("seq")
    log = _writes(spark, d).withColumns({
        "only": F.when(seq % 5 == 0, "nx").when(seq % 5 == 1, "xx"), "keep": seq % 4 == 0,
        "in_ms": F.when(seq % 7 == 0, seq % 3 * 1000), "at_ms": F.when(seq % 11 == 0, seq + NOW_MS)})
    return strings.set_with_options(log, state.strings(spark, d), NOW_MS)


@query(f"SELECT key, arg_max(value, seq) AS value, (arg_max(ts_ms, seq) + 90000)::BIGINT AS deadline_ms FROM {_WRITES} GROUP BY key")
def setex_deadline(spark, d):
    return strings.set_expiring(_writes(spark, d), 90_000)


_KEEP = f"""SELECT coalesce(s.key, w.key) AS key, coalesce(w.value, s.value) AS value, {{deadline}} AS deadline_ms
FROM {{live}} s FULL JOIN (SELECT key, arg_max(value, seq) AS value FROM {_WRITES} GROUP BY key) w ON s.key = w.key"""


@query(f"SELECT key, arg_max(value, seq) AS value, (arg_max(ts_ms, seq) + 1500)::BIGINT AS deadline_ms FROM {_WRITES} GROUP BY key")
def psetex_deadline(spark, d):
    return strings.set_expiring(_writes(spark, d), 1_500)


@query("SELECT key, arg_max(value, seq) AS value FROM (SELECT seq, key || ':' || kind AS key, kind AS value FROM {log} UNION ALL SELECT seq, key || ':last', kind FROM {log}) GROUP BY key")
def mset_pairs(spark, d):
    e = state.events(spark, d)
    pair = lambda name, value: F.struct(F.concat("key", F.lit(":"), name).alias("key"), value.alias("value"))
    return strings.set_last(strings.set_many(e.select("seq", F.array(pair(F.col("kind"), F.col("kind")), pair(F.lit("last"), F.col("kind"))).alias("pairs"))))


@query(_KEEP.replace("{deadline}", "deadline_ms"))
def set_keepttl(spark, d):
    return strings.set_keeping_ttl(_writes(spark, d), state.strings(spark, d), True, NOW_MS)


@query(_KEEP.replace("{deadline}", "CASE WHEN w.value IS NULL THEN deadline_ms END"))
def set_clears_ttl(spark, d):
    return strings.set_keeping_ttl(_writes(spark, d), state.strings(spark, d), False, NOW_MS)


@query("SELECT seq, key, props AS value, lag(props) OVER (PARTITION BY key ORDER BY seq) AS previous FROM {log}")
def getset_prev(spark, d):
    return strings.get_set(state.events(spark, d).select("seq", "key", F.col("props").alias("value")))


@query("SELECT key, string_agg(kind, '' ORDER BY seq) AS value, strlen(string_agg(kind, '' ORDER BY seq))::BIGINT AS n_bytes FROM {log} GROUP BY key")
def append_concat(spark, d):
    return strings.append(state.events(spark, d).select("seq", "key", F.col("kind").alias("value")))


@query("SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents")
def strlen_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))


@query(f"SELECT o_orderkey, r.key, coalesce(strlen(s.value), 0)::BIGINT AS n_bytes FROM {_ORDERS} r LEFT JOIN {{live}} s USING (key)")
def strlen_lookup(spark, d):
    return strings.strlen(_orders(spark, d), state.strings(spark, d), NOW_MS).select("o_orderkey", "key", "n_bytes")


@query("SELECT p_partkey, substr(p_name, 3, 6) AS head, substr(p_name, greatest(length(p_name) - 4, 1)) AS tail FROM part")
def getrange_slice(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.byte_range(F.col("p_name"), 2, 7).cast("string").alias("head"), strings.byte_range(F.col("p_name"), -5, -1).cast("string").alias("tail"))


@query("""SELECT p_partkey, substr(p_name, 1, 2) || 'XYZ' || substr(p_name, 6) AS patched,
hex(encode(p_name)) || repeat('00', greatest(40 - length(p_name), 0)::INTEGER) || hex(encode('!')) AS padded FROM part""")
def setrange_patch(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", strings.set_range(name, 2, "XYZ").cast("string").alias("patched"), F.hex(strings.set_range(name, 40, "!")).alias("padded"))


@query("SELECT key, count(*)::BIGINT AS total FROM {log} GROUP BY key")
def incr_total(spark, d):
    return strings.increase(state.events(spark, d), F.lit(1))


@query("SELECT key, (-sum(seq % 7))::BIGINT AS total FROM {log} GROUP BY key")
def decrby_total(spark, d):
    return strings.increase(state.events(spark, d), -(F.col("seq") % 7))


@query("SELECT key, (-count(*))::BIGINT AS total FROM {log} GROUP BY key")
def decr_total(spark, d):
    return strings.increase(state.events(spark, d), F.lit(-1))


@query("SELECT key, sum(seq % 7)::BIGINT AS total FROM {log} GROUP BY key")
def incrby_total(spark, d):
    return strings.increase(state.events(spark, d), F.col("seq") % 7)


@query("SELECT seq, key, (sum(seq % 11) OVER (PARTITION BY key ORDER BY seq))::BIGINT AS running FROM {log}")
def incrby_running(spark, d):
    return strings.running(state.events(spark, d), F.col("seq") % 11).select("seq", "key", "running")


@query("SELECT key, round(sum(value), 4) AS total FROM {log} GROUP BY key")
def incrbyfloat_total(spark, d):
    return strings.increase(state.events(spark, d), F.col("value")).withColumn("total", F.round("total", 4))


@query("SELECT key, CASE WHEN abs(sum(seq::HUGEINT * 100000000000000)) <= 9223372036854775807 THEN sum(seq::HUGEINT * 100000000000000)::BIGINT END AS total FROM {log} GROUP BY key")
def incrby_overflow(spark, d):
    return strings.increase_checked(state.events(spark, d), F.col("seq").cast("decimal(19,0)") * F.lit(100_000_000_000_000))


@query("""SELECT event_id, CASE WHEN regexp_matches(t, '^-?[0-9]+$') THEN try_cast(t AS BIGINT) END AS as_int
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '+' ELSE '' END || event_id || CASE event_id % 3 WHEN 0 THEN ' ' ELSE '' END AS t FROM events)""")
def parse_integers(spark, d):
    i = F.col("event_id")
    text = F.concat(F.when(i % 4 == 0, "+").otherwise(""), i.cast("string"), F.when(i % 3 == 0, " ").otherwise(""))
    return table(spark, d, "events").select("event_id", parse_int(text).alias("as_int"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'infinity'::DOUBLE WHEN event_id % 5 = 1 THEN NULL ELSE value END AS as_double FROM events")
def parse_doubles(spark, d):
    i = F.col("event_id")
    text = F.when(i % 5 == 0, F.lit("+inf")).when(i % 5 == 1, F.lit(" 1.5")).otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", parse_double(text).alias("as_double"))


# ---- keyspace

@query(f"SELECT key, value FROM {{live}} WHERE key NOT IN (SELECT key FROM {_ORDERS})")
def del_antijoin(spark, d):
    return generic.delete(state.strings(spark, d), _orders(spark, d), NOW_MS).select("key", "value")


@query(f"SELECT count(*)::BIGINT AS n_removed FROM {{live}} WHERE key IN (SELECT key FROM {_ORDERS})")
def unlink_count(spark, d):
    return generic.deleted(state.strings(spark, d), _orders(spark, d), NOW_MS).agg(F.count("*").alias("n_removed"))


@query(f"SELECT o_orderkey, r.key FROM {_ORDERS} r WHERE r.key IN (SELECT key FROM {{live}})")
def touch(spark, d):
    return generic.exists(_orders(spark, d), state.strings(spark, d), NOW_MS).select("o_orderkey", "key")


_EXPIRES = "(SELECT o_orderkey AS seq, 'customer:' || o_custkey AS key, o_orderkey % 50000 - 500 AS ttl_ms FROM orders)"
_TTL = f"(SELECT key, CASE WHEN min(ttl_ms) <= 0 THEN 0 ELSE arg_max(ttl_ms, seq) END AS ttl_ms FROM {_EXPIRES} GROUP BY key)"
_NEW_TTL = "SELECT s.key, s.value, CASE WHEN t.ttl_ms IS NOT NULL THEN {{now}} + t.ttl_ms ELSE deadline_ms END::BIGINT AS deadline_ms FROM {{live}} s LEFT JOIN {ttl} t USING (key)"


def _expires(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("customer:"), "o_custkey").alias("key"), (F.col("o_orderkey") % 50_000 - 500).alias("ttl_ms"))


@query(_NEW_TTL.format(ttl=_TTL))
def pexpire(spark, d):
    return generic.expire(state.strings(spark, d), _expires(spark, d), NOW_MS)


@query(_NEW_TTL.format(ttl="(SELECT key, CASE WHEN min(ttl_ms) <= 0 THEN 0 ELSE arg_max(ttl_ms, seq) END AS ttl_ms FROM (SELECT o_orderkey AS seq, 'customer:' || o_custkey AS key, (o_orderkey % 997 - 3) * 1000 AS ttl_ms FROM orders) GROUP BY key)"))
def expire(spark, d):
    asked = _expires(spark, d).withColumn("ttl_ms", (F.col("seq") % 997 - 3) * 1000)
    return generic.expire(state.strings(spark, d), asked, NOW_MS)


@query(f"""SELECT r.seq, r.key, r.ttl_ms, (s.key IS NOT NULL AND (k.killed IS NULL OR r.seq <= k.killed))::INTEGER AS reply FROM {_EXPIRES} r LEFT JOIN {{live}} s USING (key)
LEFT JOIN (SELECT key, min(seq) FILTER (ttl_ms <= 0) AS killed FROM {_EXPIRES} GROUP BY key) k USING (key)""")
def expire_replies(spark, d):
    return generic.expire_replies(state.strings(spark, d), _expires(spark, d), NOW_MS)


@query("""SELECT s.key, s.value, coalesce(CASE WHEN t.low <= {now} THEN {now} ELSE t.last END, deadline_ms)::BIGINT AS deadline_ms FROM {live} s LEFT JOIN (
SELECT key, min(at_s * 1000) AS low, arg_max(at_s * 1000, seq) AS last FROM (SELECT o_orderkey AS seq, 'customer:' || o_custkey AS key, epoch_us(o_orderdate) // 1000000 + 900000000 AS at_s FROM orders) GROUP BY key) t USING (key)""")
def expireat(spark, d):
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 900_000_000
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("customer:"), "o_custkey").alias("key"), at.alias("at_s"))
    return generic.expire_at(state.strings(spark, d), asked, NOW_MS)


@query(f"""SELECT o_orderkey, r.key, CASE WHEN s.key IS NULL THEN -2 WHEN deadline_ms IS NULL THEN -1 ELSE (deadline_ms - {{now}} + 999) // 1000 END::BIGINT AS ttl_s,
CASE WHEN s.key IS NULL THEN -2 WHEN deadline_ms IS NULL THEN -1 ELSE deadline_ms - {{now}} END::BIGINT AS ttl_ms FROM {_ORDERS} r LEFT JOIN {{live}} s USING (key)""")
def expire_ttl(spark, d):
    return generic.ttl(_orders(spark, d), state.strings(spark, d), NOW_MS).select("o_orderkey", "key", "ttl_s", "ttl_ms")


@query(f"""SELECT o_orderkey, r.key, CASE WHEN s.key IS NULL THEN -2 WHEN deadline_ms IS NULL THEN -1 ELSE deadline_ms - {{now}} END::BIGINT AS ttl_ms FROM {_ORDERS} r LEFT JOIN {{live}} s USING (key)""")
def pttl(spark, d):
    return generic.ttl(_orders(spark, d), state.strings(spark, d), NOW_MS).select("o_orderkey", "key", "ttl_ms")


@query(f"""SELECT s.key, s.value, CASE WHEN a.key IS NULL THEN deadline_ms END AS deadline_ms, a.key IS NOT NULL AND deadline_ms IS NOT NULL AS persisted
FROM {{live}} s LEFT JOIN (SELECT DISTINCT key FROM {_ORDERS}) a USING (key)""")
def persist(spark, d):
    return generic.persist(state.strings(spark, d), _orders(spark, d), NOW_MS)


@query("SELECT key, value, deadline_ms FROM {live}")
def live_keys(spark, d):
    return live(state.strings(spark, d), NOW_MS)


@query("SELECT key, deadline_ms FROM {strings} WHERE deadline_ms <= {now}")
def expire_cycle(spark, d):
    return generic.active_expire(state.strings(spark, d), NOW_MS)


@query(f"SELECT type, count(*)::BIGINT AS n FROM {_KEYS} GROUP BY type")
def type_census(spark, d):
    return _keys(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, r.key, coalesce(k.type, 'none') AS type FROM {_ORDERS} r LEFT JOIN {_KEYS} k USING (key)")
def type_lookup(spark, d):
    return generic.type_of(_orders(spark, d), _keys(spark, d)).select("o_orderkey", "key", "type")


@query(f"SELECT key, CASE type WHEN 'string' THEN 'embstr' WHEN 'list' THEN 'quicklist' WHEN 'zset' THEN 'skiplist' ELSE 'hashtable' END AS encoding FROM {_KEYS}")
def object_encoding(spark, d):
    keyed = _keys(spark, d).join(live(state.strings(spark, d), NOW_MS).select("key", "value"), "key", "left")
    return keyed.select("key", generic.encoding(F.col("type"), F.col("value")).alias("encoding"))


_SIZES = {"string": ("live", "strlen(value)"), "hash": ("hashes", "strlen(field) + strlen(value)"), "list": ("lists", "8 + strlen(value)"), "set": ("sets", "strlen(member)"), "zset": ("zsets", "strlen(member) + 8")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS type, count(*)::BIGINT AS keys, sum(n + strlen(key) + 48)::BIGINT AS bytes FROM (SELECT key, sum({size}) AS n FROM {{{n}}} GROUP BY key)" for t, (n, size) in _SIZES.items()))
def memory_usage(spark, d):
    return generic.memory_usage(NOW_MS, string=state.strings(spark, d), hash=state.hashes(spark, d), list=state.lists(spark, d), set=state.sets(spark, d), zset=state.zsets(spark, d))


@query(f"SELECT count(*)::BIGINT AS n FROM {_KEYS}")
def dbsize(spark, d):
    return _keys(spark, d).agg(F.count("*").alias("n"))


@query(f"SELECT key FROM {_KEYS} WHERE regexp_matches(key, '^c[^a-t].*:1[0-5].?$')")
def keys_glob(spark, d):
    return generic.scan(_keys(spark, d), "c[^a-t]*:1[0-5]?").unionByName(generic.scan(_keys(spark, d), "c[!a-t]*:1[0-5]")).select("key")


@query(f"SELECT key, type FROM {_KEYS} WHERE key LIKE 'cust:1%' AND type = 'set'")
def scan_match_type(spark, d):
    return generic.scan(_keys(spark, d), "cust:1*", "set").select("key", "type")


@query(f"SELECT key, type FROM {_KEYS} WHERE key > 'cust' ORDER BY key LIMIT 20")
def scan_page(spark, d):
    return generic.page(_keys(spark, d), "cust", 20)


@query(f"SELECT key, type FROM {_KEYS} ORDER BY md5(key), key LIMIT 1")
def randomkey(spark, d):
    return generic.random_key(_keys(spark, d))


_RENAMES = "(SELECT o_orderkey AS seq, 'customer:' || (o_custkey + o_orderkey % 2 * 700) AS key, 'customer:' || (o_orderkey % 900 + 500) AS new FROM orders)"


def _renames(spark, d):
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda n: F.concat(F.lit("customer:"), n)
    return table(spark, d, "orders").select(order.alias("seq"), name(customer + order % 2 * 700).alias("key"), name(order % 900 + 500).alias("new"))


@query(f"""WITH first AS (SELECT key, arg_min(new, seq) AS new, min(seq) AS seq FROM {_RENAMES} GROUP BY key),
moved AS (SELECT new AS key, arg_max(value, seq) AS value, max(seq) AS seq FROM first JOIN {{live}} s USING (key) GROUP BY new)
SELECT m.key, m.value, s.deadline_ms FROM moved m JOIN first f ON f.seq = m.seq JOIN {{live}} s ON s.key = f.key
UNION ALL SELECT key, value, deadline_ms FROM {{live}} WHERE key NOT IN (SELECT key FROM first) AND key NOT IN (SELECT key FROM moved)""")
def rename(spark, d):
    return generic.rename(state.strings(spark, d), _renames(spark, d), NOW_MS)


@query(f"SELECT r.seq, r.key, r.new, CASE WHEN s.key IS NULL OR r.seq > min(r.seq) OVER (PARTITION BY r.key) THEN 'no such key' END AS error FROM {_RENAMES} r LEFT JOIN {{live}} s USING (key)")
def rename_replies(spark, d):
    return generic.rename_replies(state.strings(spark, d), _renames(spark, d), NOW_MS)


@query(f"SELECT o_orderkey, r.key, CASE WHEN k.key IS NOT NULL THEN 1 END::INTEGER AS refcount, CASE WHEN k.key IS NOT NULL THEN 0 END::INTEGER AS idletime, CASE WHEN k.key IS NOT NULL THEN 0 END::INTEGER AS freq FROM {_ORDERS} r LEFT JOIN {_KEYS} k USING (key)")
def object_info(spark, d):
    return generic.object_info(_orders(spark, d), _keys(spark, d)).select("o_orderkey", "key", "refcount", "idletime", "freq")


@query(f"SELECT r.seq, r.key, CASE WHEN k.type <> 'string' THEN 'WRONGTYPE Operation against a key holding the wrong kind of value' END AS error FROM {_MIXED} r LEFT JOIN {_KEYS} k USING (key)")
def wrong_type(spark, d):
    return generic.wrong_type(_mixed(spark, d).select("seq", "key"), _keys(spark, d), "string")


# ---- hashes

@query("SELECT key, field, value FROM {hashes}")
def hset_lww(spark, d):
    return hashes.set_fields(state.events(spark, d).select("seq", "key", F.col("kind").alias("field"), F.col("props").alias("value")))


_FIELDS = "(SELECT event_id, 'user:' || (user_id + event_id % 3) AS key, event_type AS field FROM events)"


def _fields(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(F.lit("user:"), F.col("user_id") + F.col("event_id") % 3).alias("key"), F.col("event_type").alias("field"))


@query(f"SELECT event_id, r.key, r.field, h.value FROM {_FIELDS} r LEFT JOIN {{hashes}} h USING (key, field)")
def hget(spark, d):
    return hashes.get_fields(_fields(spark, d), state.hashes(spark, d)).select("event_id", "key", "field", "value")


@query("""SELECT u.key, f.pos, f.field, h.value FROM (SELECT DISTINCT key FROM {hashes}) u, (SELECT unnest([0, 1, 2]) AS pos, unnest(['click', 'nope', 'view']) AS field) f
LEFT JOIN {hashes} h ON h.key = u.key AND h.field = f.field""")
def hmget(spark, d):
    h = state.hashes(spark, d)
    asked = h.select("key").distinct().select("key", F.posexplode(F.array(F.lit("click"), F.lit("nope"), F.lit("view"))).alias("pos", "field"))
    return hashes.get_fields(asked, h).select("key", "pos", "field", "value")


@query(f"SELECT event_id, r.key, r.field, h.key IS NOT NULL AS found FROM {_FIELDS} r LEFT JOIN {{hashes}} h USING (key, field)")
def hexists(spark, d):
    return hashes.has_field(_fields(spark, d), state.hashes(spark, d)).select("event_id", "key", "field", "found")


@query("SELECT key, list(field ORDER BY field) AS fields, list(value ORDER BY field) AS values, count(*)::BIGINT AS n_fields FROM {hashes} GROUP BY key")
def hgetall(spark, d):
    return hashes.get_all(state.hashes(spark, d))


@query("SELECT key, list(field ORDER BY field) AS fields FROM {hashes} GROUP BY key")
def hkeys(spark, d):
    return hashes.keys(state.hashes(spark, d))


@query("SELECT key, list(value ORDER BY field) AS values FROM {hashes} GROUP BY key")
def hvals(spark, d):
    return hashes.values(state.hashes(spark, d))


@query("SELECT key, count(*)::BIGINT AS n_fields FROM {hashes} GROUP BY key")
def hlen(spark, d):
    return state.hashes(spark, d).groupBy("key").agg(F.count("*").alias("n_fields"))


@query("SELECT key, field, value FROM {hashes} WHERE field <> 'click'")
def hdel(spark, d):
    h = state.hashes(spark, d)
    return hashes.delete_fields(h, h.where("field = 'click'").select("key", "field"))


@query("SELECT key, kind AS field, sum(seq % 13)::BIGINT AS total FROM {log} GROUP BY ALL")
def hincrby(spark, d):
    return hashes.increase(state.events(spark, d).withColumnRenamed("kind", "field"), F.col("seq") % 13)


_HSETS = "(SELECT seq, 'user:' || (seq % 700) AS key, CASE seq % 3 WHEN 0 THEN 'new' ELSE kind END AS field, kind AS value FROM {log})"


def _hsets(spark, d):
    seq = F.col("seq")
    return state.events(spark, d).select("seq", F.concat(F.lit("user:"), seq % 700).alias("key"), F.when(seq % 3 == 0, "new").otherwise(F.col("kind")).alias("field"), F.col("kind").alias("value"))


@query(f"SELECT key, count(*)::BIGINT AS n_added FROM (SELECT DISTINCT key, field FROM {_HSETS}) w ANTI JOIN {{hashes}} h USING (key, field) GROUP BY key")
def hset_count(spark, d):
    return hashes.added(_hsets(spark, d), state.hashes(spark, d))


@query(f"SELECT key, field, arg_max(value, seq) AS value FROM (SELECT -1 AS seq, key, field, value FROM {{hashes}} UNION ALL SELECT seq, key, field, value FROM {_HSETS}) GROUP BY ALL")
def hmset(spark, d):
    before = state.hashes(spark, d).select(F.lit(-1).cast("bigint").alias("seq"), "key", "field", "value")
    return hashes.set_fields(before.unionByName(_hsets(spark, d)))


@query(f"SELECT key, count(*)::BIGINT AS n_removed FROM {{hashes}} h SEMI JOIN {_HSETS} w USING (key, field) GROUP BY key")
def hdel_count(spark, d):
    return hashes.deleted(state.hashes(spark, d), _hsets(spark, d))


# ---- lists

@query("SELECT key, (row_number() OVER (PARTITION BY key ORDER BY seq) - 1)::BIGINT AS pos, kind AS value FROM {log}")
def rpush_list(spark, d):
    return lists.push(state.events(spark, d).select("seq", "key", F.col("kind").alias("value")))


@query("SELECT key, (row_number() OVER (PARTITION BY key ORDER BY seq DESC) - 1)::BIGINT AS pos, kind AS value FROM {log}")
def lpush_list(spark, d):
    return lists.push(state.events(spark, d).select("seq", "key", F.col("kind").alias("value")), left=True)


_PLACED = "(SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM {lists})"


@query("SELECT key, count(*)::BIGINT AS length FROM {lists} GROUP BY key")
def llen(spark, d):
    return lists.length(state.lists(spark, d))


_PUSHES = "(SELECT seq, 'conv:' || (seq % 300) AS key, kind AS value FROM {log})"


def _pushes(spark, d):
    return state.events(spark, d).select("seq", F.concat(F.lit("conv:"), F.col("seq") % 300).alias("key"), F.col("kind").alias("value"))


@query(f"SELECT seq, p.key, (row_number() OVER (PARTITION BY p.key ORDER BY seq) + coalesce(l.n, 0))::BIGINT AS length FROM {_PUSHES} p LEFT JOIN (SELECT key, count(*) AS n FROM {{lists}} GROUP BY key) l USING (key)")
def push_lengths(spark, d):
    return lists.push_lengths(_pushes(spark, d), state.lists(spark, d))


@query(f"SELECT key, place, value FROM {_PLACED}")
def lrange_all(spark, d):
    return lists.slices(state.lists(spark, d), 0, -1)


@query(f"SELECT key, place, value FROM {_PLACED} WHERE place >= 1 AND place <= n - 2")
def lrange_inner(spark, d):
    return lists.slices(state.lists(spark, d), 1, -2)


@query(f"SELECT seq, p.key, (seq % 9 - 4)::BIGINT AS index, CASE WHEN n IS NULL THEN 'no such key' WHEN seq % 9 - 4 >= n OR seq % 9 - 4 < -n THEN 'index out of range' END AS error FROM {_PUSHES} p LEFT JOIN (SELECT key, count(*) AS n FROM {{lists}} GROUP BY key) l USING (key)")
def lset_replies(spark, d):
    asked = _pushes(spark, d).select("seq", "key", (F.col("seq") % 9 - 4).alias("index"))
    return lists.set_replies(asked, state.lists(spark, d)).select("seq", "key", "index", "error")


@query(f"SELECT key, place, value FROM {_PLACED} WHERE place BETWEEN 1 AND 3")
def lrange_front(spark, d):
    return lists.slices(state.lists(spark, d), 1, 3)


@query(f"SELECT key, place, value FROM {_PLACED} WHERE place >= greatest(n - 3, 0)")
def lrange_back(spark, d):
    return lists.slices(state.lists(spark, d), -3, -1)


@query("SELECT key, max(CASE WHEN place = 2 THEN value END) AS third FROM " + _PLACED + " GROUP BY key")
def lindex(spark, d):
    return lists.element(state.lists(spark, d), 2).withColumnRenamed("value", "third")


@query("SELECT key, arg_max(value, pos) AS last FROM {lists} GROUP BY key")
def lindex_last(spark, d):
    return lists.element(state.lists(spark, d), -1).withColumnRenamed("value", "last")


@query(f"SELECT key, pos, CASE WHEN place = n - 2 THEN 'changed' ELSE value END AS value FROM {_PLACED}")
def lset(spark, d):
    return lists.set_element(state.lists(spark, d), -2, "changed")


@query(f"SELECT key, place, value FROM {_PLACED} WHERE place < 2")
def lpop_n(spark, d):
    return lists.pop(state.lists(spark, d), 2)[0]


@query(f"SELECT key, (n - 1 - place)::BIGINT AS place, value FROM {_PLACED} WHERE place >= n - 2")
def rpop_n(spark, d):
    return lists.pop(state.lists(spark, d), 2, left=False)[0]


@query(f"SELECT key, pos, value FROM {_PLACED} WHERE place >= 2")
def lpop_rest(spark, d):
    return lists.pop(state.lists(spark, d), 2)[1]


# ---- sets

@query("SELECT key, member FROM {sets}")
def sadd(spark, d):
    return sets.add(table(spark, d, "orders").select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.col("o_orderpriority").alias("member")))


@query("SELECT key, count(*)::BIGINT AS n_added FROM (SELECT DISTINCT 'cust:' || o_custkey AS key, o_orderstatus AS member FROM orders) GROUP BY key")
def sadd_count(spark, d):
    log = table(spark, d, "orders").select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.col("o_orderstatus").alias("member"))
    return sets.added(log, state.sets(spark, d))


@query("SELECT key, count(*)::BIGINT AS n_members FROM {sets} GROUP BY key")
def scard(spark, d):
    return sets.cardinality(state.sets(spark, d))


_MEMBERS = "(SELECT o_orderkey, 'cust:' || (o_custkey + 1) AS key, o_orderpriority AS member FROM orders)"


def _members(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("cust:"), F.col("o_custkey") + 1).alias("key"), F.col("o_orderpriority").alias("member"))


@query(f"SELECT o_orderkey, r.key, r.member, s.key IS NOT NULL AS found FROM {_MEMBERS} r LEFT JOIN {{sets}} s USING (key, member)")
def sismember(spark, d):
    return sets.is_member(_members(spark, d), state.sets(spark, d)).select("o_orderkey", "key", "member", "found")


@query("SELECT key, list(member ORDER BY member) AS members FROM {sets} GROUP BY key")
def smembers(spark, d):
    return sets.members(state.sets(spark, d))


@query(f"SELECT key, member FROM {{sets}} s ANTI JOIN {_MEMBERS} r USING (key, member)")
def srem(spark, d):
    return sets.remove(state.sets(spark, d), _members(spark, d))


@query("SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(member), member) AS rn FROM {sets}) WHERE rn <= 2")
def spop_n(spark, d):
    return sets.pop(state.sets(spark, d), 2)


@query(f"SELECT key, count(*)::BIGINT AS n_removed FROM {{sets}} s SEMI JOIN {_MEMBERS} r USING (key, member) GROUP BY key")
def srem_count(spark, d):
    return sets.removed(state.sets(spark, d), _members(spark, d))


@query("SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(member), member) AS rn FROM {sets}) WHERE rn > 2")
def spop_rest(spark, d):
    return sets.left_after_pop(state.sets(spark, d), 2)


# ---- scored sets

@query("SELECT c_mktsegment AS key, CAST(rn - 1 AS BIGINT) AS rank, c_name AS member, c_acctbal AS score FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_name) AS rn FROM customer) WHERE rn <= 10")
def zrange_top10(spark, d):
    return zsets.by_rank(state.zsets(spark, d), 0, 9)


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS place, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS back FROM {zsets})"


@query(f"SELECT key, back AS rank, member, score FROM {_RANKED} WHERE back BETWEEN 2 AND 6")
def zrange_rev(spark, d):
    return zsets.by_rank(state.zsets(spark, d), 2, 6, reverse=True)


@query(f"SELECT key, place AS rank, member, score FROM {_RANKED} WHERE back < 3")
def zrange_last(spark, d):
    return zsets.by_rank(state.zsets(spark, d), -3, -1)


@query(f"SELECT key, place AS rank, member, score FROM {_RANKED}")
def zrange_all(spark, d):
    return zsets.by_rank(state.zsets(spark, d), 0, -1)


@query(f"SELECT key, back AS rank, member, score FROM {_RANKED} WHERE back >= 3 AND place >= 2")
def zrange_rev_inner(spark, d):
    return zsets.by_rank(state.zsets(spark, d), 3, -3, reverse=True)


@query(f"SELECT key, member, place AS rank FROM {_RANKED}")
def zrank(spark, d):
    return zsets.rank(state.zsets(spark, d))


@query("SELECT key, count(*)::BIGINT AS n_members FROM {zsets} GROUP BY key")
def zcard(spark, d):
    return zsets.cardinality(state.zsets(spark, d))


@query("SELECT o_orderkey, r.key, r.member, z.score FROM (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS key, c_name AS member FROM orders JOIN customer ON c_custkey = o_custkey) r LEFT JOIN {zsets} z USING (key, member)")
def zscore(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("member"))
    asked = table(spark, d, "orders").join(names, "o_custkey").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("key"), "member")
    return zsets.score(asked, state.zsets(spark, d)).select("o_orderkey", "key", "member", "score")


@query("SELECT key, member, score FROM {zsets} WHERE member NOT IN (SELECT c_name FROM customer JOIN orders ON o_custkey = c_custkey)")
def zrem(spark, d):
    buyers = table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return zsets.remove(state.zsets(spark, d), buyers.select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member")))


@query("SELECT key, member, score FROM {zsets} WHERE score BETWEEN 0 AND 1000")
def zrangebyscore(spark, d):
    return zsets.by_score(state.zsets(spark, d), "0", "1000")


@query("SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS rn FROM {zsets} WHERE score > 100) WHERE rn BETWEEN 4 AND 8")
def zrangebyscore_excl_limit(spark, d):
    return zsets.by_score(state.zsets(spark, d), "(100", "+inf", 3, 5)


_SCORES = "(SELECT seq, 'board:' || kind AS key, key AS member, value AS score FROM {log})"
_HALF = "(SELECT 'board:' || kind AS key, key AS member, max(value) AS score FROM {log} WHERE seq % 2 = 0 GROUP BY ALL)"


def _scores(spark, d):
    return state.events(spark, d).select("seq", F.concat(F.lit("board:"), "kind").alias("key"), F.col("key").alias("member"), F.col("value").alias("score"))


def _board(spark, d):
    return zsets.add(_scores(spark, d).where("seq % 2 = 0"), "gt")


@query(f"SELECT key, member, arg_max(score, seq) AS score FROM {_SCORES} GROUP BY ALL")
def zadd_plain(spark, d):
    return zsets.add(_scores(spark, d))


@query(f"SELECT key, member, max(score) AS score FROM {_SCORES} GROUP BY ALL")
def zadd_gt(spark, d):
    return zsets.add(_scores(spark, d), "gt")


@query(f"SELECT key, member, min(score) AS score FROM {_SCORES} GROUP BY ALL")
def zadd_lt(spark, d):
    return zsets.add(_scores(spark, d), "lt")


@query(f"SELECT key, member, score FROM {_HALF} UNION ALL SELECT key, member, arg_min(score, seq) FROM {_SCORES} s ANTI JOIN {_HALF} h USING (key, member) GROUP BY ALL")
def zadd_nx(spark, d):
    return zsets.add(_scores(spark, d), "nx", _board(spark, d))


@query(f"SELECT h.key, h.member, coalesce(n.score, h.score) AS score FROM {_HALF} h LEFT JOIN (SELECT key, member, arg_max(score, seq) AS score FROM {_SCORES} WHERE seq % 3 = 0 GROUP BY ALL) n USING (key, member)")
def zadd_xx(spark, d):
    return zsets.add(_scores(spark, d).where("seq % 3 = 0"), "xx", _board(spark, d))


@query(f"SELECT n.key, count(*)::BIGINT AS n_changed FROM (SELECT key, member, arg_max(score, seq) AS score FROM {_SCORES} GROUP BY ALL) n LEFT JOIN {_HALF} h USING (key, member) WHERE h.score IS NULL OR h.score <> n.score GROUP BY n.key")
def zadd_ch(spark, d):
    return zsets.changed(_scores(spark, d), _board(spark, d))


@query(f"SELECT key, member, round(sum(score), 4) AS score FROM {_SCORES} GROUP BY ALL")
def zincrby(spark, d):
    return zsets.add(_scores(spark, d), "incr").withColumn("score", F.round("score", 4))


_LATER = f"(SELECT * FROM {_SCORES} WHERE seq % 2 = 1)"
_FOLDED = f"(SELECT key, member, arg_min(score, seq) AS first, max(score) AS high, min(score) AS low, sum(score) AS total, sum(greatest(score, 0)) AS up, sum(greatest(score, 0)) - greatest(arg_min(score, seq), 0) AS later_up FROM {_LATER} GROUP BY ALL)"


def _later(spark, d):
    return _scores(spark, d).where("seq % 2 = 1")


@query(f"SELECT h.key, h.member, greatest(h.score, f.high) AS score FROM {_HALF} h LEFT JOIN {_FOLDED} f USING (key, member)")
def zadd_xx_gt(spark, d):
    return zsets.update(_later(spark, d), _board(spark, d), "old", "up")


@query(f"SELECT h.key, h.member, least(h.score, f.low) AS score FROM {_HALF} h LEFT JOIN {_FOLDED} f USING (key, member)")
def zadd_xx_lt(spark, d):
    return zsets.update(_later(spark, d), _board(spark, d), "old", "down")


@query(f"SELECT coalesce(h.key, f.key) AS key, coalesce(h.member, f.member) AS member, round(CASE WHEN h.key IS NULL THEN f.first + f.later_up ELSE h.score + coalesce(f.up, 0) END, 4) AS score FROM {_HALF} h FULL JOIN {_FOLDED} f ON h.key = f.key AND h.member = f.member")
def zadd_gt_incr(spark, d):
    return zsets.update(_later(spark, d), _board(spark, d), toward="up", incr=True).withColumn("score", F.round("score", 4))


@query(f"SELECT h.key, h.member, round(h.score + coalesce(f.total, 0), 4) AS score FROM {_HALF} h LEFT JOIN {_FOLDED} f USING (key, member)")
def zadd_xx_incr(spark, d):
    return zsets.update(_later(spark, d), _board(spark, d), "old", incr=True).withColumn("score", F.round("score", 4))


@query(f"SELECT coalesce(h.key, f.key) AS key, coalesce(h.member, f.member) AS member, coalesce(h.score, f.first) AS score FROM {_HALF} h FULL JOIN {_FOLDED} f ON h.key = f.key AND h.member = f.member")
def zadd_nx_incr(spark, d):
    return zsets.update(_later(spark, d), _board(spark, d), "new", incr=True)


@query(f"SELECT key, count(*)::BIGINT AS n_added FROM (SELECT DISTINCT key, member FROM {_LATER}) ANTI JOIN {_HALF} h USING (key, member) GROUP BY key")
def zadd_count(spark, d):
    return zsets.added(_later(spark, d), _board(spark, d))


@query(f"SELECT seq, l.key, l.member, round(coalesce(h.score, 0) + sum(l.score) OVER (PARTITION BY l.key, l.member ORDER BY seq), 4) AS reply FROM {_LATER} l LEFT JOIN {_HALF} h USING (key, member)")
def zincrby_replies(spark, d):
    return zsets.increments(_later(spark, d), _board(spark, d)).withColumn("reply", F.round("reply", 4))


@query(f"SELECT key, count(*)::BIGINT AS n_removed FROM {_HALF} h SEMI JOIN {_LATER} l USING (key, member) GROUP BY key")
def zrem_count(spark, d):
    return zsets.removed(_board(spark, d), _later(spark, d))


# ---- sketches

_REGISTERS = """(SELECT key, (h & 16383)::INTEGER AS idx, max(CASE WHEN h >> 14 = 0 THEN 47 ELSE length(bin(h >> 14)) - length(rtrim(bin(h >> 14), '0')) + 1 END)::INTEGER AS reg
FROM (SELECT event_type AS key, ('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT AS h FROM events) GROUP BY ALL)"""
_COUNT = """SELECT key, floor(CASE WHEN raw <= 40960 AND zeros > 0 THEN 16384 * ln(16384 / zeros) ELSE raw END + 0.5)::BIGINT AS estimate
FROM (SELECT key, 16384.0::DOUBLE - count(*) AS zeros, (0.7213 / (1 + 1.079 / 16384.0::DOUBLE)) * 16384.0 * 16384.0 / (sum(pow(2.0, -reg)) + 16384.0::DOUBLE - count(*)) AS raw FROM {r} GROUP BY key)"""


def _registers(spark, d):
    return sketches.add(table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("element")))


@query(f"SELECT key, idx, reg FROM {_REGISTERS}")
def pfadd_registers(spark, d):
    return _registers(spark, d)


@query(f"""SELECT n.key, max((o.reg IS NULL OR n.reg > o.reg)::INTEGER) AS reply FROM (SELECT CASE key WHEN 'view' THEN 'view' ELSE 'click' END AS key, idx, max(reg) AS reg FROM {_REGISTERS} GROUP BY ALL) n
LEFT JOIN {_REGISTERS} o ON o.key = n.key AND o.idx = n.idx GROUP BY n.key""")
def pfadd_replies(spark, d):
    key = F.when(F.col("event_type") == "view", "view").otherwise("click")
    more = sketches.add(table(spark, d, "events").select(key.alias("key"), F.col("user_id").alias("element")))
    return sketches.changed(_registers(spark, d), more)


@query(_COUNT.replace("{r}", _REGISTERS))
def pfcount(spark, d):
    return sketches.count(_registers(spark, d))


_LINES = _REGISTERS.replace("SELECT event_type AS key, ('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT AS h FROM events", "SELECT 'lines' AS key, ('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 15))::BIGINT AS h FROM lineitem")


@query(_COUNT.replace("{r}", _LINES))
def pfcount_large(spark, d):
    """Enough elements for the raw estimate, from 41,000 on (scale factor 0.01)."""
    element = F.concat_ws(":", "l_orderkey", "l_linenumber")
    return sketches.count(sketches.add(table(spark, d, "lineitem").select(F.lit("lines").alias("key"), element.alias("element"))))


@query(f"SELECT 'all' AS key, idx, max(reg)::INTEGER AS reg FROM {_REGISTERS} GROUP BY idx")
def pfmerge(spark, d):
    return sketches.merge(_registers(spark, d), "all")


@query(_COUNT.replace("{r}", f"(SELECT 'all' AS key, idx, max(reg) AS reg FROM {_REGISTERS} GROUP BY idx)"))
def pfcount_union(spark, d):
    return sketches.count(sketches.merge(_registers(spark, d), "all"))


# ---- vectors

@query("SELECT key, count(*)::BIGINT AS n_vectors FROM {vectors} GROUP BY key")
def vcard(spark, d):
    return vectors.cardinality(state.vectors(spark, d))


@query("SELECT key, label, pos, vec[pos + 1]::DOUBLE AS value FROM (SELECT key, label % 100 AS label, arg_max(vec, label) AS vec FROM {vectors} GROUP BY ALL), (SELECT unnest(range(64))::INTEGER AS pos) WHERE pos < len(vec)")
def vadd_latest(spark, d):
    v = state.vectors(spark, d)
    last = vectors.add_last(v.select("key", F.col("label").alias("seq"), (F.col("label") % 100).alias("label"), "vec"))
    return last.select("key", "label", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


@query("SELECT key, label, CASE WHEN label % 7 = 0 AND arg_min(label, label) OVER (PARTITION BY key) % 7 <> 0 THEN 'vector dimension mismatch' WHEN label % 7 <> 0 AND arg_min(label, label) OVER (PARTITION BY key) % 7 = 0 THEN 'vector dimension mismatch' END AS error FROM {vectors}")
def vadd_replies(spark, d):
    vec = F.when(F.col("label") % 7 == 0, F.slice("vec", 1, 3)).otherwise(F.col("vec"))
    log = state.vectors(spark, d).select("key", F.col("label").alias("seq"), "label", vec.alias("vec"))
    return vectors.add_checked(log).select("key", "label", "error")


def _questions(spark, d):
    """The stated set of queries: every vector whose id is divisible by 20, asked of its own key."""
    return state.vectors(spark, d).where("label % 20 = 0").select(F.col("label").alias("query"), "key", "vec")


_NEAREST = """SELECT query, rank, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, label) AS rank FROM (
SELECT q.label AS query, v.label, {m} AS score FROM {vectors} v JOIN {vectors} q ON v.key = q.key WHERE q.label % 20 = 0 {and})) WHERE rank <= 10"""


@query(_NEAREST.replace("{m}", "list_cosine_similarity(v.vec::DOUBLE[], q.vec::DOUBLE[])").replace("{and}", ""))
def vsim_cosine(spark, d):
    return vectors.search(state.vectors(spark, d), _questions(spark, d), 10)


@query(_NEAREST.replace("{m}", "-list_distance(v.vec::DOUBLE[], q.vec::DOUBLE[])").replace("{and}", ""))
def vsim_l2(spark, d):
    return vectors.search(state.vectors(spark, d), _questions(spark, d), 10, "l2")


@query(_NEAREST.replace("{m}", "list_cosine_similarity(v.vec::DOUBLE[], q.vec::DOUBLE[])").replace("{and}", "AND v.label % 3 <> 0"))
def vrem_topk(spark, d):
    v = state.vectors(spark, d)
    return vectors.search(vectors.remove(v, v.where("label % 3 = 0").select("key", "label")), _questions(spark, d), 10)


@query()
def vsim_indexed(spark, d):
    return vectors.search_indexed(state.vectors(spark, d), _questions(spark, d), 10)


@query("SELECT label, pos, round(vec[pos + 1]::DOUBLE / sqrt(list_sum(list_transform(vec, lambda y: y::DOUBLE * y::DOUBLE))), 6) AS value FROM {vectors}, (SELECT unnest(range(64))::INTEGER AS pos) WHERE pos < len(vec)")
def vector_prepare(spark, d):
    return state.vectors(spark, d).select("label", F.posexplode(vectors.unit(F.col("vec"))).alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("SELECT a.label, round(1 - list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 6) AS cosine, round(list_distance(a.vec::DOUBLE[], b.vec::DOUBLE[]) ** 2, 6) AS l2 FROM {vectors} a JOIN {vectors} b ON b.label = a.label + 1")
def vector_distance(spark, d):
    v = state.vectors(spark, d)
    pairs = v.join(v.select((F.col("label") - 1).alias("label"), F.col("vec").alias("other")), "label")
    return pairs.select("label", *[F.round(vectors.distance(F.col("vec"), F.col("other"), m), 6).alias(m) for m in ("cosine", "l2")])


@query("SELECT r.key, r.label, (v.label IS NOT NULL)::INTEGER AS reply FROM (SELECT key, label * 2 AS label FROM {vectors}) r LEFT JOIN {vectors} v USING (key, label)")
def vrem_replies(spark, d):
    v = state.vectors(spark, d)
    return vectors.removed(v.select("key", (F.col("label") * 2).alias("label")), v)


# ---- metrics and introspection

def _ops(spark, d):
    return state.events(spark, d).withColumn("micros", F.abs("value") * 1000)


_OPS = "(SELECT *, abs(value) * 1000 AS micros FROM {log})"
_BUCKET = "(CASE WHEN micros < 1 THEN 0 ELSE least(511, floor(ln(micros) / (ln(6e7) / 512)) + 1) END)::INTEGER"


@query(f"SELECT kind, bucket, n, (sum(n) OVER (PARTITION BY kind ORDER BY bucket))::BIGINT AS cumulative FROM (SELECT kind, {_BUCKET} AS bucket, count(*) AS n FROM {_OPS} GROUP BY ALL)")
def latency_histogram(spark, d):
    return metrics.histogram(_ops(spark, d), "kind")


@query(f"""SELECT kind, min(bucket) AS bucket FROM (SELECT kind, bucket, sum(n) OVER (PARTITION BY kind ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY kind) AS t
FROM (SELECT kind, {_BUCKET} AS bucket, count(*) AS n FROM {_OPS} GROUP BY ALL)) WHERE c >= ceil(t * 0.99::DOUBLE) GROUP BY kind""")
def latency_p99_bucket(spark, d):
    return metrics.bucket_percentile(_ops(spark, d), 0.99, "kind")


@query(f"SELECT kind, round(quantile_cont(micros, 0.5), 6) AS p50, round(quantile_cont(micros, 0.9), 6) AS p90, round(quantile_cont(micros, 0.99), 6) AS p99, round(avg(micros), 6) AS mean FROM {_OPS} GROUP BY kind")
def metrics_percentiles(spark, d):
    return metrics.percentiles(_ops(spark, d), "kind")


@query("SELECT shard, n_ops, round(n_ops / sum(n_ops) OVER (), 6) AS share FROM (SELECT (substr(key, 6)::BIGINT % 4)::INTEGER AS shard, count(*)::BIGINT AS n_ops FROM {log} GROUP BY ALL)")
def shard_balance(spark, d):
    return metrics.shard_balance(_ops(spark, d), (F.substring("key", 6, 20).cast("bigint") % 4).cast("int"))


@query()
def shard_balance_hashed(spark, d):
    return metrics.shard_balance(_ops(spark, d), shard_of(F.col("key"), 16))


@query("""SELECT kind, tick, n_ops, round(coalesce(n_ops / ((tick - lag(tick) OVER w) * 86400.0::DOUBLE), 0.0), 6) AS per_s,
round((n_ops - lag(n_ops) OVER w) / lag(n_ops) OVER w, 6) AS change FROM (SELECT kind, ts_ms // 86400000 AS tick, count(*)::BIGINT AS n_ops FROM {log} GROUP BY ALL) WINDOW w AS (PARTITION BY kind ORDER BY tick)""")
def throughput_rate(spark, d):
    return metrics.rates(_ops(spark, d), 86_400_000, "kind")


@query("SELECT kind, tick, n_ops, (sum(n_ops) OVER (PARTITION BY kind ORDER BY tick ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))::BIGINT AS window_ops FROM (SELECT kind, ts_ms // 3600000 AS tick, count(*)::BIGINT AS n_ops FROM {log} GROUP BY ALL)")
def rolling60(spark, d):
    return metrics.rolling(_ops(spark, d), 3_600_000, 60, "kind")


@query(f"SELECT count(s.key)::BIGINT AS hits, count(*) FILTER (s.key IS NULL)::BIGINT AS misses, round(count(s.key) / count(*), 6) AS rate FROM {_ORDERS} r LEFT JOIN {{live}} s USING (key)")
def hit_rate(spark, d):
    return metrics.hit_rate(strings.get(_orders(spark, d), state.strings(spark, d), NOW_MS), F.col("value").isNotNull())


@query("SELECT key, count(*) FILTER (kind = 'view')::BIGINT AS reads, count(*) FILTER (kind <> 'view')::BIGINT AS writes, round(count(*) FILTER (kind = 'view') / count(*), 6) AS ratio FROM {log} GROUP BY key")
def read_ratio(spark, d):
    return metrics.read_ratio(_ops(spark, d), F.col("kind") == "view", "key")


@query(f"""SELECT 'keyspace' AS section, 'keys' AS field, count(*)::BIGINT AS value FROM {_KEYS} UNION ALL SELECT 'keyspace', 'expires', count(deadline_ms) FROM {{live}}
UNION ALL SELECT 'keyspace', 'expired', count(*) FROM {{strings}} WHERE deadline_ms <= {{now}} UNION ALL SELECT 'memory', 'used', sum(strlen(key) + strlen(value) + 48)::BIGINT FROM {{live}}
UNION ALL SELECT 'stats', 'commands', count(*) FROM events""")
def info_stats(spark, d):
    return metrics.info(_keys(spark, d), state.strings(spark, d), _ops(spark, d), NOW_MS)


def _number_shard():
    """The shard by a key's number: what DuckDB can confirm."""
    return (F.substring_index("key", ":", -1).cast("bigint") % 4).cast("int")


def _held(spark, d):
    return live(state.strings(spark, d), NOW_MS).select("key", (F.octet_length("key") + F.octet_length("value") + 48).alias("bytes"))


_SHARD = "(split_part(key, ':', 2)::BIGINT % 4)::INTEGER"
_BY_SHARD = f"""(SELECT coalesce(o.shard, k.shard) AS shard, coalesce(commands, 0) AS commands, coalesce(reads, 0) AS reads, coalesce(writes, 0) AS writes, coalesce(keys, 0) AS keys, coalesce(memory, 0)::BIGINT AS memory
FROM (SELECT {_SHARD} AS shard, count(*) AS commands, count(*) FILTER (kind = 'view') AS reads, count(*) FILTER (kind <> 'view') AS writes FROM {{log}} GROUP BY ALL) o
FULL JOIN (SELECT {_SHARD} AS shard, count(*) AS keys, sum(strlen(key) + strlen(value) + 48) AS memory FROM {{live}} GROUP BY ALL) k ON o.shard = k.shard)"""


@query(f"""WITH coarse AS (SELECT b AS coarse, exp(ln(6e7) / 512 * least((b + 1) * 8, 512)) / 1e6 AS bound, (SELECT count(*) FROM {_OPS} WHERE {_BUCKET} // 8 = b) AS n FROM range(64) t(b))
SELECT name || '{{shard="' || shard || '"}} ' || v AS line FROM (SELECT shard, unnest(['commands_total', 'reads_total', 'writes_total', 'keys', 'memory_bytes']) AS name, unnest([commands, reads, writes, keys, memory]) AS v FROM {_BY_SHARD})
UNION ALL SELECT 'latency_seconds_bucket{{le="' || printf('%.9f', bound) || '"}} ' || (sum(n) OVER (ORDER BY coarse))::BIGINT FROM coarse
UNION ALL SELECT 'latency_seconds_bucket{{le="+Inf"}} ' || sum(n)::BIGINT FROM coarse UNION ALL SELECT 'latency_seconds_count ' || sum(n)::BIGINT FROM coarse
UNION ALL SELECT 'latency_seconds_sum ' || printf('%.6f', sum(n * bound)) FROM coarse""")
def exposition_lines(spark, d):
    return metrics.exposition_line(metrics.exposition(_ops(spark, d), _held(spark, d), _number_shard(), F.col("kind") == "view"))


@query(f"""WITH each AS (SELECT * FROM {_BY_SHARD}), h AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS c, sum(n) OVER () AS t FROM (SELECT {_BUCKET} AS bucket, count(*) AS n FROM {_OPS} GROUP BY ALL))
SELECT '{{"shard_count":' || count(*) || ',"commands":' || sum(commands) || ',"keys":' || sum(keys) || ',"memory":' || sum(memory) || ',"p50_bucket":' || (SELECT min(bucket) FROM h WHERE c >= ceil(t * 0.5::DOUBLE))
  || ',"p99_bucket":' || (SELECT min(bucket) FROM h WHERE c >= ceil(t * 0.99::DOUBLE)) || ',"shards":['
  || string_agg('{{"shard":' || shard || ',"commands":' || commands || ',"keys":' || keys || ',"memory":' || memory || ',"reads":' || reads || ',"writes":' || writes || '}}', ',' ORDER BY shard) || ']}}' AS json FROM each""")
def dashboard_json(spark, d):
    return metrics.dashboard(_ops(spark, d), _held(spark, d), _number_shard(), F.col("kind") == "view")


@query()
def command_table(spark, d):
    return commands.table(spark)


@query("""SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE 'unknown command' END AS error,
CASE WHEN event_type IN ('view', 'click') THEN 'user:' || user_id || ' user:' || user_id || ':b' END AS keys FROM events""")
def command_check(spark, d):
    key = F.concat(F.lit("user:"), "user_id")
    name = F.when(F.col("event_type") == "view", "MGET").when(F.col("event_type") == "click", "Del").otherwise("nosuch")
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.array(name, key, F.concat(key, F.lit(":b"))).alias("argv"))
    return commands.checked(log, commands.table(spark)).select("seq", "error", F.array_join("keys", " ").alias("keys"))


# ---- recovery

def _counter_log(spark, d):
    kind = F.when(F.col("seq") % 17 == 0, "set").otherwise("incrby")
    return state.events(spark, d).select("seq", "key", kind.alias("op"), (F.col("seq") % 23).alias("arg"))


_FOLD = """WITH log AS (SELECT seq, key, CASE WHEN seq % 17 = 0 THEN 'set' ELSE 'incrby' END AS op, seq % 23 AS arg FROM {log}),
base AS (SELECT key, max(seq) AS set_seq, arg_max(arg, seq) AS base FROM log WHERE op = 'set' GROUP BY key)
SELECT log.key, (coalesce(max(base), 0) + sum(CASE WHEN op = 'incrby' AND (set_seq IS NULL OR seq > set_seq) THEN arg ELSE 0 END))::BIGINT AS value, max(seq) AS max_seq FROM log LEFT JOIN base USING (key) GROUP BY log.key"""


@query(_FOLD)
def oplog_fold(spark, d):
    return fold.fold_counters(_counter_log(spark, d))


@query(_FOLD)
def snapshot_plus_log(spark, d):
    log = _counter_log(spark, d)
    return fold.snapshot_and_log(fold.fold_counters(log.where("seq < 400")), log)


_BARRIER = "(SELECT seq, key, CASE WHEN seq = 100 THEN 'flush' WHEN seq % 61 = 0 THEN 'del' ELSE 'incrby' END AS op FROM {log})"


@query(f"SELECT l.seq, l.key FROM {_BARRIER} l LEFT JOIN (SELECT key, max(seq) AS cut FROM {_BARRIER} WHERE op = 'del' GROUP BY key) c USING (key) WHERE op = 'incrby' AND l.seq > 100 AND (cut IS NULL OR l.seq > cut)")
def flush_barrier(spark, d):
    op = F.when(F.col("seq") == 100, "flush").when(F.col("seq") % 61 == 0, "del").otherwise("incrby")
    return fold.barrier(state.events(spark, d).select("seq", "key", op.alias("op"))).select("seq", "key")


_FOLD_ALL = """WITH raw AS (SELECT seq, key, CASE WHEN seq = 100 THEN 'flush' WHEN seq % 61 = 0 THEN 'del' WHEN seq % 17 = 0 THEN 'set' ELSE 'incrby' END AS op, seq % 23 AS arg FROM {log}),
log AS (SELECT raw.* FROM raw LEFT JOIN (SELECT key, max(seq) AS cut FROM raw WHERE op = 'del' GROUP BY key) c USING (key) WHERE op IN ('set', 'incrby') AND seq > 100 AND (cut IS NULL OR seq > cut)),
base AS (SELECT key, max(seq) AS set_seq, arg_max(arg, seq) AS base FROM log WHERE op = 'set' GROUP BY key)
SELECT log.key, (coalesce(max(base), 0) + sum(CASE WHEN op = 'incrby' AND (set_seq IS NULL OR seq > set_seq) THEN arg ELSE 0 END))::BIGINT AS value, max(seq) AS max_seq FROM log LEFT JOIN base USING (key) GROUP BY log.key"""


def _whole_log(spark, d):
    seq = F.col("seq")
    op = F.when(seq == 100, "flush").when(seq % 61 == 0, "del").when(seq % 17 == 0, "set").otherwise("incrby")
    return state.events(spark, d).select("seq", "key", op.alias("op"), (seq % 23).alias("arg"))


def _framed(log):
    """The commands of a log."""
    arg = F.col("arg").cast("string")
    return log.select("seq", F.when(F.col("op") == "flush", F.array(F.lit("FLUSHALL"))).when(F.col("op") == "del", F.array(F.lit("DEL"), "key")).otherwise(F.array(F.upper("op"), "key", arg)).alias("argv"))


@query(_FOLD_ALL)
def fold_with_barriers(spark, d):
    return fold.fold_log(_whole_log(spark, d))


@query(_FOLD_ALL)
def replay_from_files(spark, d):
    """A log in framed files, some of it in a snapshot on disk: both read and folded. The log is parsed once, to a table that the fold reads."""
    log, folder = _whole_log(spark, d), scratch(spark, "replay")
    oplog.write_log(_framed(log), f"{folder}/log")
    oplog.write_snapshot(fold.fold_log(log.where("seq < 400")), f"{folder}/snapshot")
    rows = fold.commands_to_log(oplog.read_log(spark, f"{folder}/log"))
    rows.write.parquet(f"{folder}/rows")
    return fold.snapshot_and_log(oplog.read_snapshot(spark, f"{folder}/snapshot"), spark.read.schema(rows.schema).parquet(f"{folder}/rows"))


#: A log of commands on all types: what each event does, by its number.
_DONE = """(SELECT seq, substr(key, 6) AS u, kind, props, value, CASE WHEN seq % 31 = 0 THEN 'del' WHEN seq % 13 = 0 THEN 'hdel' WHEN seq % 17 = 0 THEN 'srem' WHEN seq % 19 = 0 THEN 'zrem' WHEN seq % 7 = 0 THEN 'set'
 WHEN seq % 5 = 0 THEN 'hset' WHEN seq % 5 = 1 THEN 'sadd' WHEN seq % 5 = 2 THEN 'zadd' WHEN seq % 5 = 3 THEN 'zincrby' ELSE 'incrby' END AS op FROM {log})"""


def _done(spark, d):
    seq, u, kind = F.col("seq"), F.substring("key", 6, 20), F.col("kind")
    words = lambda name, *more: F.array(F.lit(name), *[(F.lit(m) if isinstance(m, str) else m).cast("string") for m in more])
    key = lambda t: F.concat(F.lit(f"{t}:"), u)
    argv = (F.when(seq % 31 == 0, words("DEL", key("h"), key("z"), key("c"))).when(seq % 13 == 0, words("HDEL", key("h"), kind, "n")).when(seq % 17 == 0, words("SREM", key("s"), kind)).when(seq % 19 == 0, words("ZREM", key("z"), kind))
            .when(seq % 7 == 0, words("SET", key("c"), seq % 23)).when(seq % 5 == 0, words("HSET", key("h"), kind, F.col("props"), "n", seq)).when(seq % 5 == 1, words("SADD", key("s"), kind, "all"))
            .when(seq % 5 == 2, words("ZADD", key("z"), F.col("value"), kind)).when(seq % 5 == 3, words("ZINCRBY", key("z"), "1.5", kind)).otherwise(words("INCRBY", key("c"), seq % 23)))
    return state.events(spark, d).select("seq", argv.alias("argv"))


@query(f"""WITH ops AS (SELECT * FROM {_DONE}), cut AS (SELECT u, max(seq) AS cut FROM ops WHERE op = 'del' GROUP BY u),
live AS (SELECT ops.* FROM ops LEFT JOIN cut USING (u) WHERE cut IS NULL OR seq > cut),
fields AS (SELECT u, kind AS item, seq, op, props AS v FROM live WHERE op IN ('hset', 'hdel') UNION ALL SELECT u, 'n', seq, op, seq::VARCHAR FROM live WHERE op IN ('hset', 'hdel')),
members AS (SELECT u, kind AS item, seq, op FROM ops WHERE op IN ('sadd', 'srem') UNION ALL SELECT u, 'all', seq, op FROM ops WHERE op = 'sadd'),
scores AS (SELECT *, kind AS item FROM live WHERE op IN ('zadd', 'zincrby', 'zrem')),
zends AS (SELECT u, item, max(seq) FILTER (op = 'zrem') AS gone, max(seq) FILTER (op = 'zadd') AS put, arg_max(value, seq) FILTER (op = 'zadd') AS base, max(seq) AS last FROM scores GROUP BY ALL),
sets AS (SELECT u, max(seq) FILTER (op = 'set') AS put, arg_max(seq % 23, seq) FILTER (op = 'set') AS base FROM live WHERE op IN ('set', 'incrby') GROUP BY u)
SELECT 'hash' AS type, 'h:' || u AS key, item, arg_max(v, seq) AS text, NULL::DOUBLE AS score FROM fields GROUP BY u, item HAVING arg_max(op, seq) = 'hset'
UNION ALL SELECT 'set', 's:' || u, item, NULL, NULL FROM members GROUP BY u, item HAVING arg_max(op, seq) = 'sadd'
UNION ALL SELECT 'zset', 'z:' || e.u, e.item, NULL, round(coalesce(CASE WHEN gone IS NULL OR put > gone THEN base END, 0)
  + 1.5 * (SELECT count(*) FROM scores s WHERE s.u = e.u AND s.item = e.item AND s.op = 'zincrby' AND s.seq > greatest(coalesce(gone, -1), coalesce(put, -1))), 4) FROM zends e WHERE gone IS NULL OR last > gone
UNION ALL SELECT 'string', 'c:' || s.u, '', (coalesce(base, 0) + (SELECT coalesce(sum(seq % 23), 0) FROM live l WHERE l.u = s.u AND l.op = 'incrby' AND l.seq > coalesce(s.put, -1)))::BIGINT::VARCHAR, NULL FROM sets s""")
def replay_all(spark, d):
    """State of all types from framed files of mixed commands."""
    folder = scratch(spark, "commands")
    oplog.write_log(_done(spark, d), folder)
    tables = replay.replay(oplog.read_log(spark, folder), scratch(spark, "operations"))
    none, no_score = F.lit(None).cast("string"), F.lit(None).cast("double")
    return (tables["hashes"].select(F.lit("hash").alias("type"), "key", F.col("field").alias("item"), F.col("value").alias("text"), no_score.alias("score"))
            .unionByName(tables["sets"].select(F.lit("set").alias("type"), "key", F.col("member").alias("item"), none.alias("text"), no_score.alias("score")))
            .unionByName(tables["zsets"].select(F.lit("zset").alias("type"), "key", F.col("member").alias("item"), none.alias("text"), F.round("score", 4).alias("score")))
            .unionByName(tables["strings"].select(F.lit("string").alias("type"), "key", F.lit("").alias("item"), F.col("value").alias("text"), no_score.alias("score"))))


@query("SELECT event_id AS seq, 'SET' AS name, 'user:' || user_id AS key, props || chr(13) || chr(10) || event_type AS value FROM events")
def log_round_trip(spark, d):
    """Every event as a command whose value holds line ends, written to framed files and read back."""
    folder = scratch(spark, "log")
    e = state.events(spark, d)
    oplog.write_log(e.select("seq", F.array(F.lit("SET"), "key", F.concat("props", F.lit("\r\n"), "kind")).alias("argv")), folder)
    word = lambda i: F.col("argv")[i].cast("string")
    return oplog.read_log(spark, folder).select("seq", word(0).alias("name"), word(1).alias("key"), word(2).alias("value"))


@query("SELECT key, value, deadline_ms FROM {live}")
def snapshot_round_trip(spark, d):
    """The state written to a snapshot and read back; expired keys stay behind."""
    folder = scratch(spark, "snapshot")
    oplog.write_snapshot(state.strings(spark, d), folder)
    return oplog.read_snapshot(spark, folder, NOW_MS)


@query()
def replay_lists(spark, d):
    op = F.when(F.col("seq") % 5 == 0, "lpush").when(F.col("seq") % 5 == 1, "lpop").when(F.col("seq") % 5 == 2, "rpop").otherwise("rpush")
    return fold.replay_lists(state.events(spark, d).select("seq", "key", op.alias("op"), F.col("seq").cast("string").alias("arg")))


# ---- streams

def _stream(spark, d):
    path = f"{d}/events.parquet"
    return jobs.read_events(spark, path, spark.read.parquet(path).schema)


@query("SELECT user_id, count(*)::BIGINT AS n_ops, arg_max(props, event_id) AS last FROM events GROUP BY user_id")
def stream_counters(spark, d):
    return jobs.settled(jobs.counters(_stream(spark, d)), ["user_id"], scratch(spark, "counters"))


@query("SELECT to_timestamp((epoch_us(ts) // 86400000000) * 86400)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n_ops FROM events GROUP BY ALL")
def stream_rates(spark, d):
    return jobs.settled(jobs.windowed_rates(_stream(spark, d)), ["start", "event_type"], scratch(spark, "rates")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, count(*)::BIGINT AS n_ops, false AS expired FROM events GROUP BY user_id")
def stream_expiring(spark, d):
    """Counters with a deadline in event time that none of them reaches."""
    return jobs.settled(jobs.expiring_counters(_stream(spark, d), "36500 days"), ["user_id"], scratch(spark, "expiring"))
