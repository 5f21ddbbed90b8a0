"""Goldens and edge cases of the keyed-value operators."""

import gzip
import math
import tempfile
from collections import deque

import duckdb
import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from keyloom.functions import files, ordered
from keyloom.functions.keys import glob, glob_regex, live, parse_double, parse_int
from keyloom.operators import commands, generic, hashes, lists, metrics, sets, sketches, strings, vectors, zsets
from keyloom.plans import fold, replay
from keyloom.sources import oplog
from keyloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def rows_of(df, *columns):
    return [tuple(r[c] for c in (columns or df.columns)) for r in df.collect()]


def test_live_and_ttl(spark):
    state = spark.createDataFrame([(f"k{i}", "v", 500) for i in range(50)] + [("survivor", "v", None), ("later", "v", 6000), ("zero", "v", 0)], "key string, value string, deadline_ms long")
    assert rows(live(state, 1000), "key") == [("later",), ("survivor",)]
    asked = spark.createDataFrame([("survivor",), ("later",), ("k1",), ("nope",), ("later",)], "key string")
    assert rows(generic.ttl(asked, state, 1000), "key", "ttl_s", "ttl_ms") == [("k1", -2, -2), ("later", 5, 5000), ("later", 5, 5000), ("nope", -2, -2), ("survivor", -1, -1)]
    assert generic.active_expire(state, 1000).count() == 51
    assert generic.active_expire(state, 1000, 20).count() == 20
    assert generic.exists(asked, state, 1000).count() == 3


@pytest.mark.parametrize(("pattern", "key", "hit"), [
    ("*", "*x", True), ("h?llo", "hello", True), ("h?llo", "hllo", False), ("h[ae]llo", "hallo", True), ("h[^e]llo", "hello", False),
    ("h[!e]llo", "hallo", True), ("h[a-c]llo", "hbllo", True), ("a\\*b", "a*b", True), ("a\\*b", "axb", False), ("a.b", "axb", False), ("user:*", "user:1\n2", True),
])
def test_glob(spark, pattern, key, hit):
    import re

    assert bool(re.match(glob_regex(pattern), key)) == hit
    assert spark.createDataFrame([(key,)], "key string").where(glob(F.col("key"), pattern)).count() == hit


def test_unknown_type_and_rule(spark):
    keys = spark.createDataFrame([("a", "set")], "key string, type string")
    with pytest.raises(ValueError, match="unknown type"):
        generic.scan(keys, "*", "nosuch")
    with pytest.raises(ValueError, match="unknown rule"):
        zsets.add(spark.createDataFrame([], "seq long, key string, member string, score double"), "nosuch")


def test_string_goldens(spark):
    log = spark.createDataFrame([(1, "user:1", "alice"), (2, "user:1", "bob"), (3, "s", "ab"), (4, "s", "é")], "seq long, key string, value string")
    assert rows(strings.set_last(log)) == [("s", "é"), ("user:1", "bob")]
    assert rows(strings.append(log.where("key = 's'"))) == [("s", "abé", 4)]
    assert rows(strings.get_set(log), "seq", "previous") == [(1, None), (2, "alice"), (3, None), (4, "ab")]
    value = spark.createDataFrame([("hello",), (None,), ("",)], "v string")
    got = value.select(strings.byte_range(F.col("v"), -3, 9).cast("string").alias("a"), strings.byte_range(F.col("v"), 3, 1).cast("string").alias("b")).collect()
    assert [tuple(r) for r in got] == [("llo", ""), ("", ""), ("", "")]
    assert value.select(F.hex(strings.set_range(F.col("v"), 6, "x"))).first()[0] == "68656C6C6F0078"


def test_hash_list_set_goldens(spark):
    h = hashes.set_fields(spark.createDataFrame([(1, "h", "f1", "v1"), (1, "h", "f2", "v2"), (2, "h", "f1", "v3")], "seq long, key string, field string, value string"))
    assert rows(h) == [("h", "f1", "v3"), ("h", "f2", "v2")]
    assert hashes.as_map(h).first()["hash"] == {"f1": "v3", "f2": "v2"}
    assert hashes.delete_fields(h, h).count() == 0
    items = lists.push(spark.createDataFrame([(1, "l", "a"), (2, "l", "b"), (3, "l", "c")], "seq long, key string, value string"))
    assert rows(lists.slices(items, 0, -1)) == [("l", 0, "a"), ("l", 1, "b"), ("l", 2, "c")]
    assert rows(lists.slices(items, -100, 0)) == [("l", 0, "a")]
    assert rows(lists.slices(items, 2, 1)) == []
    assert lists.element(items, 9).first()["value"] is None
    assert rows(sets.cardinality(sets.add(spark.createDataFrame([("st", "x"), ("st", "y"), ("st", "x")], "key string, member string")))) == [("st", 2)]


def test_zset_goldens(spark):
    state = spark.createDataFrame([("z", "bravo", 1.0), ("z", "alpha", 1.0), ("z", "charlie", 1.0), ("z", "two", 2.0)], "key string, member string, score double")
    assert rows(zsets.rank(state), "rank", "member") == [(0, "alpha"), (1, "bravo"), (2, "charlie"), (3, "two")]
    assert rows(zsets.by_rank(state, 0, 1, reverse=True), "rank", "member") == [(0, "two"), (1, "charlie")]
    assert rows(zsets.by_score(state, "(1", "+inf"), "member") == [("two",)]
    ten = spark.createDataFrame([("k", f"m{i}", float(i)) for i in range(10)], "key string, member string, score double")
    assert rows(zsets.by_score(ten, "5", "inf"), "member") == [(f"m{i}",) for i in range(5, 10)]
    assert rows(zsets.rank(zsets.remove(ten, ten.where("member = 'm5'"))).where("member = 'm6'"), "rank") == [(5,)]


@pytest.mark.parametrize(("n", "bound"), [(10, 0.1), (1000, 0.05), (100_000, 0.03)])
def test_hll_error(spark, n, bound):
    elements = spark.range(n * 2).select(F.lit("k").alias("key"), F.concat(F.lit("element:"), F.col("id") % n).alias("element"))
    assert math.isclose(sketches.count(sketches.add(elements)).first()["estimate"], n, rel_tol=bound)
    assert math.isclose(sketches.approximate(elements).first()["estimate"], n, rel_tol=bound)


def test_vectors(spark):
    state = spark.createDataFrame([("e", "x", [1.0, 0.0, 0.0]), ("e", "y", [0.0, 1.0, 0.0]), ("e", "o", [0.0, 0.0, 0.0]), ("f", "z", [0.9, 0.1, 0.0]), ("e", "n", None)], "key string, label string, vec array<float>")
    asked = spark.createDataFrame([(1, "e", [0.9, 0.1, 0.0]), (2, "g", [0.9, 0.1, 0.0]), (3, "e", [1.0])], "query int, key string, vec array<float>")
    assert rows(vectors.search(state, asked, 1), "query", "label") == [(1, "x")]
    assert rows(vectors.search(state, asked, 9), "rank", "label") == [(1, "x"), (2, "y"), (3, "o")]
    assert vectors.search(state.limit(0), asked, 9).count() == vectors.search(state, asked.limit(0), 9).count() == 0
    # closer than six decimals tell
    near = spark.createDataFrame([("e", 1, [1.0, 1e-4]), ("e", 2, [1.0, 0.0]), ("e", 3, [1.0, 0.0])], "key string, label int, vec array<double>")
    own = spark.createDataFrame([(7, "e", [1.0, 0.0])], "query int, key string, vec array<double>")
    assert rows(vectors.search(near, own, 3), "rank", "label", "score") == [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)]
    rng = np.random.default_rng(123)
    many = spark.createDataFrame([("e", str(i), v.tolist()) for i, v in enumerate(rng.standard_normal((500, 32)))], "key string, label string, vec array<double>")
    own = many.limit(50).select(F.col("label").alias("query"), "key", "vec")
    assert vectors.search(many, own, 1, "l2").where("query = label").count() == 50
    with pytest.raises(ValueError, match="metric"):
        vectors.search(many, own, 1, "dot")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_indexed_search_finds_neighbours(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "PER_CELL", 50)
    rng = np.random.default_rng(123)
    x = rng.standard_normal((2000, 32))
    state = spark.createDataFrame([("e", i, v.tolist()) for i, v in enumerate(x)], "key string, label long, vec array<double>")
    asked = state.where("label % 20 = 0").select(F.col("label").alias("query"), "key", "vec")
    found = vectors.search_indexed(state, asked, 1, metric)
    assert found.where("query = label").count() >= 95
    exact, every = (rows(df, "query", "rank", "label") for df in (vectors.search(state, asked, 5, metric), vectors.search_indexed(state, asked, 5, metric, probes=1000)))
    assert exact == every


def test_command_table(spark):
    table = commands.table(spark)
    log = spark.createDataFrame([(1, ["GET", "a"]), (2, ["get"]), (3, ["MSET", "a", "1", "b", "2"]), (4, ["mset", "a", "1", "b"]), (5, ["nope"]), (6, ["DBSIZE"]), (7, ["PING"])], "seq long, argv array<string>")
    got = {r["seq"]: (r["keys"], r["error"]) for r in commands.checked(log, table).collect()}
    assert got == {1: (["a"], None), 2: (None, "wrong number of arguments"), 3: (["a", "b"], None), 4: (None, "wrong number of arguments"), 5: (None, "unknown command"), 6: ([], None), 7: (None, "unknown command")}


def test_framing():
    assert list(oplog.parse(b"*3\r\n$3\r\nSET\r\n$3\r\nfoo\r\n$3\r\nbar\r\n")) == [[b"SET", b"foo", b"bar"]]
    assert list(oplog.parse(b"PING\r\n*1\r\n$4\r\nPING\r\n")) == [[b"PING"], [b"PING"]]
    assert list(oplog.parse(b"*2\r\n$3\r\nGET\r\n$3\r\nfo")) == []
    assert list(oplog.parse(b"*2\r\n$6\r\na\r\n\r\nb\r\n$0\r\n\r\n")) == [[b"a\r\n\r\nb", b""]]
    for bad in (b"*2\r\nGET\r\n", b"*x\r\n", b"*1\r\n$2\r\nabc\r\n", b"*9999999\r\n", b"x" * 70_000):
        with pytest.raises(oplog.FramingError):
            list(oplog.parse(bad))


def test_log_and_snapshot_round_trip(spark):
    path = tempfile.mkdtemp(prefix="spark-log-")
    binary = bytes(range(256)) + b"\r\n*1\r\n"
    words = [[b"SET", b"k", "é\r\nx".encode()], [b"DEL", b"k"], [b"APPEND", b"k", b""], [b"SET", b"raw", binary]]
    log = spark.createDataFrame([(10 * i, w) for i, w in enumerate(words)], "seq long, argv array<binary>").repartition(3)
    oplog.write_log(log, f"{path}/log")
    assert [(r["seq"], [bytes(w) for w in r["argv"]]) for r in oplog.read_log(spark, f"{path}/log").orderBy("seq").collect()] == [(10 * i, w) for i, w in enumerate(words)]
    state = spark.createDataFrame([("a", "1", None), ("b", "2", 5)], "key string, value string, deadline_ms long")
    oplog.write_snapshot(state, f"{path}/snapshot")
    assert rows(oplog.read_snapshot(spark, f"{path}/snapshot", 10), "key") == [("a",)]


def test_a_large_log_file_is_read_in_pieces(spark):
    """One file of many splits: its commands come in order and whole."""
    path = tempfile.mkdtemp(prefix="spark-log-")
    rng = np.random.default_rng(3)
    values = [bytes(rng.integers(0, 14, int(n), dtype=np.uint8)) for n in rng.integers(0, 4000, 300)]
    with open(f"{path}/log", "wb") as f:
        for i, v in enumerate(values):
            f.write(b"*3\r\n$3\r\nSET\r\n$%d\r\n%d\r\n$%d\r\n%s\r\n" % (len(str(i)), i, len(v), v))
        f.write(b"*2\r\n$3\r\nDEL\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        got = {r["line"]: [bytes(w) for w in r["argv"]] for r in oplog.read_log(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: [b"SET", str(i).encode(), v] for i, v in enumerate(values)}


def test_commands_to_log(spark):
    log = spark.createDataFrame([(1, ["SET", "a", "5"]), (2, ["incr", "a"]), (3, ["DECRBY", "a", "3"]), (4, ["DECRBY", "a", "-4"]), (5, ["SET", "b", "x"]), (6, ["DEL", "c", "d"]), (7, ["FLUSHDB"]), (8, ["GET", "a"]), (9, ["INCRBY", "a"])], "seq long, argv array<string>")
    got = rows(fold.commands_to_log(log), "seq", "op", "key", "arg")
    assert got == [(1, "set", "a", 5), (2, "incrby", "a", 1), (3, "incrby", "a", -3), (4, "incrby", "a", 4), (6, "del", "c", None), (6, "del", "d", None), (7, "flush", None, None)]


def test_replay_of_all_types(spark):
    log = [["SET", "a", "5"], ["INCR", "a"], ["DECRBY", "a", "2"], ["MSET", "b", "x", "c", "1"], ["del", "c"], ["INCRBY", "c", "7"], ["HSET", "h", "f", "1", "g", "2"], ["HINCRBY", "h", "f", "4"], ["HDEL", "h", "g"],
           ["SADD", "s", "m", "n", "m"], ["SREM", "s", "n", "o"], ["ZADD", "z", "1", "p", "2", "q"], ["ZINCRBY", "z", "0.5", "p"], ["ZREM", "z", "q"], ["ZINCRBY", "z", "3", "q"], ["RPUSH", "l", "1", "2", "3"], ["LPUSH", "l", "0", "-1"],
           ["RPOP", "l"], ["LPOP", "l", "2"], ["PFADD", "p", "e1", "e2"], ["SETEX", "d", "9", "v"], ["GET", "a"], ["HSET", "h"], ["LPOP", "none", "3"]]
    df = spark.createDataFrame(list(enumerate(log)), "seq long, argv array<string>")
    got = {name: rows(t) for name, t in replay.replay(df.repartition(3), tempfile.mkdtemp(prefix="spark-ops-") + "/ops").items() if name != "sketches"}
    assert got == {"strings": [("a", "4"), ("b", "x"), ("c", "7"), ("d", "v")], "hashes": [("h", "f", "5")], "sets": [("s", "m")],
                   "zsets": [("z", "p", 1.5), ("z", "q", 3.0)], "lists": [("l", 0, "1"), ("l", 1, "2")]}
    assert replay.replay(df)["sketches"].count() == 2
    flushed = spark.createDataFrame([*enumerate(log), (99, ["FLUSHALL"]), (100, ["SET", "a", "1"])], df.schema)
    assert {name: t.count() for name, t in replay.replay(flushed).items()} == {"strings": 1, "hashes": 0, "sets": 0, "zsets": 0, "lists": 0, "sketches": 0}


def test_del_and_flush_after_a_snapshot(spark):
    log = spark.createDataFrame([(1, "a", "set", 5), (2, "b", "incrby", 2), (3, "c", "set", 1), (4, "a", "incrby", 1), (5, "b", "del", None), (6, "b", "incrby", 7)], "seq long, key string, op string, arg long")
    held = fold.fold_log(log.where("seq <= 3"))
    assert rows(fold.snapshot_and_log(held, log), "key", "value") == rows(fold.fold_log(log), "key", "value") == [("a", 6), ("b", 7), ("c", 1)]
    flushed = log.unionByName(spark.createDataFrame([(7, None, "flush", None), (8, "c", "incrby", 4)], log.schema))
    assert rows(fold.snapshot_and_log(held, flushed), "key", "value") == rows(fold.fold_log(flushed), "key", "value") == [("c", 4)]


def test_expiry_in_order(spark):
    """A later request counts, a time of nothing ends a key, an expired key isn't there."""
    state = spark.createDataFrame([("a", "v", None), ("b", "v", 5000), ("gone", "v", 10), ("k", "v", None)], "key string, value string, deadline_ms long")
    asked = spark.createDataFrame([(1, "a", 100_000), (2, "a", 1000), (3, "b", 0), (4, "b", 9000), (5, "gone", 9000), (6, "none", 5)], "seq long, key string, ttl_ms long")
    got = {r["key"]: r["deadline_ms"] for r in generic.expire(state, asked, 1000).collect()}
    assert got == {"a": 2000, "b": 1000, "k": None}
    assert {r["seq"]: r["reply"] for r in generic.expire_replies(state, asked, 1000).collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}
    log = spark.createDataFrame([(1, "gone", "new"), (2, "b", "new")], "seq long, key string, value string")
    kept = {r["key"]: (r["value"], r["deadline_ms"]) for r in strings.set_keeping_ttl(log, state, True, 1000).collect()}
    assert kept == {"a": ("v", None), "b": ("new", 5000), "gone": ("new", None), "k": ("v", None)}
    assert rows(generic.keys_of(1000, string=state), "key") == [("a",), ("b",), ("k",)]


def plain_set(log, state, now):
    held = {k: (v, d) for k, v, d in state if d is None or d > now}
    for _, key, value, only, keep, in_ms, at_ms in sorted(log, key=lambda r: r[0]):
        if (in_ms is not None and in_ms <= 0) or (at_ms is not None and at_ms <= 0):
            continue
        if (only == "nx" and key in held) or (only == "xx" and key not in held):
            continue
        deadline = at_ms if at_ms is not None else now + in_ms if in_ms is not None else held.get(key, (None, None))[1] if keep else None
        held[key] = (value, deadline)
    return held


def test_set_with_all_options(spark):
    rng = np.random.default_rng(11)
    keys = [f"k{i}" for i in range(12)]
    state = [(k, "old", None if i % 3 else 500 + i * 300) for i, k in enumerate(keys[:8])]
    pick = lambda *xs: xs[rng.integers(len(xs))]
    log = [(n, pick(*keys), f"v{n}", pick(None, None, "nx", "xx"), pick(True, False, None), pick(None, None, 5000, 0), pick(None, None, None, 90_000)) for n in range(60)]
    df = spark.createDataFrame(log, "seq long, key string, value string, only string, keep boolean, in_ms long, at_ms long")
    got = strings.set_with_options(df, spark.createDataFrame(state, "key string, value string, deadline_ms long"), 1000)
    assert {r["key"]: (r["value"], r["deadline_ms"]) for r in got.collect()} == plain_set(log, state, 1000)


@pytest.mark.parametrize("only", [None, "new", "old"])
@pytest.mark.parametrize("toward", [None, "up", "down"])
@pytest.mark.parametrize("incr", [False, True])
def test_zadd_options_one_by_one(spark, only, toward, incr):
    rng = np.random.default_rng(12)
    state = {("z", f"m{i}"): float(i) for i in range(4)}
    log = [(n, "z", f"m{rng.integers(7)}", float(rng.integers(-5, 6))) for n in range(40)]
    df = spark.createDataFrame(log, "seq long, key string, member string, score double")
    held = spark.createDataFrame([(*k, v) for k, v in state.items()], "key string, member string, score double")
    if only == "new" and toward:
        with pytest.raises(ValueError, match="options"):
            zsets.update(df, held, only, toward, incr)
        return
    for _, key, member, score in log:
        now = state.get((key, member))
        new = score + (now or 0.0) if incr else score
        if now is None:
            if only != "old":
                state[key, member] = new
        elif only != "new" and not (toward == "up" and new <= now) and not (toward == "down" and new >= now):
            state[key, member] = new
    assert {(r["key"], r["member"]): r["score"] for r in zsets.update(df, held, only, toward, incr).collect()} == state


def test_a_line_feed_at_the_end_counts(spark):
    df = spark.createDataFrame([("12\n",), ("abc\n",), ("12",), ("1.5\n",)], "t string")
    assert df.where(glob(F.col("t"), "a*c")).count() == 0 and df.where(glob(F.col("t"), "a*c?")).count() == 1
    assert [r[0] for r in df.select(parse_int(F.col("t"))).collect()] == [None, None, 12, None]
    assert [r[0] for r in df.select(parse_double(F.col("t"))).collect()] == [None, None, 12.0, None]


def test_replay(spark):
    log = spark.createDataFrame([(1, "l", "rpush", "a"), (2, "l", "lpush", "b"), (3, "l", "rpop", None), (4, "l", "rpush", "c"), (5, "m", "lpop", None), (6, "m", "rpush", "d"), (7, "m", "del", None)], "seq long, key string, op string, arg string")
    assert rows(fold.replay_lists(log)) == [("l", 0, "b"), ("l", 1, "c")]


@pytest.mark.parametrize("whole", [1_000_000, 0])
def test_replay_is_that_of_a_deque_and_holds_no_key(spark, monkeypatch, whole):
    monkeypatch.setattr(ordered, "WHOLE_ROWS", whole)
    rng = np.random.default_rng(5)
    log = [(i, str(rng.choice(["hot", "hot", "a", "b", "c"])), str(rng.choice(["rpush", "lpush", "rpop", "lpop", "other", "del"], p=[0.27, 0.27, 0.22, 0.22, 0.015, 0.005])), None if i % 50 == 0 else str(i)) for i in range(4000)]
    kept = {}
    for _, k, op, arg in log:
        items = kept.setdefault(k, deque())
        if op in ("rpush", "lpush"):
            (items.append if op == "rpush" else items.appendleft)(arg)
        elif op in ("rpop", "lpop") and items:
            (items.pop if op == "rpop" else items.popleft)()
        elif op == "del":
            items.clear()
    got = fold.replay_lists(spark.createDataFrame([*log, (9, None, "rpush", "x")], "seq long, key string, op string, arg string").repartition(3))
    assert sorted(rows_of(got), key=lambda r: r[:2]) == sorted(((k, i, v) for k, items in kept.items() for i, v in enumerate(items)), key=lambda r: r[:2])
    assert "MapInArrow" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("whole", [1_000_000, 0])
def test_percentiles_hold_no_group(spark, monkeypatch, whole):
    monkeypatch.setattr(ordered, "WHOLE_ROWS", whole)
    rng = np.random.default_rng(6)
    ops = [(str(k), float(v)) for k, v in zip(rng.choice(["a", "a", "a", "b"], 3000), rng.integers(0, 900, 3000) / 7, strict=True)] + [("a", 5.0)] * 500 + [("one", 3.0), (None, 1.0), (None, 2.0), ("none", None), ("a", None)]
    df = spark.createDataFrame(ops, "kind string, micros double")
    got = metrics.percentiles(df, "kind")
    values = {k: [v for x, v in ops if x == k and v is not None] for k, _ in ops}
    want = {k: (*np.percentile(v, [50, 90, 99]), np.mean(v)) if v else (None,) * 4 for k, v in values.items()}
    for r in got.collect():
        mine = want.pop(r.kind)
        assert tuple(r)[1:] == (mine if None in mine else pytest.approx(mine, abs=2e-6))
    assert not want
    assert "percentile(" not in got._jdf.queryExecution().toString()


def test_fold_of_empty_log(spark):
    log = spark.createDataFrame([], "seq long, key string, op string, arg long")
    assert fold.fold_counters(log).count() == 0
    assert fold.barrier(log).count() == 0


def test_streams(spark):
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(f"{folder}/in")
    stream = lambda: jobs.read_events(spark, f"{folder}/in", batch.schema)
    counted = jobs.drain(jobs.counters(stream()), "complete", "counters", f"{folder}/c1")
    assert rows(counted, "user_id", "n_ops") == rows(batch.groupBy("user_id").agg(F.count("*").alias("n_ops")), "user_id", "n_ops")
    windows = jobs.drain(jobs.windowed_rates(stream()), "complete", "windows", f"{folder}/c2")
    assert windows.agg(F.sum("n_ops")).first()[0] == batch.count()
    kept = jobs.drain(jobs.expiring_counters(stream(), "3650 days"), "update", "expiring", f"{folder}/c3")
    assert kept.where("not expired").groupBy("user_id").agg(F.max("n_ops").alias("n")).agg(F.sum("n")).first()[0] == batch.count()


@pytest.mark.parametrize("whole_rows", [0, 1000])
def test_order_within_slices(spark, monkeypatch, whole_rows):
    from keyloom.functions import ordered

    monkeypatch.setattr(ordered, "WHOLE_ROWS", whole_rows)
    monkeypatch.setattr(ordered, "SLICES", 5)
    monkeypatch.setattr(ordered, "CUTS", 3)
    log = spark.range(200).select((F.col("id") * F.col("id") - 50).alias("seq"), F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("key"),
                                  F.when(F.col("id") % 4 > 0, F.col("id")).alias("value"))
    plain = {}
    for seq, key, value in sorted((r["seq"], r["key"], r["value"]) for r in log.collect()):
        plain.setdefault(key, []).append((seq, value))
    sums, before, places, left = set(), set(), set(), set()
    for key, own in plain.items():
        for i, (seq, value) in enumerate(own):
            heard = [v for _, v in own[: i + 1] if v is not None]
            sums.add((key, seq, sum(heard) if heard else None))
            before.add((key, seq, own[i - 1][1] if i else None))
            places.add((key, i, value))
            left.add((key, len(own) - 1 - i, value))
    assert set(rows_of(strings.running(log, F.col("value")), "key", "seq", "running")) == sums
    assert set(rows_of(strings.get_set(log), "key", "seq", "previous")) == before
    assert set(rows_of(lists.push(log), "key", "pos", "value")) == places
    assert set(rows_of(lists.push(log, left=True), "key", "pos", "value")) == left
    state = log.select("key", F.col("seq").cast("string").alias("member"), (F.abs(F.col("seq")) % 7).cast("double").alias("score"))
    ranks = {}
    for key, member, score in rows_of(state, "key", "member", "score"):
        ranks.setdefault(key, []).append((score, member))
    assert set(rows_of(zsets.rank(state))) == {(k, m, i) for k, own in ranks.items() for i, (_, m) in enumerate(sorted(own))}


def test_order_of_empty_tables(spark):
    log = spark.createDataFrame([], "seq long, key string, value long")
    assert strings.running(log, F.col("value")).count() == strings.get_set(log).count() == lists.push(log).count() == 0
    assert zsets.rank(spark.createDataFrame([], "key string, member string, score double")).count() == 0


def test_slices_from_the_back(spark):
    state = spark.createDataFrame([("a", i, f"v{i}") for i in range(5)] + [("b", 7, "w")], "key string, pos long, value string")
    assert rows(lists.slices(state, -2, -1)) == [("a", 3, "v3"), ("a", 4, "v4"), ("b", 0, "w")]
    assert rows(lists.slices(state, -9, -4)) == [("a", 0, "v0"), ("a", 1, "v1")]
    assert rows(lists.slices(state, -1, -2)) == []
    assert rows(lists.element(state, -2)) == [("a", "v3"), ("b", None)]
    popped, rest = lists.pop(state, 4)
    assert (popped.count(), rows(rest)) == (5, [("a", 4, "v4")])
    scored = state.select("key", F.col("value").alias("member"), F.col("pos").cast("double").alias("score"))
    assert rows(zsets.by_rank(scored, -2, -1), "key", "rank", "member") == [("a", 3, "v3"), ("a", 4, "v4"), ("b", 0, "w")]
    assert rows(zsets.by_rank(scored, -2, -2, reverse=True), "key", "rank", "member") == [("a", 3, "v1")]
    assert rows(zsets.by_rank(scored, -1, -2)) == []


def test_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    state = spark.createDataFrame([("k" if i % 5 else "l", i, rng.standard_normal(4).tolist()) for i in range(300)], "key string, label long, vec array<double>")
    asked = state.where("label % 2 = 0").select(F.col("label").alias("query"), "key", "vec")
    whole = rows(vectors.search(state, asked, 3))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 10)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(vectors, "VECTOR_SLICE", 7)
    assert rows(vectors.search(state, asked, 3)) == whole and len(whole) == 450


@pytest.mark.parametrize("whole_rows", [0, 1_000_000])
def test_slices_and_ranks_from_both_ends(spark, monkeypatch, whole_rows):
    monkeypatch.setattr(ordered, "WHOLE_ROWS", whole_rows)
    state = spark.createDataFrame([("a", 3 * i, f"v{i}") for i in range(20)] + [("b", 7, "w")], "key string, pos long, value string")
    assert rows(lists.slices(state, 1, -3)) == [("a", i, f"v{i}") for i in range(1, 18)]
    assert rows(lists.slices(state, -19, 1)) == [("a", 1, "v1"), ("b", 0, "w")]
    assert [r["value"] for r in lists.set_element(state, -2, "new").where("pos = 54").collect()] == ["new"]
    assert rows(lists.set_element(state, 1, "new").where("value = 'new'"), "key", "pos") == [("a", 3)]
    scored = state.select("key", F.col("value").alias("member"), F.floor(F.col("pos") / 6).cast("double").alias("score"))
    order = [r["member"] for r in scored.where("key = 'a'").orderBy("score", "member").collect()]
    assert rows(zsets.by_rank(scored, 2, -2).where("key = 'a'"), "rank", "member") == [(i, order[i]) for i in range(2, 19)]
    assert rows(zsets.by_rank(scored, 2, -2, reverse=True).where("key = 'a'"), "rank", "member") == [(i, order[::-1][i]) for i in range(2, 19)]


def test_exposition_lines(spark):
    samples = spark.createDataFrame([("keys", 'shard="0"', 3.0), ("s", "", 1.25)], "name string, label string, value double")
    assert rows(metrics.exposition_line(samples)) == [('keys{shard="0"} 3',), ("s 1.250000",)]


def test_sessions(spark):
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    batch = spark.createDataFrame([(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 20, 50)] + [(1, "2024-01-01 03:00:00"), (2, "2024-01-01 03:00:00")], "user_id int, ts string")
    batch.write.parquet(f"{folder}/in")
    found = jobs.drain(jobs.sessions(jobs.read_events(spark, f"{folder}/in", batch.schema)), "complete", "sessions", f"{folder}/c")
    assert rows(found.select("user_id", F.date_format("start", "HH:mm").alias("start"), "n_ops")) == [(1, "00:00", 3), (1, "03:00", 1), (2, "03:00", 1)]


def test_checked_totals_of_amounts_beyond_64_bits(spark):
    """Single amounts and sums on the way may be wider than the total."""
    log = spark.createDataFrame([("a", 93_000), ("b", 9_000_000_000_000_000_000), ("b", 9_000_000_000_000_000_000), ("b", -9_000_000_000_000_000_000), ("c", None)], "key string, seq long")
    assert rows(strings.increase_checked(log, F.col("seq")), "key", "total") == [("a", 93_000), ("b", 9_000_000_000_000_000_000), ("c", None)]
    assert rows(strings.increase_checked(log, F.col("seq").cast("decimal(19,0)") * F.lit(100_000_000_000_000)), "key", "total") == [("a", None), ("b", None), ("c", None)]


def test_checked_increments_of_high_numbers(spark, tmp_path):
    """The query over event numbers whose amounts don't fit 64 bits one by one."""
    from keyloom.plans.catalogue import ORACLE_SQL, QUERIES

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_id", F.col("event_id") * 100).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert_same(QUERIES["incrby_overflow"](spark, str(tmp_path)), con, ORACLE_SQL["incrby_overflow"])


def test_doubles_that_are_no_numbers(spark):
    """nan is read as strtod does, so that a double's own text always gives it back."""
    values = [math.nan, math.inf, -math.inf, -0.0, 5e-324, 1.7976931348623157e308, 2e23, 0.1, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(parse_double(F.col("v").cast("string"))).collect()]
    assert list(map(repr, got)) == list(map(repr, values))
    texts = spark.createDataFrame([("nan",), ("-NaN",), (" nan",), ("nano",), ("nan\n",)], "t string")
    assert list(map(repr, [r[0] for r in texts.select(parse_double(F.col("t"))).collect()])) == ["nan", "nan", "None", "None", "None"]


def test_parsed_doubles_of_a_table_with_nan(spark, tmp_path):
    from keyloom.plans.catalogue import ORACLE_SQL, QUERIES

    value = F.when(F.col("event_id") % 3 == 0, F.lit(math.nan)).otherwise(F.col("value"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("value", value).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert_same(QUERIES["parse_doubles"](spark, str(tmp_path)), con, ORACLE_SQL["parse_doubles"])


@pytest.mark.parametrize(("small", "split"), [(4 << 20, None), (0, 50_000), (300, 2_000)])
def test_small_and_large_log_files_are_read_alike(spark, monkeypatch, small, split):
    """Files parsed where they are read, files of many splits, compressed ones, and all of them in one log."""
    monkeypatch.setattr(files, "SMALL", small)
    path = tempfile.mkdtemp(prefix="spark-log-")
    rng = np.random.default_rng(5)
    made = {}
    for name, n in (("a.txt", 3), ("b.txt", 200), ("c.gz", 40), ("d.txt", 0)):
        values = [b"\r\n@seq 7\r\n*1\r\n$4\r\nPING" * int(k % 3) + bytes(rng.integers(0, 256, int(k), dtype=np.uint8)) for k in rng.integers(0, 900, n)]
        data = b"".join(b"@seq %d\r\n*2\r\n$3\r\nSET\r\n$%d\r\n%s\r\n" % (10 * i, len(v), v) for i, v in enumerate(values)) + b"*2\r\n$3\r\nDEL\r\n"
        with open(f"{path}/{name}", "wb") as f:
            f.write(gzip.compress(data) if name.endswith("gz") else data)
        made.update({(name, i): (10 * i, [b"SET", v]) for i, v in enumerate(values)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): (r["seq"], [bytes(w) for w in r["argv"]]) for r in oplog.read_log(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == made


def test_written_log_files_stay_small(spark, monkeypatch):
    """However long a log is, a file holds a bounded number of commands and none of them needs a sort to be read."""
    monkeypatch.setattr(oplog, "FILE_COMMANDS", 5)
    path = tempfile.mkdtemp(prefix="spark-log-") + "/log"
    oplog.write_log(spark.range(43).select(F.col("id").alias("seq"), F.array(F.lit("SET"), F.lit("k"), F.lit("\r\n")).alias("argv")), path)
    got = oplog.read_log(spark, path)
    assert max(r["count"] for r in got.groupBy("file").count().collect()) <= 5
    assert sorted(r["seq"] for r in got.collect()) == list(range(43))
    assert files.small_files(spark, path).count() >= 9 and files.ordered_pieces(spark, path, "\r\n", above=True).count() == 0


def test_replay_from_files_parses_the_log_once(spark):
    """The fold reads its rows several times, from a table and not from the log."""
    from keyloom.plans.catalogue import QUERIES

    plan = QUERIES["replay_from_files"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "op#" in plan


def test_replay_with_a_folder_reads_the_commands_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    log = spark.createDataFrame([(i, ["SET", f"k{i % 5}", "v"]) for i in range(40)] + [(40, ["DEL", "k1"])], "seq long, argv array<string>").repartition(2)
    tables = replay.replay(log.mapInArrow(counted, log.schema), tempfile.mkdtemp(prefix="spark-ops-") + "/ops")
    assert {name: t.count() for name, t in tables.items()} == {"strings": 4, "hashes": 0, "sets": 0, "zsets": 0, "lists": 0, "sketches": 0}
    assert read.value == 41
