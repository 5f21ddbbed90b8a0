"""Every registered query of the keyed-value operators against its SQL."""

from collections import Counter, defaultdict, deque

import pytest
import xxhash
from compare import assert_same, connect

from keyloom.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def test_the_others_have_plain_versions():
    assert set(QUERIES) - set(ORACLE_SQL) == {"shard_balance_hashed", "command_table", "replay_lists", "vsim_indexed"}


def test_shard_balance_hashed(spark):
    users = spark.read.parquet(f"{SF}/events.parquet").toPandas().user_id
    shards = Counter(((h := xxhash.xxh64_intdigest(f"user:{u}", 42)) - (h >> 63 << 64)) % 16 for u in users)
    got = {r.shard: (r.n_ops, r.share) for r in QUERIES["shard_balance_hashed"](spark, SF).collect()}
    assert got == {s: (n, round(n / len(users), 6)) for s, n in shards.items()}


def test_command_table(spark):
    got = {r.name: tuple(r)[1:] for r in QUERIES["command_table"](spark, SF).collect()}
    assert len(got) == 78 and got["mset"] == (-3, "string", True, 1, -1, 2) and got["object"] == (-2, "generic", False, 2, 2, 1)
    assert Counter(v[1] for v in got.values()) == {"string": 17, "generic": 16, "hash": 11, "list": 8, "set": 6, "zset": 8, "sketch": 3, "vector": 4, "server": 5}


def test_replay_lists(spark):
    kept = defaultdict(deque)
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect():
        items, n = kept[f"user:{r.user_id}"], r.event_id
        if n % 5 == 0:
            items.appendleft(str(n))
        elif n % 5 in (1, 2):
            if items:
                items.popleft() if n % 5 == 1 else items.pop()
        else:
            items.append(str(n))
    got = sorted(tuple(r) for r in QUERIES["replay_lists"](spark, SF).select("key", "pos", "value").collect())
    assert got == sorted((k, i, v) for k, items in kept.items() for i, v in enumerate(items))


def test_indexed_search(spark):
    """At least 0.95 of the exact neighbours, on a table with more than one cell a key."""
    key = ["query", "label"]
    exact, found = (QUERIES[n](spark, "/root/testdata/sf0.01").select(*key) for n in ("vsim_cosine", "vsim_indexed"))
    assert found.count() == exact.count() and found.join(exact, key).count() >= 0.95 * exact.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_prefix_reaches_scan(spark):
    from pyspark.sql import functions as F

    from keyloom.functions.keys import glob

    plan = spark.read.parquet(f"{SF}/customer.parquet").where(glob(F.col("c_name"), "Customer#00*"))._jdf.queryExecution().toString()
    assert "StringStartsWith" in plan


def test_top_ranks_are_limited_before_the_shuffle(spark):
    plan = QUERIES["zrange_top10"](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
