"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The listed URLs set bits in a filter of 256-bit blocks, one block and eight bits a key. The
filter grows with the list, so it is never fuller than designed. Up to ``MAX_BLOCKS`` rows it is
broadcast; a larger one is dealt by block, and so are the URLs. URLs that it
rules out are done; only possible hits go to an exact hash join with the list, which
removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Largest filter that is broadcast: 65,536 blocks of 256 bits, about 3 MB as rows.
MAX_BLOCKS = 1 << 16
BITS_PER_KEY = 16
WORDS = 4
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null or none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for a null or a URL without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands between host and ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without tracking parameters.

    Scheme and fragment go. A null or a URL without ``://`` gives an empty string, which never
    counts as listed.
    """
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.concat(
        F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""),
        F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")),
    )


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null where none does.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's.
    Of two equal rules the first counts.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(reversed(list(rules)), key=lambda r: len(r[0])):
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _key(name: str, blocks: int) -> list[Column]:
    """Block and bit masks of a string column."""
    block = F.pmod(F.xxhash64(F.col(name)), F.lit(blocks)).cast("int").alias("block")
    spread = f"xxhash64(`{name}`, 1)"
    bit = lambda i: f"shiftleft(1L, cast(shiftrightunsigned({spread}, {6 * i}) & 63 as int))"
    return [block, *[F.expr(f"{bit(2 * i)} | {bit(2 * i + 1)}").alias(f"m{i}") for i in range(WORDS)]]


def bloom_blocks(listed: DataFrame, name: str, blocks: int) -> DataFrame:
    """The filter: (block, w0..w3), a row for each block that has a bit."""
    keys = listed.select(*_key(name, blocks))
    return keys.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct canonical forms of a list of URLs, as a table (url)."""
    return written(urls.select(canonical(F.col(url_col)).alias("url")).where("url != ''").distinct(), "listed")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", max_blocks: int = MAX_BLOCKS, blocks: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, listed) for each row of ``pages``.

    ``listed``: distinct canonical URLs (url). verdict is the rule's, or else block for listed
    URLs and allow for others. Null and malformed URLs have empty host and path, fit no rule
    and are allowed. Repeated rows come out as often as they went in; very long URLs are used
    whole; with an empty list or empty pages everything is allowed or nothing returned. Other
    columns of ``pages`` are not read. ``blocks``: the filter's size, else by the list's.
    """
    if blocks is None:
        blocks, wanted = 1, listed.count() * BITS_PER_KEY
        while blocks * 64 * WORDS < wanted:
            blocks *= 2
    url = F.col("__keyloom_url")
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("__keyloom_url"))
    rows = rows.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("__keyloom_key"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict")).select("*", *_key("__keyloom_key", blocks))
    bloom = bloom_blocks(listed, "url", blocks)
    # at most max_blocks rows: a proven bound
    asked = rows.join(F.broadcast(bloom) if blocks <= max_blocks else written(bloom, "filter"), "block", "left")
    possible = F.coalesce((F.col("w0").bitwiseAND(F.col("m0")) == F.col("m0")) & (F.col("w1").bitwiseAND(F.col("m1")) == F.col("m1"))
                          & (F.col("w2").bitwiseAND(F.col("m2")) == F.col("m2")) & (F.col("w3").bitwiseAND(F.col("m3")) == F.col("m3")), F.lit(False))
    names = [id_col, "host", "path", "rule", "verdict"]
    # URLs are read and taken apart once; hits and others go on from here
    seen = written(asked.select(*names, F.when(possible, F.col("__keyloom_key")).alias("__keyloom_key")), "asked")
    clear = seen.where("__keyloom_key is null").select(*names, F.lit(False).alias("listed"))
    exact = listed.select(F.col("url").alias("__keyloom_key"), F.lit(True).alias("__keyloom_in"))
    hits = seen.where("__keyloom_key is not null").join(exact, "__keyloom_key", "left")
    hits = hits.select(*names, F.coalesce("__keyloom_in", F.lit(False)).alias("listed"))
    out = clear.unionByName(hits)
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")))
