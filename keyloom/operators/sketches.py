"""HyperLogLog: registers as rows (key, idx, reg), so adding and merging are grouped maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers: 2^14.
PRECISION = 14
REGISTERS = 1 << PRECISION
#: Bits of the hash: 60, of md5.
_TAIL = 60 - PRECISION


def hash60(element: Column) -> Column:
    return F.conv(F.substring(F.md5(element.cast("string")), 1, 15), 16, 10).cast("bigint")


def add(elements: DataFrame) -> DataFrame:
    """PFADD of (key, element): the registers that aren't zero."""
    h = hash60(F.col("element"))
    bits = F.bin(F.shiftrightunsigned(h, PRECISION))
    zeros = F.length(bits) - F.length(F.rtrim(bits, F.lit("0")))
    rank = F.when(F.shiftrightunsigned(h, PRECISION) == 0, F.lit(_TAIL + 1)).otherwise(zeros + 1)
    return elements.select("key", h.bitwiseAND(REGISTERS - 1).cast("int").alias("idx"), rank.cast("int").alias("rank")).groupBy("key", "idx").agg(F.max("rank").alias("reg"))


def changed(registers: DataFrame, added: DataFrame) -> DataFrame:
    """PFADD's reply: (key, reply) of each key of ``added``, registers that ``add`` made: 1 if it is new or one of its registers rose."""
    old = registers.select("key", "idx", F.col("reg").alias("old"))
    rose = F.coalesce(F.col("reg") > F.col("old"), F.lit(True))
    return added.join(old, ["key", "idx"], "left").groupBy("key").agg(F.max(rose.cast("int")).alias("reply"))


def merge(registers: DataFrame, into: str) -> DataFrame:
    """PFMERGE of all keys into one."""
    return registers.groupBy("idx").agg(F.max("reg").alias("reg")).select(F.lit(into).alias("key"), "idx", "reg")


def count(registers: DataFrame) -> DataFrame:
    """PFCOUNT of every key, with linear counting for small sets."""
    m = float(REGISTERS)
    alpha = 0.7213 / (1 + 1.079 / m)
    got = registers.groupBy("key").agg(F.count("*").alias("present"), F.sum(F.pow(F.lit(2.0), -F.col("reg"))).alias("inverse"))
    zeros = F.lit(m) - F.col("present")
    raw = F.lit(alpha * m * m) / (F.col("inverse") + zeros)
    estimate = F.when((raw <= 2.5 * m) & (zeros > 0), F.lit(m) * F.log(F.lit(m) / zeros)).otherwise(raw)
    return got.select("key", F.floor(estimate + 0.5).cast("bigint").alias("estimate"))


def approximate(elements: DataFrame) -> DataFrame:
    """The built-in sketch, in one aggregate: the fast path where registers aren't needed."""
    return elements.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("element")).alias("estimate"))
