"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments, so of two fingerprints that differ in at
most four bits some segment differs in at most one. For each segment and each of its bits the
segment with that bit wildcarded is a signature (64 in all). Equal signatures bring candidates
together; every candidate pair is verified on its whole fingerprint before it becomes a link.

Copies collapse to one fingerprint before any signature is made. Inside one signature bucket a
task emits a spanning forest of the verified links, never all pairs. A bucket above
``BUCKET_LIMIT`` is not compared in one task: its fingerprints get finer signatures, each of the 64
with one of five pieces of the other bits, of which one is the same in both of a linked pair. So buckets
stay below the limit up to some 10^12 fingerprints. Where even a finer bucket is above it, fingerprints go
to an exact linear way, where
each emits every value within two flips; two fingerprints are within four bits of each other
exactly if they share such a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, LongType

from .common import written
from .components import connected_components

BITS = 64
MAX_DISTANCE = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SHINGLE = 4
SEED = 42
#: Fingerprints of one bucket that a task compares; larger buckets take the linear way.
BUCKET_LIMIT = 4096
_SMALL = 8
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text; 0 for null or no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: len(words) - SHINGLE])).tolist()
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = np.array(hashes[at : at + _BLOCK], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64), dtype="int64")


def signatures(fp: str = "fp"):
    """The 64 one-wildcard segment variants of a fingerprint column, as an int array."""
    out = []
    for offset, width in SEGMENTS:
        segment = F.shiftrightunsigned(F.col(fp), offset).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            kept = segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            out.append((F.lit((offset + bit) << 22) + kept).cast("int"))
    return F.array(*out)


#: Widths of the pieces that the 43 bits outside a segment are cut into.
PIECES = (9, 9, 9, 8, 8)


def finer_signatures(fp: str = "fp"):
    """Every signature with each piece of the bits outside its segment, as a long array.

    A linked pair that agrees in a signature differs in at most four of those bits, so one of five pieces is the same.
    """
    out = []
    for (offset, width), own in zip(SEGMENTS, (range(0, 21), range(21, 42), range(42, 64)), strict=True):
        below = F.col(fp).bitwiseAND(F.lit((1 << offset) - 1))
        rest = below.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(fp), offset + width), offset)) if offset + width < BITS else below
        at = 0
        for number, bits in enumerate(PIECES):
            piece = F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << bits) - 1))
            at += bits
            out += [F.shiftleft(F.get(F.col("__keyloom_signatures"), F.lit(k)).cast("long"), 12) + F.lit(number << 9) + piece for k in own]
    return F.array(*out)


def _forest(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among ``values`` (uint64, distinct)."""
    out, rest = [], values
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            near = np.bitwise_count(rest ^ u) <= MAX_DISTANCE
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), u), found))
                queue.extend(found)
                rest = rest[~near]
    return out


def _links(keys: np.ndarray, fps: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of whole buckets; ``keys`` sorted. A pair (x, x) marks a member of a bucket above ``limit``."""
    out = []
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    of = np.repeat(sizes, sizes)
    small = of <= _SMALL
    k, f = keys[small], fps[small]
    for d in range(1, _SMALL):
        if len(k) > d:
            hit = (k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= MAX_DISTANCE)
            out.append((f[:-d][hit], f[d:][hit]))
    for at, n in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
        run = fps[at : at + n]
        out += [(run, run)] if n > limit else _forest(run)
    return out


def bucket_links(limit: int = BUCKET_LIMIT):
    """For mapInArrow over rows (key, fp) sorted by key; holds one batch and one open bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, spilled = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def batch_of(pairs):
            a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.uint64)
            b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.uint64)
            if len(a):
                both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
                a, b = both[:, 0], both[:, 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            k = batch.column(0).to_numpy()
            f = batch.column(1).to_numpy().view(np.uint64)
            if spilled is not None:
                n = int(np.searchsorted(k, spilled, side="right"))
                if n:
                    yield batch_of([(f[:n], f[:n])])
                    k, f = k[n:], f[n:]
                if len(k):
                    spilled = None
            if not len(k):
                continue
            k, f = np.concatenate((held_k, k)), np.concatenate((held_f, f))
            at = int(np.searchsorted(k, k[-1], side="left"))
            yield batch_of(_links(k[:at], f[:at], limit) if at else [])
            held_k, held_f = k[at:].copy(), f[at:].copy()
            if len(held_k) > limit:
                yield batch_of([(held_f, held_f)])
                spilled, held_k, held_f = held_k[0], held_k[:0], held_f[:0]
        if len(held_k):
            yield batch_of(_links(held_k, held_f, limit))

    return run


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint with all the values within two flips of it."""
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    i, j = np.triu_indices(BITS, 1)
    masks = np.concatenate((np.zeros(1, np.uint64), one, one[i] | one[j]))
    for batch in batches:
        f = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(f), 64):
            part = f[at : at + 64]
            points = (part[:, None] ^ masks[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(masks)).view(np.int64)), pa.array(points.view(np.int64))], ["fp", "point"])


def fingerprint_links(fps: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``fps(fp long)``, distinct, to links (a, b): a graph with the components of all pairs
    within MAX_DISTANCE bits, every link of it verified."""
    met = lambda keyed: written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_links(bucket_limit), "a long, b long"), "links")
    marked = lambda found: found.where("a = b").select(F.col("a").alias("fp")).distinct()
    found = met(fps.select(F.explode(signatures()).alias("key"), "fp"))
    links, large = found.where("a != b"), marked(found)
    if large.isEmpty():
        return links
    signed = large.withColumn("__keyloom_signatures", signatures())
    finer = met(signed.select(F.explode(finer_signatures()).alias("key"), "fp"))
    # at most 2081 distinct fingerprints share a point, so this window's groups are bounded
    ball = marked(finer).mapInArrow(_ball, "fp long, point long")
    hubs = ball.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("point")).alias("b"))
    return links.unionByName(finer.where("a != b")).unionByName(hubs.where("a != b"))


def _rooted(docs: DataFrame, id_col: str, text_col: str, bucket_limit: int) -> tuple[DataFrame, DataFrame]:
    """Written tables of ``docs``: rows (id, fp), and fingerprints (fp, low, root) with their smallest id."""
    rows = written(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("fp")), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("id").alias("low"))
    parts = connected_components(fingerprint_links(fps.select("fp"), bucket_limit))
    rooted = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return rows, written(rooted, "rooted")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Near-duplicate components: (id, fingerprint, component_id) for each row of ``docs``.

    fingerprint: 16 lower-case hex digits. component_id: the smallest id reachable over links.
    Null and empty texts have fingerprint zero, linked like any other. Repeated rows come out
    as often as they went in. A row with a null id takes its component's smallest id (null if
    the component has none). An empty table gives an empty result; other columns are not read.
    """
    rows, rooted = _rooted(docs, id_col, text_col, bucket_limit)
    # as tables of known size both sides are dealt for the join alone, so that Spark can split a large group
    lows = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    of = rooted.join(lows, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Keep exactly one row of each component, with all columns of ``docs``.

    It is the row of the smallest id, rows without an id last; where that id stands on more rows
    of the component, the one of the smallest fingerprint (as a signed number), then text hash,
    then other columns in their order. Components belong to rows and not to ids: an id that
    stands on texts of several components can stay on one row of each. Null, empty and very long
    texts are as in ``simhash_components``; an empty table gives an empty result.
    """
    rows, rooted = _rooted(docs, id_col, text_col, bucket_limit)
    first = F.min(F.struct(F.col("low").isNull().alias("unnamed"), F.col("low").alias("id"), "fp")).alias("first")
    chosen = rooted.groupBy("root").agg(first).select("root", "first.id", "first.fp")
    often = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id", F.lit(True).alias("often"))
    # an id on a single row names it; other rows are told apart by their fingerprints
    chosen = written(chosen.join(often, chosen["id"].eqNullSafe(often["id"]), "left").select(
        chosen["id"].alias("__keyloom_id"), F.col("fp").alias("__keyloom_fp"), F.col("root").alias("__keyloom_root"), F.coalesce("often", F.lit(False)).alias("often")), "chosen")
    single = docs.join(chosen.where("not often").select("__keyloom_id"), F.col(id_col) == F.col("__keyloom_id"), "left_semi")
    # written, so that Spark knows how few they are and fingerprints no others
    several = written(chosen.where("often").drop("often"), "several")
    same = F.col(id_col).eqNullSafe(F.col("__keyloom_id"))
    repeated = written(docs.join(several.select("__keyloom_id").distinct(), same, "left_semi"), "repeated")
    marked = repeated.withColumn("__keyloom_own", fingerprint_udf(F.col(text_col)))
    found = marked.join(several, same & (F.col("__keyloom_own") == F.col("__keyloom_fp")))
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
    # the limit of one row works within each task before anything is shuffled
    place = F.row_number().over(Window.partitionBy("__keyloom_root").orderBy(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), *others))
    one = found.withColumn("__keyloom_place", place).where(F.col("__keyloom_place") == 1)
    return single.unionByName(one.select(*[F.col(f"`{c}`") for c in docs.columns]))
