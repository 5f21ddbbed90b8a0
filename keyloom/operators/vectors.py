"""Vector sets: (key, label, vec). Similarity search is exact, or over an index of cells.

Vectors and queries of one key (and cell) meet in blocks, where numpy takes all their products at once.
A query keeps its best in each block, so what leaves a task doesn't grow with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries that meet in a task at once, and vectors of a key that one task reads.
QUERY_BLOCK, VECTOR_BLOCK = 4_096, 65_536
#: Vectors whose products with a block of queries are held at once.
VECTOR_SLICE = 512
#: Vectors that the centres of an index are fitted on at most, and how many share a cell on average.
SAMPLE_ROWS, PER_CELL = 20_000, 1_024
#: Decimals that scores are compared by: the last bits depend on the order of additions.
DECIMALS = 12


def add_last(log: DataFrame) -> DataFrame:
    """VADD of (seq, key, label, vec): the last vector of each label."""
    return log.groupBy("key", "label").agg(F.max_by("vec", "seq").alias("vec"))


def add_checked(log: DataFrame) -> DataFrame:
    """VADD's replies: log rows with ``error`` where a vector hasn't the dimension of its key's first one."""
    dims = log.groupBy("key").agg(F.min_by(F.size("vec"), F.col("seq")).alias("dim"))
    return log.join(dims, "key").withColumn("error", F.when(F.size("vec") != F.col("dim"), F.lit("vector dimension mismatch"))).drop("dim")


def cardinality(state: DataFrame) -> DataFrame:
    """VCARD of every key."""
    return state.groupBy("key").agg(F.count("*").alias("n_vectors"))


def remove(state: DataFrame, requests: DataFrame) -> DataFrame:
    """VREM: what is left."""
    return state.join(requests.select("key", "label"), ["key", "label"], "left_anti")


def removed(requests: DataFrame, state: DataFrame) -> DataFrame:
    """VREM's replies: requests (key, label, ...) with ``reply``, 1 if the label was there."""
    held = state.select("key", "label", F.lit(1).alias("reply")).distinct()
    return requests.join(held, ["key", "label"], "left").withColumn("reply", F.coalesce("reply", F.lit(0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """A vector scaled to length one; a zero vector stays as it is."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))[0]


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """1 minus the product of two unit vectors, or the square of the Euclidean distance."""
    fold = lambda x, y, term: F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda t, v: t + v)
    if metric == "cosine":
        return F.lit(1.0) - fold(unit(a), unit(b), lambda x, y: x * y)
    return fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Similarity, or minus the distance, of each query and vector."""
    if metric == "cosine":
        nq, nv = (np.sqrt((x * x).sum(axis=1)) for x in (q, v))
        size = nq[:, None] * nv[None, :]
        return np.divide(q @ v.T, size, out=np.zeros_like(size), where=size > 0)
    out = np.empty((len(q), len(v)))
    for i, row in enumerate(q):
        out[i] = -np.sqrt(((v - row) ** 2).sum(axis=1))
    return out


def _best(labels: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, equal scores by label."""
    near = np.round(scores, DECIMALS)
    if len(near) > k:
        at = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k])
    else:
        at = np.arange(len(near))
    return at[np.lexsort((labels[at], -near[at]))[:k]]


def _cuts(batch: pa.RecordBatch) -> list[int]:
    """Where the rows of another group or of its other side begin, and both ends."""
    changed = np.zeros(max(0, batch.num_rows - 1), bool)
    for column in (*batch.column(0).flatten(), batch.column(1)):
        changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows] if batch.num_rows else []


def _meeting(k: int, metric: str, label_type: pa.DataType, query_type: pa.DataType):
    """For mapInArrow over rows (group, is_vector, query, label, vec) sorted by group, queries first:
    each query's best (query, label, score). Holds one block of queries and a slice of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, rows = None, [], []
        best: list[tuple[np.ndarray, np.ndarray]] = []
        least = np.zeros(0)

        def result() -> pa.RecordBatch:
            picked = [(q, label, s) for q, (labels, scores) in zip(ids, best, strict=True) for label, s in zip(labels.tolist(), scores.tolist(), strict=True)]
            columns = list(zip(*picked, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], query_type), pa.array(columns[1], label_type), pa.array(columns[2], pa.float64())], ["query", "label", "score"])

        for batch in batches:
            cuts = _cuts(batch)
            for s, e in zip(cuts, cuts[1:], strict=False):
                now = batch.column(0)[s].as_py()
                if now != group:
                    if best:
                        yield result()
                    group, ids, rows, best = now, [], [], []
                if not batch.column(1)[s].as_py():
                    ids += batch.column(2).slice(s, e - s).to_pylist()
                    rows.append(_matrix(batch.column(4).slice(s, e - s)))
                    continue
                if not ids:
                    continue
                asked = np.concatenate(rows)
                for at in range(s, e, VECTOR_SLICE):
                    n = min(e - at, VECTOR_SLICE)
                    labels = np.array(batch.column(3).slice(at, n).to_pylist())
                    scores = _scores(asked, _matrix(batch.column(4).slice(at, n)), metric)
                    if not best:
                        best = [(labels[:0], np.zeros(0))] * len(ids)
                        least = np.full(len(ids), -np.inf)
                    # only queries that find something as good as their last best look closer
                    for i in np.flatnonzero(scores.max(axis=1) >= least - 10.0 ** -(DECIMALS - 1)):
                        own_labels, own = np.concatenate((best[i][0], labels)), np.concatenate((best[i][1], scores[i]))
                        places = _best(own_labels, own, k)
                        best[i] = (own_labels[places], own[places])
                        least[i] = own[places[-1]] if len(places) == k else -np.inf
        if best:
            yield result()

    return run


def _searched(rows: DataFrame, asked: DataFrame, k: int, metric: str) -> DataFrame:
    """The best of (query, label, score) where ``rows(group, label, vec)`` and ``asked(group, query, vec)`` meet."""
    label, query = rows.schema["label"].dataType, asked.schema["query"].dataType
    both = asked.select("group", F.lit(False).alias("is_vector"), "query", F.lit(None).cast(label).alias("label"), F.col("vec").cast("array<double>").alias("vec")).unionByName(
        rows.select("group", F.lit(True).alias("is_vector"), F.lit(None).cast(query).alias("query"), "label", F.col("vec").cast("array<double>").alias("vec")))
    met = both.repartition("group").sortWithinPartitions("group", "is_vector")
    kinds = f"query {query.simpleString()}, label {label.simpleString()}, score double"
    found = met.mapInArrow(_meeting(k, metric, to_arrow_type(label), to_arrow_type(query)), kinds)
    rn = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", DECIMALS).desc(), "label"))
    best = found.withColumn("rn", rn).where(F.col("rn") <= k)
    return best.select("query", F.col("rn").cast("bigint").alias("rank"), "label", F.round("score", 6).alias("score"))


def _sized(df: DataFrame) -> DataFrame:
    """Vectors of one key and length meet; null and empty ones don't."""
    return df.where("vec is not null and size(vec) > 0").withColumn("size", F.size("vec"))


def _parts(df: DataFrame, on: list[str], rows: int, name: str) -> DataFrame:
    """How many parts of about ``rows`` rows each group has."""
    return df.groupBy(*on).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))


def _blocked(rows: DataFrame, asked: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``group``: each block of a group's queries meets each part of its vectors once."""
    sizes = _parts(rows, on, VECTOR_BLOCK, "vs").join(_parts(asked, on, QUERY_BLOCK, "qs"), on)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = F.struct(*on, "v", "q").alias("group")
    left = rows.join(sizes, on).withColumn("v", own("label", "vs")).withColumn("q", every("qs"))
    right = asked.join(sizes, on).withColumn("q", own("query", "qs")).withColumn("v", every("vs"))
    return left.select(group, "label", "vec"), right.select(group, "query", "vec")


def search(state: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """VSIM: (query, rank, label, score), the ``k`` best of the vectors of its key for each of ``queries``
    (query, key, vec).

    Exact. A query's vectors are those of its key and length; labels differ within a key, queries in the
    table. Score: similarity (0 with a zero vector), or minus the distance; ranks go by the unrounded score, equal ones by label.
    A key's vectors are dealt to parts and its queries to blocks, so a hot key takes many tasks.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    return _searched(*_blocked(_sized(state), _sized(queries), ["key", "size"]), k, metric)


def _centres(x: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    centres = x[np.random.default_rng(1).choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        near = _near(x, centres, 1)[:, 0]
        for c in range(cells):
            if (own := near == c).any():
                centres[c] = x[own].mean(axis=0)
    return centres


def _near(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), np.int32)
    own = (centres * centres).sum(axis=1)
    for at in range(0, len(x), 1_024):
        d = own[None, :] - 2.0 * x[at : at + 1_024] @ centres.T
        out[at : at + 1_024] = np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def search_indexed(state: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", probes: int = 8) -> DataFrame:
    """VSIM over an index: as ``search``, but a query meets only the vectors of the ``probes`` nearest cells.

    Approximate: cells are those of centres fitted on at most ``SAMPLE_ROWS`` vectors of all keys of a
    length; every vector is in the index. More ``probes`` find more; with as many as there are cells it is exact.
    """
    rows, asked = _sized(state), _sized(queries)
    if metric == "cosine":
        rows, asked = (df.withColumn("vec", unit(F.col("vec"))) for df in (rows, asked))
    counts = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row for each length
    books: dict[int, np.ndarray] = {}
    for size, n in counts.items():
        sample = rows.where(F.col("size") == size).orderBy(F.xxhash64("label", "key"), "label").limit(SAMPLE_ROWS).select("vec").toArrow()
        x = _matrix(sample.column(0).combine_chunks().cast(pa.list_(pa.float64())))
        books[size] = _centres(x, max(1, min(len(x), round(n / PER_CELL))))

    def cells(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list[int]] = [[]] * batch.num_rows
                sizes, vec = batch.column("size").to_numpy(), batch.column("vec")
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    if size in books:
                        found = _near(_matrix(vec.take(pa.array(at))), books[size], min(count, len(books[size])))
                        for i, f in zip(at, found.tolist(), strict=True):
                            out[i] = f
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

        return run

    def placed(df: DataFrame, count: int) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInArrow(cells(count), f"{schema}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")

    own, near = placed(rows.select("key", "size", "label", "vec"), 1), placed(asked.select("key", "size", "query", "vec"), probes)
    return _searched(*_blocked(own, near, ["key", "size", "cell"]), k, metric)
