"""Embedding near-dedup over an inverted multi-index.

Vectors are scaled to length one. Two codebooks, one for each half of the vector, make a grid
of cells; every vector is a resident of its nearest cell and a visitor of the next cells in
the order of a multi-sequence traversal (ascending sum of both halves' distances), as long as that
sum exceeds the nearest cell's by no more than the index's reach. The reach is calibrated: the
least with which the target recall is met on linked pairs that the codebooks haven't seen, both real
ones (a bounded sample of vectors with partners found among all rows) and made ones with cosines
spread evenly over the linked range. A vector deep inside a cell so visits few, one near a border many.
A pair is met if either vector visits the other's cell; it is counted in exactly one cell and
verified by its cosine in double precision.

Equal vectors are grouped first and carried as one with a count. Cells are compared in blocks
of bounded size, so a cell that holds a large part of all rows is spread over many tasks. Tasks
return sums of links and a spanning forest of them, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

MIN_COSINE = 0.9
TARGET_RECALL = 0.97
#: Vectors that codebooks are fitted on at most. There are never more codes than these, which lets
#: cells keep their size up to SAMPLE_ROWS ** 2 * PER_CELL vectors.
SAMPLE_ROWS = 20_000
#: Vectors whose partners calibrate the index, partners taken of each, and made pairs.
PROBES, PARTNERS, MADE_PAIRS = 512, 4, 1_000
#: Real pairs below this number are judged together with the made ones.
LEAST_REAL = 50
#: Vectors a cell holds on average.
PER_CELL = 512
#: Residents, and visitors, of a cell that one comparison takes.
BLOCK = 2_048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """``k`` centroids by Lloyd's rounds; an empty centroid moves to a random row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([_squares(x[at : at + 1_024], centres).argmin(axis=1) for at in range(0, len(x), 1_024)])
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        centres[~full] = x[rng.integers(len(x), size=int((~full).sum()))]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves and how far beyond its nearest cell a vector visits others."""

    books: tuple[np.ndarray, np.ndarray]
    reach: float

    def beyond(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By how much each code of either half is farther from each row than the nearest one."""
        half = self.books[0].shape[1]
        each = (_squares(x[:, :half], self.books[0]), _squares(x[:, half:], self.books[1]))
        return tuple(d - d.min(axis=1, keepdims=True) for d in each)

    def visited(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of each row's multi-sequence traversal within the reach: rows in order, cells nearest first.

        Only codes within the reach by themselves can be part of a cell within it.
        """
        k = len(self.books[1])
        rows, cells = [], []
        at = 0
        while at < len(x):
            part = x[at : at + 256]
            far, order = [], []
            for d in self.beyond(part):
                near = np.argsort(d, axis=1, kind="stable")[:, : max(1, int((d <= self.reach).sum(axis=1).max()))]
                order.append(near)
                far.append(np.take_along_axis(d, near, axis=1))
            # so many rows at once that their sums stay small
            step = max(1, (1 << 21) // (far[0].shape[1] * far[1].shape[1]))
            for s in range(0, len(part), step):
                sums = far[0][s : s + step, :, None] + far[1][s : s + step, None, :]
                r, i, j = np.nonzero(sums <= self.reach)
                by = np.lexsort((j, i, sums[r, i, j], r))
                r, i, j = r[by] + s, i[by], j[by]
                rows.append(r + at)
                cells.append(order[0][r, i] * k + order[1][r, j])
            at += 256
        return np.concatenate(rows), np.concatenate(cells).astype(np.int32)


def made_pairs(x: np.ndarray, min_cosine: float, n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``n`` pairs of a row and a vector in a random direction from it, cosines spread evenly from ``min_cosine`` to 1."""
    rng = np.random.default_rng(seed)
    a = x[rng.choice(len(x), n, replace=len(x) < n)]
    other = rng.standard_normal(a.shape)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    length = np.sqrt((other * other).sum(axis=1, keepdims=True))
    cosine = rng.uniform(min_cosine, 1.0, (n, 1))
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * np.divide(other, length, out=np.zeros_like(other), where=length > 0)


def calibrated(books: tuple[np.ndarray, np.ndarray], made: tuple[np.ndarray, np.ndarray], real: tuple[np.ndarray, np.ndarray], target: float) -> Index:
    """The index of the least reach with which a share ``target`` of either kind of pairs is met."""
    kinds = [made, real] if len(real[0]) >= LEAST_REAL else [tuple(np.concatenate(p) for p in zip(made, real, strict=True))]
    index, reach = Index(books, 0.0), 0.0
    for a, b in kinds:
        fa, fb = index.beyond(a), index.beyond(b)
        row = np.arange(len(a))
        # how far either vector has to reach for the other's cell
        needed = np.minimum(sum(x[row, y.argmin(axis=1)] for x, y in zip(fa, fb, strict=True)), sum(y[row, x.argmin(axis=1)] for x, y in zip(fa, fb, strict=True)))
        reach = max(reach, float(np.sort(needed)[int(np.ceil(target * len(needed))) - 1]))
    return Index(books, reach * (1 + 1e-9))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _partners(probes: np.ndarray, marks: np.ndarray, dim: int, min_cosine: float):
    """For mapInArrow over (h, vec): (probe, order, vec) of a few other vectors that each probe is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, pa.Scalar]] = [{} for _ in probes]
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                h = part.column(0).to_numpy()
                near = (probes @ _vectors(part.column(1), dim).T >= min_cosine) & (marks[:, None] != h[None, :])
                for p, i in zip(*np.nonzero(near), strict=True):
                    own, mark = best[p], int(h[i])
                    if len(own) < PARTNERS or mark < max(own):
                        own[mark] = part.column(1)[i]
                        if len(own) > PARTNERS:
                            del own[max(own)]
        rows = [(p, mark, v.as_py()) for p, own in enumerate(best) for mark, v in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["probe", "mark", "vec"])

    return run


def fitted(vectors: DataFrame, dim: int, total: int, min_cosine: float, target: float) -> Index:
    """The index for ``vectors(h, vec)`` of one dimension, about ``total`` of them different; ``h``: a hash of the vector.

    Codebooks and probes come of a sample of different vectors in the order of a hash, of SAMPLE_ROWS and PROBES
    rows at most; the probes' partners are looked for among all rows.
    """
    wanted = SAMPLE_ROWS + PROBES
    order = F.xxhash64("h", F.lit(3))
    some = vectors if total <= 2 * wanted else vectors.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * 1.5 * wanted / total))
    sample = some.groupBy("h").agg(F.first("vec").alias("vec")).orderBy(order, "h").limit(wanted).toArrow()
    x, marks = _vectors(sample.column("vec").combine_chunks(), dim), sample.column("h").to_numpy()
    unseen = min(PROBES, len(x) // 4)
    seen = x[unseen:]
    k = int(min(max(1, round((total / PER_CELL) ** 0.5)), len(seen)))
    books = (codebook(seen[:, : dim // 2], k, 1), codebook(seen[:, dim // 2 :], k, 2))
    if k == 1 or not unseen:
        return Index(books, np.inf)
    probes = x[:unseen]
    found = vectors.select("h", "vec").mapInArrow(_partners(probes, marks[:unseen], dim, min_cosine), "probe int, mark long, vec array<double>")
    rn = F.row_number().over(Window.partitionBy("probe").orderBy("mark"))
    real = found.dropDuplicates(["probe", "mark"]).withColumn("rn", rn).where(F.col("rn") <= PARTNERS).select("probe", "vec").toArrow()
    pairs = (probes[real.column("probe").to_numpy()], _vectors(real.column("vec").combine_chunks(), dim)) if real.num_rows else (probes[:0], probes[:0])
    return calibrated(books, made_pairs(probes, min_cosine, MADE_PAIRS), pairs, target)


def _assigner(indexes: dict[int, Index]):
    """For mapInArrow over (gid, h, g, low, n, vec): the same and what each vector visits, its own cell first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            sizes = np.diff(vec.offsets.to_numpy())
            visits: list = [None] * batch.num_rows
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                row, cell = indexes[dim].visited(_vectors(vec.take(pa.array(at)), dim))
                for i, own in zip(at.tolist(), np.split(cell, np.flatnonzero(np.diff(row)) + 1), strict=True):
                    visits[i] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, pa.list_(pa.int32()))], [*batch.schema.names, "visits"])

    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    out: list[tuple[int, int]] = []
    left = linked.any(axis=1)
    while left.any():
        frontier = np.array([int(left.argmax())])
        left[frontier] = False
        while len(frontier):
            reach = linked[frontier]
            new = np.flatnonzero(reach.any(axis=0) & left)
            out += zip(frontier[reach[:, new].argmax(axis=0)].tolist(), new.tolist(), strict=True)
            left[new] = False
            frontier = new
    return out


def _compare(side: np.ndarray, gid: np.ndarray, n: np.ndarray, home: np.ndarray, visits: pa.Array, x: np.ndarray, diagonal: bool, min_cosine: float) -> tuple[list, list]:
    """Link sums (gid, weight) and forest edges (gid, gid) of one group."""
    own = np.flatnonzero(side == 0)
    if not len(own):
        return [], []
    m = len(side)
    linked = np.zeros((m, m), bool)
    for at in range(0, len(own), 256):
        some = own[at : at + 256]
        linked[some] = x[some] @ x.T >= min_cosine
    close = linked[own]
    close[:, side == 0] &= diagonal
    close[np.arange(len(own)), own] = False
    guests = np.flatnonzero(side == 2)
    if len(guests):
        r, g = np.nonzero(close[:, guests])
        # what the residents visit, as rows of one width
        ends = visits.offsets.to_numpy()
        flat, starts, counts = visits.values.to_numpy(), ends[own], ends[own + 1] - ends[own]
        seen = np.full((len(own), max(1, int(counts.max(initial=0)))), -1, np.int32)
        for i, (s, c) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
            seen[i, :c] = flat[s : s + c]
        for at in range(0, len(r), 1 << 14):
            rr, gg = r[at : at + (1 << 14)], guests[g[at : at + (1 << 14)]]
            # if both visit each other's cell, the pair counts where the visitor has the smaller gid
            back = (seen[rr] == home[gg][:, None]).any(axis=1)
            close[rr, gg] &= ~back | (gid[gg] < gid[own[rr]])
    linked[:] = False
    linked[own] = close
    linked |= linked.T
    weight = linked @ n
    at = np.flatnonzero(weight)
    return list(zip(gid[at].tolist(), weight[at].tolist(), strict=True)), [(int(gid[i]), int(gid[j])) for i, j in _forest(linked)]


def _comparer(min_cosine: float):
    """For mapInArrow over rows sorted by (dim, cell, a, b): sums (a, null, w) and edges (a, b, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result(rows: pa.Table) -> pa.RecordBatch:
            dim, a, b, side, gid, n, home = (rows.column(i).to_numpy() for i in (0, 2, 3, 4, 5, 6, 7))
            lists = rows.column(8).combine_chunks()
            x = _vectors(rows.column(9).combine_chunks(), int(dim[0]))
            sums, edges = _compare(side, gid, n, home, lists, x, a[0] == b[0], min_cosine) if len(side) > 1 else ([], [])
            first = [g for g, _ in sums] + [p for p, _ in edges]
            second = [None] * len(sums) + [q for _, q in edges]
            weights = [w for _, w in sums] + [None] * len(edges)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (first, second, weights)], ["a", "b", "w"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(s, e - s)
                if held and part.num_rows and any(held[0].column(i)[0].as_py() != part.column(i)[0].as_py() for i in range(4)):
                    yield result(pa.Table.from_batches(held))
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield result(pa.Table.from_batches(held))

    return run


def _links(reps: DataFrame, min_cosine: float, block: int) -> DataFrame:
    """(a, b, w) of ``reps(gid, n, vec, visits)``."""
    dim = F.size("vec").alias("dim")
    sizes = reps.select(dim, F.posexplode("visits").alias("pos", "cell")).groupBy("dim", "cell").agg(F.count_if(F.col("pos") == 0).alias("r"), F.count_if(F.col("pos") > 0).alias("v"))
    parts = lambda c: F.greatest(F.ceil(F.col(c) / F.lit(block)), F.lit(1)).cast("int")
    # written, so that Spark knows its size when it chooses the join
    large = written(sizes.where((F.col("r") > block) | (F.col("v") > block)).select("dim", "cell", parts("r").alias("sr"), parts("v").alias("sv")), "large")
    placed = reps.select(dim, "gid", "n", F.col("visits")[0].alias("home"), "visits", "vec", F.posexplode("visits").alias("pos", "cell")).withColumn("resident", F.col("pos") == 0)
    marked = placed.join(large, ["dim", "cell"], "left")
    own = F.pmod(F.xxhash64("gid", F.lit(9)), F.when(F.col("resident"), F.col("sr")).otherwise(F.col("sv"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    spot = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("side"))
    r = F.col("own")
    for_resident = F.concat(
        F.transform(upto(F.col("sr")), lambda j: spot(F.least(r, j), F.greatest(r, j), F.when(j >= r, 0).otherwise(1))),
        F.transform(upto(F.col("sv")), lambda j: spot(r, F.col("sr") + j, F.lit(0))))
    for_visitor = F.transform(upto(F.col("sr")), lambda j: spot(j, F.col("sr") + r, F.lit(2)))
    alone = F.array(spot(F.lit(0), F.lit(0), F.when(F.col("resident"), 0).otherwise(2)))
    spots = F.when(F.col("sr").isNull(), alone).when(F.col("resident"), for_resident).otherwise(for_visitor)
    # only residents carry what they visit
    seen = F.when(F.col("resident"), F.col("visits")).otherwise(F.array().cast("array<int>"))
    rows = marked.withColumn("own", own).withColumn("spot", F.explode(spots)).select("dim", "cell", "spot.a", "spot.b", "spot.side", "gid", "n", "home", seen.alias("visits"), "vec")
    return rows.repartition("dim", "cell", "a", "b").sortWithinPartitions("dim", "cell", "a", "b").mapInArrow(_comparer(min_cosine), "a long, b long, w long")


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = MIN_COSINE, target_recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``.

    n_links: other rows with a cosine of at least ``min_cosine``. component_id: the smallest id
    reachable. kept: id = component_id. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, nor do vectors of different lengths. Repeated rows
    are vectors of their own and link with each other. A row with a null id takes part; its
    component's smallest id stands for it and it isn't kept. An empty table gives an empty
    result; other columns are not read.
    """
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    sound = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("h", F.when(sound, F.xxhash64(vec))).withColumn("g", F.when(sound, F.xxhash64(vec, F.lit(1))))
    known = rows.where("h is not null")
    # one length is usual; each has its own index
    lengths = known.groupBy(F.size("vec").alias("dim")).agg(F.approx_count_distinct("h", 0.02)).collect()
    indexes = {dim: fitted(known.where(F.size("vec") == dim).select("h", "vec"), dim, total, min_cosine, target_recall) for dim, total in lengths}
    groups = known.groupBy("h", "g").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    numbered = groups.select(F.monotonically_increasing_id().alias("gid"), "h", "g", "low", "n", "vec")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields)
    reps = written(numbered.mapInArrow(_assigner(indexes), f"{schema}, visits array<int>"), "vectors")
    found = written(_links(reps, min_cosine, block), "links")
    sums = found.where("w is not null").groupBy(F.col("a").alias("gid")).agg(F.sum("w").alias("w"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    named = reps.select("gid", "h", "g", "low", "n").join(sums, "gid", "left").join(roots.withColumnRenamed("node", "gid"), "gid", "left")
    named = named.select("h", "g", "low", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "gid").alias("root"))
    # as tables of known size both sides are dealt for the join alone, so that Spark can split a large component
    named = written(named, "named")
    lows = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    of = named.join(lows, "root").select("h", "g", "n_links", "component_id")
    joined = rows.where("h is not null").select("id", "h", "g").join(of, ["h", "g"]).select("id", "n_links", "component_id")
    alone = rows.where("h is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
