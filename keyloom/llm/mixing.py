"""Mixing sources to target weights by iterative proportional fitting.

The corpus is reduced to cells (source, language, topic) with their tokens, which a tokenizer
counts. Raking scales the cells' weights in turn so that the marginals of source, language and topic meet their targets.
The tokens to keep are then raked with each cell bounded by the tokens it has, so that what a
small cell can't give comes from cells of the same categories. Each document is kept with its cell's
probability, decided by a hash of its id and text, so the sample is the same each time and needs no shuffle.

Where the budget asks more of a category than there is, the budget is kept and the sum of the marginals'
absolute deviations made small (a factor of a category ends at ``FACTOR``); ``with_mix`` logs what is missed and
``marginals`` shows it.

Up to ``MAX_LOCAL_CELLS`` cells (counted first) are raked on the driver and broadcast; more are
raked by the same steps as grouped sums and joins on the cluster.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import written
from .packing import encode_texts
from .token_counts import vocabulary_path

log = logging.getLogger(__name__)

MAX_LOCAL_CELLS = 100_000
#: Log of the greatest factor of a category in the bounded raking, and of the one for all cells.
FACTOR, ALL_FACTOR = 7.0, 50.0
#: Share of the tokens kept that may lie in other categories than the targets' without notice.
MISSED = 1e-4
#: What stands for a null category.
NONE = "\x00none"


@dataclass(frozen=True)
class Targets:
    """Target shares by dimension.

    shares: per dimension, a share by category; a category without one keeps its actual share.
    flatten: dimensions without shares get actual shares to this power (1: as they are,
    0: all alike). Shares are scaled to sum 1 over the categories that occur.
    budget: tokens to keep, as a share of all tokens.
    """

    shares: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    flatten: Mapping[str, float] = field(default_factory=dict)
    budget: float = 0.5
    rounds: int = 50
    tolerance: float = 1e-9


def _target(names: list[str], actual: np.ndarray, dim: str, targets: Targets) -> np.ndarray:
    """Target shares of a dimension's categories from their actual shares."""
    if dim in targets.shares:
        wanted = np.array([targets.shares[dim].get(n, a) for n, a in zip(names, actual, strict=True)], float)
    else:
        wanted = actual ** targets.flatten.get(dim, 1.0)
    return wanted / wanted.sum()


def probabilities(weights: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """min(1, c * weight / tokens) with c such that the expected tokens meet the budget, or all if they can't."""
    ratio = np.where(tokens > 0, weights / np.maximum(tokens, 1e-300), 0.0)
    order = np.argsort(-ratio, kind="stable")
    # cells taken whole are those of the largest ratios: find how many
    whole = np.concatenate(([0.0], np.cumsum(tokens[order])[:-1]))
    rest = np.cumsum((ratio * tokens)[order][::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = (budget - whole) / rest
        fits = np.flatnonzero((scale * ratio[order] <= 1.0) & (scale >= 0))
    c = scale[fits[0]] if len(fits) else np.inf
    return np.minimum(1.0, np.where(ratio > 0, c * np.maximum(ratio, 1e-300), 0.0))


def rake(cells: list[tuple], dims: Sequence[str], targets: Targets) -> tuple[np.ndarray, np.ndarray]:
    """Weights (sum 1) and keeping probabilities of (category, ..., tokens) rows."""
    tokens = np.array([c[-1] for c in cells], float)
    weights = tokens / tokens.sum()
    coded = []
    for k, dim in enumerate(dims):
        names, codes = np.unique([c[k] for c in cells], return_inverse=True)
        actual = np.bincount(codes, weights, len(names))
        coded.append((codes, _target(names.tolist(), actual, dim, targets)))
    for _ in range(targets.rounds):
        off = 0.0
        for codes, wanted in coded:
            now = np.bincount(codes, weights, len(wanted))
            factor = np.divide(wanted, now, out=np.zeros_like(now), where=now > 0)
            off = max(off, float(np.abs(wanted - now).max()))
            weights = weights * factor[codes]
        if off < targets.tolerance:
            break
    budget = targets.budget * tokens.sum()
    return weights, probabilities(_bounded(weights * budget, tokens, coded, budget, targets), tokens, budget)


def _bounded(wish: np.ndarray, tokens: np.ndarray, coded: list[tuple[np.ndarray, np.ndarray]], budget: float, targets: Targets) -> np.ndarray:
    """Tokens to keep whose part within ``tokens`` meets the marginals; ``wish`` times a factor by category."""
    parts = [*((codes, wanted, FACTOR) for codes, wanted in coded), (np.zeros(len(tokens), int), np.ones(1), ALL_FACTOR)]
    factors = [np.zeros(len(wanted)) for _, wanted, _ in parts]
    for _ in range(2 * targets.rounds):
        off = 0.0
        for k, (codes, wanted, most) in enumerate(parts):
            now = np.bincount(codes, np.minimum(wish, tokens), len(wanted))
            step = np.log(np.divide(wanted * budget, now, out=np.ones_like(now), where=(now > 0) & (wanted > 0)))
            moved = np.clip(factors[k] + step, -most, most) - factors[k]
            factors[k] = factors[k] + moved
            off = max(off, float(np.abs(moved).max()))
            wish = wish * np.exp(moved)[codes]
        if off < targets.tolerance:
            break
    return wish


def _tell(missed: Mapping[str, float], targets: Targets) -> None:
    """Log the dimensions whose targets the budget doesn't let the sample meet."""
    for dim, share in missed.items():
        if share > MISSED:
            log.warning("mixing: with a budget of %g, %.4f of the expected tokens lie in other categories of %s than the targets'", targets.budget, share, dim)


def _rake_on_cluster(cells: DataFrame, dims: Sequence[str], targets: Targets) -> DataFrame:
    """``rake`` for more cells than the driver should hold."""
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.select(*dims, "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"))
    now = written(cells.withColumn("weight", F.col("tokens") / F.lit(float(total))), "cells")
    wanted = {}
    for dim in dims:
        actual = now.groupBy(dim).agg(F.sum("weight").alias("actual"))
        if dim in targets.shares:
            known = F.create_map(*[F.lit(x) for kv in targets.shares[dim].items() for x in kv])
            share = F.coalesce(F.try_element_at(known, F.col(dim)), F.col("actual"))
        else:
            share = F.pow("actual", F.lit(float(targets.flatten.get(dim, 1.0))))
        shares = actual.select(dim, share.alias("wanted"))
        wanted[dim] = written(shares.crossJoin(shares.agg(F.sum("wanted").alias("all"))).select(dim, (F.col("wanted") / F.col("all")).alias("wanted")), "wanted")
    for _ in range(targets.rounds):
        off = 0.0
        for dim in dims:
            sums = written(now.groupBy(dim).agg(F.sum("weight").alias("now")).join(wanted[dim], dim), "sums")
            off = max(off, sums.agg(F.max(F.abs(F.col("wanted") - F.col("now")))).first()[0] or 0.0)
            now = now.join(sums, dim).select(*dims, "tokens", F.when(F.col("now") > 0, F.col("weight") * F.col("wanted") / F.col("now")).otherwise(0.0).alias("weight"))
        now = written(now, "cells")
        if off < targets.tolerance:
            break
    budget = targets.budget * float(total)
    now = _bounded_on_cluster(now, dims, wanted, budget, targets)
    # bisection for the scale: each step is one sum
    ratio = F.when(F.col("tokens") > 0, F.col("wish") / F.col("tokens")).otherwise(0.0)
    kept = lambda c: now.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(c) * ratio))).first()[0]
    low, high = 0.0, 2.0
    while kept(high) < budget * (1 - 1e-12) and high < 1e300:
        low, high = high, high * 1024
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if kept(middle) < budget else (low, middle)
    return now.withColumn("probability", F.least(F.lit(1.0), F.lit(high) * ratio))


def _bounded_on_cluster(cells: DataFrame, dims: Sequence[str], wanted: Mapping[str, DataFrame], budget: float, targets: Targets) -> DataFrame:
    """``cells`` with ``wish``: ``_bounded`` by grouped sums; the logs of the factors stand beside the cells."""
    logs = {d: f"__keyloom_log_{k}" for k, d in enumerate(dims)}
    out = cells.select(*dims, "tokens", "weight", *[F.lit(0.0).alias(v) for v in logs.values()])
    whole = 0.0
    for _ in range(2 * targets.rounds):
        off = 0.0
        for dim, own in logs.items():
            kept = F.least(F.col("tokens"), _wish(budget, logs, whole))
            step = F.when((F.col("now") > 0) & (F.col("wanted") > 0), F.log(F.col("wanted") * F.lit(budget) / F.col("now"))).otherwise(0.0)
            bounded = F.greatest(F.lit(-FACTOR), F.least(F.lit(FACTOR), F.col("old") + step))
            sums = out.groupBy(dim).agg(F.sum(kept).alias("now"), F.max(own).alias("old")).join(wanted[dim], dim)
            sums = written(sums.select(dim, "old", bounded.alias("new")), "sums")
            off = max(off, sums.agg(F.max(F.abs(F.col("new") - F.col("old")))).first()[0] or 0.0)
            out = out.join(sums, dim).select(*dims, "tokens", "weight", *[F.col("new").alias(v) if v == own else F.col(v) for v in logs.values()])
        out = written(out, "cells")
        sum_kept = out.agg(F.sum(F.least(F.col("tokens"), _wish(budget, logs, whole)))).first()[0]
        if sum_kept > 0:
            moved = float(np.clip(whole + np.log(budget / sum_kept), -ALL_FACTOR, ALL_FACTOR)) - whole
            whole, off = whole + moved, max(off, abs(moved))
        if off < targets.tolerance:
            break
    return written(out.select(*dims, "tokens", "weight", _wish(budget, logs, whole).alias("wish")), "cells")


def _wish(budget: float, logs: Mapping[str, str], whole: float) -> Column:
    return F.col("weight") * F.lit(budget) * F.exp(sum((F.col(v) for v in logs.values()), F.lit(whole)))


def _misplaced(names: list[str], weights: np.ndarray, kept: np.ndarray) -> float:
    """Half the sum of the absolute deviations of a dimension's expected shares from its targets."""
    codes = np.unique(names, return_inverse=True)[1]
    return float(np.abs(np.bincount(codes, weights) - np.bincount(codes, kept) / max(kept.sum(), 1e-300)).sum() / 2) if kept.sum() > 0 else 0.0


def _misplaced_on_cluster(raked: DataFrame, dim: str) -> float:
    sums = raked.groupBy(dim).agg(F.sum("weight").alias("w"), F.sum(F.col("tokens") * F.col("probability")).alias("kept"))
    total = sums.agg(F.sum("kept")).first()[0]
    return sums.agg(F.sum(F.abs(F.col("w") - F.col("kept") / F.lit(total)))).first()[0] / 2 if total else 0.0


def marginals(mixed: DataFrame, dims: Mapping[str, Column], tokens: Column) -> DataFrame:
    """(dimension, category, target, expected) of a table that ``with_mix`` made: the shares of the
    tokens kept by the targets and by the probabilities."""
    inner = {n: f"__keyloom_{i}" for i, n in enumerate(dims)}
    marked = mixed.select(*[F.coalesce(dims[n].cast("string"), F.lit(NONE)).alias(i) for n, i in inner.items()], F.coalesce(tokens, F.lit(0)).cast("double").alias("tokens"), "mix_weight", "mix_probability")
    cells = marked.groupBy(*inner.values()).agg(F.first("mix_weight").alias("w"), F.sum(F.col("tokens") * F.col("mix_probability")).alias("kept"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(i).alias("category")) for n, i in inner.items()]))
    sums = cells.select(each.alias("d"), "w", "kept").groupBy("d").agg(F.sum("w").alias("target"), F.sum("kept").alias("kept"))
    total = sums.groupBy("d.dimension").agg(F.sum("kept").alias("all"))
    return sums.select("d.dimension", "d.category", "target", "kept").join(total, "dimension").select("dimension", "category", "target", (F.col("kept") / F.col("all")).alias("expected"))


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) by md5 of the columns; nulls count as empty."""
    text = F.concat_ws("\x01", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def text_digest(text: Column) -> Column:
    """What of a text the draw depends on."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def with_mix(docs: DataFrame, dims: Mapping[str, Column], tokens: Column, targets: Targets, id_col: str = "doc_id", text_col: str = "text", seed: str = "mix", max_local_cells: int = MAX_LOCAL_CELLS, digest: Column | None = None) -> DataFrame:
    """``docs`` with ``mix_weight`` (target share of the document's cell), ``mix_probability``
    and ``mix_kept``.

    ``dims``: the dimensions by name; a null category is a category of its own. ``tokens``: a
    document's tokens; null counts as 0; they are read once, for the cells alone. ``digest``: the
    text's md5 where the caller has it already. Null ids and texts hash as empty, so repeated rows
    are kept or dropped together. A cell without tokens has probability 0, and where no document
    has any, nothing is kept. Very long texts are used whole. An empty table stays empty. Other
    columns pass through, those named mix_* are replaced.
    """
    names = list(dims)
    inner = [f"__keyloom_{i}" for i in range(len(names))]
    columns = [c for c in docs.columns if c not in ("mix_weight", "mix_probability", "mix_kept")]
    marked = docs.withColumns({i: F.coalesce(dims[n].cast("string"), F.lit(NONE)) for i, n in zip(inner, names, strict=True)})
    counted = written(marked.groupBy(*inner).agg(F.sum(F.coalesce(tokens, F.lit(0)).cast("double")).alias("tokens")), "cells")
    n = counted.count()
    own = Targets({i: targets.shares[d] for i, d in zip(inner, names, strict=True) if d in targets.shares}, {i: targets.flatten[d] for i, d in zip(inner, names, strict=True) if d in targets.flatten}, targets.budget, targets.rounds, targets.tolerance)
    schema = StructType([*[StructField(i, StringType()) for i in inner], StructField("mix_weight", DoubleType()), StructField("mix_probability", DoubleType())])
    if n <= max_local_cells:
        rows = sorted(tuple(r) for r in counted.collect())
        if sum(r[-1] for r in rows) > 0:
            weights, chances = rake(rows, inner, own)
            made = [(*r[:-1], float(w), float(p)) for r, w, p in zip(rows, weights, chances, strict=True)]
            _tell({d: _misplaced([r[k] for r in rows], weights, chances * np.array([r[-1] for r in rows])) for k, d in enumerate(names)}, targets)
        else:
            made = [(*r[:-1], 0.0, 0.0) for r in rows]
        # at most max_local_cells rows
        cells = F.broadcast(docs.sparkSession.createDataFrame(made, schema))
    else:
        raked = written(_rake_on_cluster(counted, inner, own), "cells")
        _tell({d: _misplaced_on_cluster(raked, i) for i, d in zip(inner, names, strict=True)}, targets)
        cells = raked.select(*inner, F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability"))
    chance = uniform(F.lit(seed), F.col(id_col), text_digest(F.col(text_col)) if digest is None else digest)
    out = marked.drop("mix_weight", "mix_probability", "mix_kept").join(cells, inner)
    return out.select(*[F.col(f"`{c}`") for c in columns], "mix_weight", "mix_probability", (chance < F.col("mix_probability")).alias("mix_kept"))


def sample_mix(docs: DataFrame, dims: Mapping[str, Column], tokens: Column, targets: Targets, **more) -> DataFrame:
    """The sampled rows, with the columns of ``docs``."""
    return with_mix(docs, dims, tokens, targets, **more).where("mix_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


#: An address: what stands around the sign is enough, so the pattern takes time in proportion to the text.
_ADDRESS = r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[a-z]{2}"


def text_form(text: Column) -> Column:
    """The topic of the registered query: what form a text has, as a proxy for its subject."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return (F.when(whole.contains(" | "), "table").when(whole.contains("@") & whole.rlike(_ADDRESS), "contact")
            .when(F.length(whole) > 6000, "long").when(F.length(whole) < 800, "short").otherwise("prose"))


def token_counts(path: str) -> Callable[[Column], Column]:
    """A function of a text column: how many tokens the tokenizer at ``path`` gives; 0 for null."""

    @F.pandas_udf(LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode_texts(path, [t])[0]) // 4 if t else 0 for t in texts], dtype="int64")

    return lambda text: counted(text.cast("string"))


#: Production targets: languages by share, sources evened out, topics as a mixture.
PRODUCTION = Targets(
    shares={"lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}, "topic": {"prose": 0.5, "long": 0.25, "short": 0.15, "contact": 0.05, "table": 0.05}},
    flatten={"source": 0.5},
)


def dimensions() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": text_form(F.col("text"))}


def production_tokens() -> Callable[[Column], Column]:
    """Token counts by the tokenizer that sequences are packed with."""
    return token_counts(vocabulary_path("word_bpe_49k.json"))
