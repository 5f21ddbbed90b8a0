"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Features are indicators, whether an n-gram occurs in the text: byte trigrams and pentagrams,
word unigrams and bigrams, n-grams of character-class runs, and n-grams of word-repeats-the-
word-before flags. Each indicator is scaled by its class log-count ratio; a linear
hinge-loss model is fitted to the scaled, unit-length vectors by dual coordinate descent. A fifth of the
training rows, held back from the fit, turns margins into probabilities (a logistic fit).

The model is fitted on at most ``max_rows`` labelled rows, chosen by a hash of the id, and has
``1 << BITS`` weights whatever the corpus holds. Scoring reads every text whole, in the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
SIZE = 1 << BITS
THRESHOLD = 0.3
#: Bound of the training sample.
MAX_TRAINING_ROWS = 2_500
#: Tasks that make the features of the training rows.
FEATURE_TASKS = 32
#: Bytes of a text that are turned into n-grams at once.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(codes: np.ndarray, kind: int) -> np.ndarray:
    """Feature numbers of 64-bit codes; kinds are kept apart by a salt."""
    x = codes + np.uint64((kind * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


#: Character class of each byte: 1 lower, 2 upper, 3 digit, 4 space, 5 !?, 6 other ASCII, 7 not ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[[ord("!"), ord("?")]], _CLASS[128:] = 4, 5, 7
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` of them at least."""
    if len(_powers["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            _powers[name] = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(2 * n, base))))
    return _powers["up"], _powers["down"]


class _Marker:
    """Sets the flags of all n-grams of a text that comes in blocks of bytes.

    What a block begins with may belong to n-grams, runs and words of the blocks before it, so
    their ends are kept: four bytes, four runs, the unfinished word, the last word and three
    repeat flags. The flags are those of the text as one block.
    """

    def __init__(self, flags: np.ndarray) -> None:
        self.flags = flags
        self.bytes = np.zeros(0, np.uint8)
        self.runs = np.zeros(0, np.uint64)
        self.open, self.scale = np.uint64(0), np.uint64(1)  # the unfinished word's code, and the base to its length
        self.inside = False
        self.word = np.zeros(0, np.uint64)
        self.same = np.zeros(0, np.uint64)

    def add(self, data: np.ndarray) -> None:
        wide = data.astype(np.uint64)
        classes = _CLASS[data]
        self._bytes(data)
        self._runs(classes)
        inside = classes != 4
        edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        up, down = _power_tables(len(data) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((wide + np.uint64(1)) * up[: len(data)])))
        words = (sums[stops] - sums[starts]) * down[starts]
        closed = [np.zeros(0, np.uint64)]
        if self.inside and not inside[0]:
            closed = [np.array([self.open])]
        elif self.inside:
            words[0] = self.open + self.scale * words[0]
        scale = self.scale if self.inside and inside[0] else np.uint64(1)
        self.inside = bool(inside[-1])
        if self.inside:
            length = int(stops[-1] - starts[-1])
            self.open, self.scale = words[-1], up[length] * (scale if len(words) == 1 else np.uint64(1))
            words = words[:-1]
        self._words(np.concatenate([*closed, words]))

    def end(self) -> None:
        if self.inside:
            self._words(np.array([self.open]))

    def _bytes(self, data: np.ndarray) -> None:
        data = np.concatenate((self.bytes, data))
        self.bytes = data[-4:]
        wide = data.astype(np.uint64)
        if len(data) >= 3:
            three = wide[:-2] | (wide[1:-1] << np.uint64(8)) | (wide[2:] << np.uint64(16))
            self.flags[_mixed(three, 1)] = True
            if len(data) >= 5:
                self.flags[_mixed(three[:-2] | (three[2:] << np.uint64(24)), 2)] = True

    def _runs(self, classes: np.ndarray) -> None:
        runs = classes[np.concatenate(([0], np.flatnonzero(classes[1:] != classes[:-1]) + 1))].astype(np.uint64)
        if len(self.runs) and self.runs[-1] == runs[0]:
            runs = runs[1:]
        runs = np.concatenate((self.runs, runs))
        self.runs = runs[-4:]
        code = runs
        for order in range(2, 6):
            code = (code[:-1] << np.uint64(3)) | runs[order - 1 :]
            self.flags[_mixed(code, 10 + order)] = True

    def _words(self, words: np.ndarray) -> None:
        if not len(words):
            return
        self.flags[_mixed(words, 20)] = True
        words = np.concatenate((self.word, words))
        self.word = words[-1:]
        self.flags[_mixed(words[:-1] * _BASE + words[1:], 21)] = True
        same = np.concatenate((self.same, (words[1:] == words[:-1]).astype(np.uint64)))
        self.same = same[-3:]
        code = same
        for order in range(2, 5):
            code = (code[:-1] << np.uint64(1)) | same[order - 1 :]
            self.flags[_mixed(code, 30 + order)] = True


def features(text: str | None, flags: np.ndarray | None = None, block: int = BLOCK) -> np.ndarray:
    """Distinct feature numbers of a whole text, ascending; none for null or empty.

    They don't depend on ``block``, how many bytes are worked on at once.
    """
    flags = np.zeros(SIZE, bool) if flags is None else flags
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data):
        marker = _Marker(flags)
        with np.errstate(over="ignore"):
            for at in range(0, len(data), block):
                marker.add(data[at : at + block])
            marker.end()
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass(frozen=True)
class Model:
    """Score = logistic(slope * margin + shift); margin = scaled . x / |ratio . x| + bias."""

    scaled: np.ndarray
    squared: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(self.squared[found].sum(dtype=np.float64)))
        return self.bias + (float(self.scaled[found].sum(dtype=np.float64)) / norm if norm > 0 else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -40, 40))))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost_i * hinge(y_i (w.x_i + b)), b as a weight of
    an always-present feature: one dual variable at a time, kept within [0, cost_i]."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-2:
            break
    return w, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic fit by Newton steps, targets smoothed."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, smoothing: float = 1.0) -> Model:
    """A model of feature rows and 0/1 labels. With a class missing, every score is its share."""
    labels = np.asarray(labels, np.int64)
    held = np.arange(len(rows)) % 5 == 4
    if len(set(labels[~held].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        zero = np.zeros(SIZE, np.float32)
        return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))
    # the rows that calibrate the scores are in neither the ratios nor the fit
    use = np.flatnonzero(~held)
    counts = np.full((2, SIZE), smoothing)
    for i in use:
        if len(rows[i]):
            counts[labels[i]][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = []
    for found in rows:
        v = ratio[found]
        n = np.sqrt(v @ v)
        values.append(v / n if n > 0 else v)
    y = np.where(labels == 1, 1.0, -1.0)
    n, ones = len(use), labels[use].sum()
    weight = cost * n / (2 * np.where(labels == 1, ones, n - ones))
    w, bias = dual_coordinate_descent([rows[i] for i in use], [values[i] for i in use], y[use], weight[use], SIZE)
    margins = np.array([float(w[rows[i]] @ values[i]) + bias for i in np.flatnonzero(held)])
    slope, shift = _logistic(margins, labels[held])
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, slope, shift)


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = np.zeros(SIZE, bool)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [features(t.as_py(), flags).astype(np.int32) for t in part.column(1)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2), part.column(3)], ["rank", "found", "label", "hash"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on the rows of ``labels`` that have a label of 0 or 1, ``max_rows`` of them at most.

    Which ones hangs on a hash of the id, so it is the same each time; ids, languages and
    sources are no features. Labels without a document are ignored. Where ids repeat, ``max_rows``
    of the joined rows are taken in the order of rank, label and text hash before any leaves the cluster.
    """
    rank = F.xxhash64(F.col(id_col).cast("string"), F.lit(11))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    chosen = known.select(F.col(id_col).alias("__keyloom_id"), F.col(label_col).cast("int").alias("label"), rank.alias("rank")).orderBy("rank", "__keyloom_id", "label").limit(max_rows)
    # at most max_rows rows
    rows = docs.select(F.col(id_col).alias("__keyloom_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__keyloom_id")
    rows = rows.withColumn("hash", F.md5(F.coalesce("text", F.lit("")))).orderBy("rank", "__keyloom_id", "label", "hash").limit(max_rows)
    # the limit leaves one partition; features are made in many
    table = rows.select("rank", "text", "label", "hash").repartition(FEATURE_TASKS).mapInArrow(_featurer, "rank long, found array<int>, label int, hash string").toArrow()
    order = np.lexsort((table.column("hash").to_numpy().astype(str), table.column("label").to_numpy(), table.column("rank").to_numpy()))
    found, label = table.column("found").combine_chunks(), table.column("label").to_numpy()
    return fit([found[int(i)].values.to_numpy() for i in order], label[order])


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(SIZE, bool)
        for batch in batches:
            scores = np.fromiter((model.score(features(t.as_py(), flags)) for t in batch.column(batch.num_columns - 1)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "__keyloom_score"])

    return run


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with each text's probability of label 1.

    Null and empty texts have no features and get the bias's score. Texts are read whole, in
    blocks that change nothing; equal texts and repeated rows get equal scores; an empty table
    stays empty. A column of ``docs`` that is named ``score_col`` is replaced, others pass through.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    rows = docs.withColumn("__keyloom_text", F.col(text_col).cast("string"))
    schema = StructType([*rows.schema.fields, StructField("__keyloom_score", DoubleType())])
    scored = rows.mapInArrow(_scorer(model), schema)
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns if c != score_col], F.col("__keyloom_score").alias(score_col))


def held_out(id_col: str = "doc_id"):
    """Whether an id is in the fifth that is never trained on."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def trained_model(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the registered query: trained on labels that aren't held out."""
    return train(docs, labels.where(~held_out()))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with a score of at least ``threshold``, with the columns of ``docs``, whatever their names."""
    score = "__keyloom_kept"
    return with_scores(docs, model, text_col, score).where(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
