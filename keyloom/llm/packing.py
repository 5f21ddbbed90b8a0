"""Best-fit-decreasing packing of tokenised documents into sequences of fixed length.

Pieces are tokenised once and written as a table of lengths and checksums; texts don't move.
Lengths are whole numbers up to the capacity, so best-fit decreasing needs only how many pieces
have each length: the plan treats all pieces of a length, and all bins of a remaining
capacity, together. A segment tree over remaining capacities finds the tightest open bin in
logarithmic time. The plan's input is at most ``capacity`` numbers however large the corpus, and
it is exactly the packing that placing piece after piece would give. A piece finds its place by
its rank among those of its length: its rank within its task plus what earlier tasks counted.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker keeps; the table starts afresh when full.
KEPT_WORDS = 400_000
_LONG_WORD = 64


class FreeTree:
    """Segment tree over remaining capacities: how many open bins have each."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.counts = [0] * (2 * self.leaves)

    def add(self, free: int, bins: int) -> None:
        at = self.leaves + free
        while at:
            self.counts[at] += bins
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that some open bin has."""
        at = self.leaves + least
        if self.counts[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.counts[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.counts[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first bin, offset), sorted, and the number of bins.

    Pieces of a run have consecutive ranks and go to consecutive bins at one offset. Equal
    to best-fit decreasing piece by piece: a bin that took a piece is the tightest for the
    next of that length as long as it holds one more.
    """
    tree, open_bins, runs, bins = FreeTree(capacity), {}, [], 0

    def opened(free: int, first: int, n: int) -> None:
        if n and free:
            open_bins.setdefault(free, []).append((first, n))
            tree.add(free, n)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            free = tree.tightest(length)
            if free is None:
                free, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[free].pop()
                tree.add(free, -n)
            each = free // length
            full = min(n, left // each)
            for t in range(each if full else 0):
                runs.append((length, rank, first, capacity - free + t * length))
                rank += full
            left -= full * each
            opened(free - each * length, first, full)
            if left and full < n:
                for t in range(left if left < each else 0):
                    runs.append((length, rank, first + full, capacity - free + t * length))
                    rank += 1
                opened(free - left * length, first + full, 1)
                full, left = full + 1, 0
            opened(free, first + full, n - full)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 4), bins


#: Characters that the tokenizer's normalisation only lower-cases, one by one.
_PLAIN = re.compile("[\t\n\r -~¡-©«¬®-±¿-ÿ‘’“”–—…€]*")
#: How the tokenizer splits lower-cased text of those characters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: The normaliser and splitter for which the two patterns above hold.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Ids of words by word, as little-endian 32-bit numbers; filled when asked."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= _LONG_WORD:
            self[word] = out
        return out


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    parts = json.loads(tokenizer.to_str())
    by_word = parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == _SPLITTER and not parts["model"].get("dropout")
    return tokenizer, _Known(tokenizer.model), special, by_word


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers.

    The tokenizer lower-cases, drops white space and encodes each word by itself, so the ids of
    a plain text are those of its words, each encoded once. Texts with characters that its
    normalisation may treat otherwise, or with special strings, are given to it whole, and so are
    all texts where a tokenizer has another normaliser or splitter.
    """
    tokenizer, known, special, by_word = _tokenizer(path)
    if len(known) > KEPT_WORDS:
        known.clear()
    out = []
    for text in texts:
        lower = text.lower()
        if by_word and _PLAIN.fullmatch(text) and not any(s in text or s.lower() in lower for s in special):
            out.append(b"".join([known[w] for w in _WORD.findall(lower)]))
        else:
            out.append(np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
    return out


_TOGETHER = 1 << 19


def tokenized(path: str, capacity: int, end_id: int, id_type: pa.DataType):
    """For mapInArrow over (id, text): pieces with their task and rank by length."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def pieces(ids: list, texts: list[str]) -> pa.RecordBatch:
            rows = []
            for key, data in zip(ids, encode_texts(path, texts), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((key, k, at // 4, n, zlib.crc32(own), part, int(ranks[n])))
                    ranks[n] += 1
            kinds = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32", "part", "local"])

        for batch in batches:
            ids, texts, chars = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(key.as_py())
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars > _TOGETHER:
                    yield pieces(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield pieces(ids, texts)

    return run


def _placed(runs: np.ndarray):
    """For mapInArrow over pieces with their rank: sequence and offset."""
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            columns = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs[at, 2] + rank - runs[at, 1]), pa.array(runs[at, 3])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document of ``docs``: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is the ids of its text and ``end_id``; one longer than ``capacity`` is cut into
    full pieces and a rest. A null text counts as empty (one piece, the end id alone). Null
    ids, ties and repeated rows are documents of their own; an empty table gives no pieces;
    other columns are not read. Sequences are numbered from 0, places are gapless from 0.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    pieces = written(rows.mapInArrow(tokenized(tokenizer_path, capacity, end_id, to_arrow_type(kind)), f"{names}, part int, local long"), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # at most ``capacity`` rows
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    runs, _ = best_fit_decreasing(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("base")).alias("rank"))
    out = ranked.mapInArrow(_placed(runs), f"{names}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
