"""Token counts of whole texts; huge ones by overlapping chunks that are spliced again.

A huge text is encoded in chunks that overlap. In each overlap a boundary is looked for at which
both encodings start a token and which is proven stable: a space after a character that is not
one. No piece of the vocabulary holds a space mark after another character (checked on
loading), so no merge ever reaches across such a place and the encodings of both sides are
those of the whole text. If an overlap has none, it is widened and both chunks encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
HUGE = 32_768
CHUNK = 16_384
OVERLAP = 128
#: Characters that are encoded in one call, so that token lists stay small.
TOGETHER = 1 << 18


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _loaded(path: str):
    """The processor, and whether spaces after other characters are proven boundaries."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    plain = sp.normalize("ﬁ Ａ  b").lstrip(MARK).replace(MARK, " ") == "ﬁ Ａ  b"  # texts aren't rewritten first
    return sp, plain and not any(MARK in p.lstrip(MARK) for p in pieces)


def _starts(sp, text: str, a: int, b: int) -> np.ndarray:
    """Places in ``text`` at which the tokens of text[a:b] start, in order."""
    return a + np.fromiter((s for s, _ in sp.encode(text[a:b], return_type="offset_mapping")["offsets"]), np.int64)


def count_long(sp, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by overlapping chunks; equal to those of the whole text."""

    def stable(p: int) -> bool:
        return 0 < p and text[p] == " " and text[p - 1] not in (" ", MARK)

    total, a, done = 0, 0, 0  # chunk from a, tokens before done are counted
    while a + chunk + overlap < len(text):
        b, w = a + chunk, overlap
        while True:
            stop = min(len(text), b + w)
            if stop == len(text):
                break
            left = _starts(sp, text, a, stop)
            right = _starts(sp, text, max(a, b - w), stop)
            common = [p for p in np.intersect1d(left, right).tolist() if p > done and stable(p)]
            if common:
                break
            w *= 2
        if stop == len(text):
            break
        p = min(common, key=lambda x: abs(x - b))
        total += int(np.count_nonzero((left >= done) & (left < p)))
        # the next chunk begins before p, so that p is inside it
        a, done = max(a, p - overlap), p
    last = _starts(sp, text, a, len(text))
    return total + int(np.count_nonzero(last >= done))


def counter(path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
    """For mapInArrow over (id, text): (id, n_bytes, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, proven = _loaded(path)
        for batch in batches:
            counts, held, chars = np.zeros(batch.num_rows, np.int64), [], 0
            sizes = np.zeros(batch.num_rows, np.int64)

            def flush() -> None:
                for i, ids in zip([i for i, _ in held], sp.encode([t for _, t in held], return_type="numpy", num_threads=1), strict=True):
                    counts[i] = len(ids)
                held.clear()

            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                sizes[i] = len(text.encode())
                if proven and len(text) > huge:
                    counts[i] = count_long(sp, text, chunk, overlap)
                elif text:
                    held.append((i, text))
                    chars += len(text)
                    if chars > TOGETHER:
                        flush()
                        chars = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``, without added tokens.

    A null text counts as empty (0 bytes, 0 tokens). Texts are taken whole however long they
    are; null ids, ties and repeated rows come out as they went in; an empty table gives an
    empty result; other columns are not read. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(counter(model_path), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
