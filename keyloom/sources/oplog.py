"""Operation logs as files of framed commands, and snapshots as Parquet.

Framing: ``*N`` and a word count, then for each word ``$L``, its length and its bytes, lines
ending in CR LF; or one command a line with words apart by blanks. A half-written tail ends a file.
A line ``@seq N`` numbers the command after it, so that order holds across files.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.files import ordered_pieces, small_files
from keyloom.functions.keys import live

MAX_WORDS = 1 << 20
MAX_INLINE = 64 << 10
_END = b"\r\n"
_NUMBER = b"@seq"
#: Commands in one batch.
BATCH = 10_000
#: Commands in one written file, at most.
FILE_COMMANDS = 16_384


class FramingError(ValueError):
    """Bytes that can't be a command."""


def _size(line: bytes, what: str) -> int:
    try:
        return int(line[1:])
    except ValueError:
        raise FramingError(f"{what} expected") from None


def parse_lines(lines: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Commands of the lines of a log; a word may hold line ends. Stops before an unfinished command."""
    source = iter(lines)
    for line in source:
        if line[:1] != b"*":
            if len(line) > MAX_INLINE:
                raise FramingError("a line is too long")
            if words := line.split():
                yield words
            continue
        count = _size(line, "word count")
        if count > MAX_WORDS:
            raise FramingError("too many words")
        words = []
        for _ in range(count):
            head = next(source, None)
            if head is None:
                return
            if head[:1] != b"$":
                raise FramingError("a word's length is expected")
            size, parts = _size(head, "word's length"), []
            held = -len(_END)
            while held < size:
                part = next(source, None)
                if part is None:
                    return
                parts.append(part)
                held += len(part) + len(_END)
            word = _END.join(parts)
            if len(word) != size:
                raise FramingError("a word is longer than its length")
            words.append(word)
        if words:
            yield words


def parse(data: bytes) -> Iterator[list[bytes]]:
    """Commands of a log in memory; the last line counts only if it is closed."""
    lines = data.split(_END)
    if len(lines[-1]) > MAX_INLINE:
        raise FramingError("a line is too long")
    return parse_lines(lines[:-1])


def framed(argv: Column) -> Column:
    """A command's framing, of its words as bytes, without the last line end."""
    end = F.lit(_END)
    words = F.transform(argv, lambda w: F.concat(end, F.encode(F.concat(F.lit("$"), F.octet_length(w).cast("string")), "utf-8"), end, w.cast("binary")))
    head = F.encode(F.concat(F.lit("*"), F.size(argv).cast("string")), "utf-8")
    return F.aggregate(words, head, lambda a, w: F.concat(a, w))


def write_log(log: DataFrame, path: str) -> None:
    """Write (seq, argv) as framed, numbered files; each file holds a range of seq, in order.

    Words are strings or bytes and are kept as they are. Files hold at most ``FILE_COMMANDS`` commands, so that
    ``read_log`` parses most of them where they are read.
    """
    number = F.encode(F.concat(F.lit(_NUMBER.decode() + " "), F.col("seq").cast("string")), "utf-8")
    lines = log.repartitionByRange("seq").sortWithinPartitions("seq").select(F.concat(number, F.lit(_END), framed(F.col("argv"))).cast("string").alias("value"))
    lines.write.option("lineSep", _END.decode()).option("maxRecordsPerFile", FILE_COMMANDS).text(path)


def _parsed(files: Iterable[tuple[str, Iterable[bytes]]]) -> Iterator[pa.RecordBatch]:
    """Batches of (file, line, seq, argv) of files as their lines."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "line", "seq", "argv"])

    rows: list[tuple] = []
    for name, lines in files:
        line, number = 0, None
        for argv in parse_lines(lines):
            if argv[0] == _NUMBER and len(argv) == 2:
                number = int(argv[1])
                continue
            rows.append((name, line, number, argv))
            line, number = line + 1, None
            if len(rows) == BATCH:
                yield made(rows)
                rows = []
    if rows:
        yield made(rows)


def _of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from itertools import groupby

    pieces = (p for batch in batches for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    return _parsed((name, (piece for _, piece in own)) for name, own in groupby(pieces, key=lambda p: p[0]))


def _of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lines(data: bytes) -> list[bytes]:
        found = data.split(_END)
        return found if found[-1] else found[:-1]

    return _parsed((batch.column(0)[i].as_py(), lines(batch.column(1)[i].as_py())) for batch in batches for i in range(batch.num_rows))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, seq, argv) of the framed files below ``path``; words are bytes, ``seq`` is null where a log isn't numbered.

    Small files are parsed where they are read, without a shuffle. Larger and compressed ones are read in pieces by
    many tasks and parsed by one task each, command by command.
    """
    schema = "file string, line long, seq long, argv array<binary>"
    return small_files(spark, path).mapInArrow(_of_files, schema).unionByName(ordered_pieces(spark, path, _END.decode(), above=True).mapInArrow(_of_pieces, schema))


def write_snapshot(state: DataFrame, path: str) -> None:
    """A snapshot: Parquet, replaced as a whole."""
    state.write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, now_ms: int | None = None) -> DataFrame:
    """A snapshot's rows; those that are live at ``now_ms``, if given."""
    state = spark.read.parquet(path)
    return state if now_ms is None else live(state, now_ms)
