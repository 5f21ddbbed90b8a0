"""WARC archives: writing with segmentation, chunked framing and revisits, and reading back.

Writing. A record is an HTTP response whose body is framed in chunks. A block longer than a
segment is cut into a first record and continuation records (``WARC-Segment-Number``,
``WARC-Segment-Origin-ID``, the last with ``WARC-Segment-Total-Length``). Of equal payloads the
one with the smallest id is stored, the others become revisit records that name its record
(``WARC-Refers-To``). Record identifiers are made of the row, so archives are the same each time.
Spark's text writer stores the records; its line separator is the end mark of a record, so the
files are archives, committed by task, in any store that Spark writes. A compressed file is one gzip
member, as Spark's writers make it.

Reading. Files come in pieces between end marks and are parsed record by record, so a task holds
a record and never a file. Whole responses are decoded where they stand;
segments are shuffled by the identifier of their origin, ordered by segment number, joined,
checked against the total length and then decoded. The payload's SHA-256 has to be the one
that its record declares. A revisit is joined with the record that it names and takes that
record's verified length, digest and payload; one without such a record is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.files import ordered_pieces

from .common import new_path, written

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
REVISIT_BYTES = 100
#: Bounds a file: so many records of at most a segment each.
RECORDS_PER_FILE = 4_096
END = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """A record is damaged or segments are missing."""


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``body`` in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0:
            raise ArchiveError("chunk size is missing")
        size = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ArchiveError("a chunk is cut off")
        parts.append(framed[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, with its transfer framing decoded."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ArchiveError("no HTTP header")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(c for c in url if c >= " " and c != "\x7f")


DATE = "2026-01-01T00:00:00Z"


def records(uid: str, key: str | None, url: str | None, payload: bytes, digest: str, refers: str | None, refers_url: str | None = None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, without their closing mark; ``refers``: the identifier of the record that has its payload."""
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _clean(url))]
    own = [("WARC-Record-ID", f"<urn:uuid:{uid}>"), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Source-Key", key and quote(key)), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), *own, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers}>"), ("WARC-Refers-To-Target-URI", _clean(refers_url)), ("WARC-Refers-To-Date", DATE)], HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *own], block)
        return
    yield _record([("WARC-Type", "response"), *own, ("WARC-Segment-Number", 1)], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        last = at + segment >= len(block)
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uid}-{number}>"), *common, ("WARC-Segment-Origin-ID", f"<urn:uuid:{uid}>"), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", len(block) if last else None)], block[at : at + segment])


def _writer(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i) for i in range(7)), strict=True)
            out, held = [], 0
            for row in rows:
                uid, key, url, payload, digest, refers, refers_url = (x.as_py() for x in row)
                for record in records(uid, key, url, payload.encode(), digest, refers, refers_url, segment):
                    out.append(record)
                    held += len(record)
                if held > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def _identifier(key: Column, url: Column, digest: Column) -> Column:
    """A record's identifier, in the form of a UUID, of what it is made of."""
    h = F.md5(F.concat_ws("\x01", F.coalesce(key.cast("string"), F.lit("\x00")), F.coalesce(url, F.lit("\x00")), digest))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT_BYTES, compression: str = "gzip") -> None:
    """Write a record (or its segments) for each row of ``pages`` to archives below ``path``.

    Payload: the html in UTF-8, empty for null. Of payloads of at least REVISIT_BYTES that are
    equal, those of the smallest id are responses and the others revisit it; repeated rows of
    the smallest id are all responses, rows with a null id are never referred to. Rows that are
    the same throughout are one record, stored as often as they occur. Nothing but digests,
    ids and URLs is shuffled.
    """
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    key, url = F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url")
    # digests are taken once for all that needs them; pages are read again only to be written
    seen = written(pages.select(key, url, F.sha2(F.encode(text, "utf-8"), 256).alias("digest"), (F.octet_length(text) >= REVISIT_BYTES).alias("long")).where("long").drop("long"), "digests")
    # partial counts meet by digest; only digests that occur twice are joined back, and no key is a hot one there
    firsts = seen.groupBy("digest").agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    others = seen.join(firsts, "digest").where(F.col("key") != F.col("first.key")).select("key", "digest", "first").distinct()
    refers = _identifier(F.col("first.key"), F.col("first.url"), F.col("digest"))
    others = written(others.select("key", "digest", refers.alias("refers"), F.col("first.url").alias("refers_url")), "revisits")  # Spark then knows its size and broadcasts it only if small; pages stay where they are
    rows = pages.select(key, url, text.alias("payload"), F.sha2(F.encode(text, "utf-8"), 256).alias("digest"))
    sent = rows.join(others, ["key", "digest"], "left")
    sent = sent.select(_identifier(F.col("key"), F.col("url"), F.col("digest")).alias("uid"), F.col("key").cast("string").alias("key"), "url", "payload", "digest", "refers", "refers_url")
    lines = sent.mapInArrow(_writer(segment), "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def records_of(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, of the pieces between its end marks."""
    source, buffer = iter(pieces), bytearray()

    def filled(n: int) -> bool:
        while len(buffer) < n:
            piece = next(source, None)
            if piece is None:
                return False
            buffer.extend(piece)
            buffer.extend(END)
        return True

    while filled(1):
        stop = buffer.find(END)
        if stop < 0 or not buffer.startswith(b"WARC/1."):
            raise ArchiveError("no record where one should start")
        lines = buffer[:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size, at = int(headers["content-length"]), stop + len(END)
        if not filled(at + size + len(END)) or buffer[at + size : at + size + len(END)] != END:
            raise ArchiveError("a record is cut off")
        block = bytes(buffer[at : at + size])
        del buffer[: at + size + len(END)]
        yield headers, block


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive in memory."""
    pieces = data.split(END)
    return records_of(pieces if pieces[-1] else pieces[:-1])


_NAMES = ["origin", "number", "total", "kind", "key", "refers", "digest", "bytes", "block"]
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
_SCHEMA = "origin string, number long, total long, kind string, key string, refers string, digest string, bytes long, block binary"


def _verified(payload: bytes, declared: str | None) -> str:
    digest = hashlib.sha256(payload).hexdigest()
    if declared is not None and declared.removeprefix("sha256:") != digest:
        raise ArchiveError(f"payload digest {digest} isn't the declared {declared}")
    return digest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _reader(with_payload: bool):
    """For mapInArrow over (file, piece) in order: whole records decoded, segments and revisits as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((name, piece.as_py()) for batch in batches for name, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        rows, held = [], 0
        for _, own in groupby(pieces, key=lambda p: p[0]):
            for h, block in records_of(piece for _, piece in own):
                kind, number = h["warc-type"], h.get("warc-segment-number")
                origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                key = unquote(h["warc-source-key"]) if "warc-source-key" in h else None
                declared = h.get("warc-payload-digest")
                if kind == "revisit":
                    rows.append((origin, None, None, kind, key, h.get("warc-refers-to"), declared and declared.removeprefix("sha256:"), None, None))
                elif number is not None:
                    total = h.get("warc-segment-total-length")
                    rows.append((origin, int(number), total and int(total), kind, key, None, declared, None, block))
                elif kind == "response":
                    payload = payload_of(block)
                    rows.append((origin, None, None, kind, key, None, _verified(payload, declared), len(payload), payload if with_payload else None))
                held += len(rows[-1][-1] or b"") + 300 if rows else 0
                if held > 1 << 21:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length or None, part) in any order."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ArchiveError("segments are missing or repeated")
    block = b"".join(s[2] for s in segments)
    if segments[-1][1] is None or segments[-1][1] != len(block):
        raise ArchiveError(f"{len(block)} bytes of segments, {segments[-1][1]} declared")
    return block


def _assembler(with_payload: bool):
    """For mapInArrow over segments sorted by origin and number; holds one record at most.

    A record that is stored more than once comes out as often: each of its segments has to be
    there that many times, and the same.
    """

    def finish(held: list[list]) -> list[tuple]:
        first, copies = held[0][0], held[0][1]
        if any(n != copies for _, n in held):
            raise ArchiveError("segments are missing or repeated")
        payload = payload_of(reassemble([(r[1], r[2], r[8]) for r, _ in held]))
        return [(first[0], None, None, "response", first[4], first[5], _verified(payload, first[6]), len(payload), payload if with_payload else None)] * copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(_NAMES))), strict=True):
                if held and held[0][0][0] != row[0]:
                    out += finish(held)
                    held = []
                if held and held[-1][0] == row:
                    held[-1][1] += 1
                else:
                    held.append([row, 1])
            if out:
                yield _batch(out)
        if held:
            yield _batch(finish(held))

    return run


def read_warc(spark, path: str, with_payload: bool = True) -> DataFrame:
    """(record_id, key, payload_bytes, payload_digest, record_type, refers_to_id, refers_to_key[, payload]) of each
    response and revisit in the archives below ``path``, compressed (.gz) or plain and of any size.

    A revisit's bytes, digest and payload are those of the record that it names. Records of other types
    are skipped. Raises for damaged records, missing segments, wrong lengths or digests, and for revisits
    whose record is absent or has another digest than they declare. No archives give an empty result.
    """
    # a compressed file is read by one task and in order; the pieces of plain ones are put in order
    packed = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.gz").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    plain = ordered_pieces(spark, path, END.decode(), "*[^z]")
    parsed = packed.mapInArrow(_reader(with_payload), _SCHEMA).unionByName(plain.mapInArrow(_reader(with_payload), _SCHEMA))
    parsed = written(parsed, "records")  # without payloads only segments have their bytes
    split = parsed.where("number is not null").repartition("origin").sortWithinPartitions("origin", "number", "kind", "block")
    joined = written(split.mapInArrow(_assembler(with_payload), _SCHEMA), "assembled")
    names = {"origin": "record_id", "key": "key", "bytes": "payload_bytes", "digest": "payload_digest", "kind": "record_type", **({"block": "payload"} if with_payload else {})}
    responses = parsed.where("number is null and kind = 'response'").unionByName(joined).select(*[F.col(c).alias(n) for c, n in names.items()])
    revisits = parsed.where("kind = 'revisit'").select(F.col("origin").alias("own_id"), F.col("key").alias("own_key"), F.col("refers").alias("refers_to_id"), F.col("digest").alias("declared"))
    # written, so that Spark knows its size; records stored twice count once
    asked = responses.join(revisits.select(F.col("refers_to_id").alias("record_id")).distinct(), "record_id", "left_semi")
    others = [c for c in responses.columns if c != "record_id"]
    targets = written(asked.groupBy("record_id").agg(F.first(F.struct(*others)).alias("t")), "targets").withColumnRenamed("record_id", "refers_to_id")
    found = revisits.join(targets, "refers_to_id", "left")
    wrong = F.when(F.col("t").isNull(), F.concat(F.lit("revisit of an absent record: "), F.coalesce("refers_to_id", F.lit("none")))).when(
        F.col("declared") != F.col("t.payload_digest"), F.concat(F.lit("a revisit's digest isn't that of its record: "), F.col("own_id")))
    size = F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("t.payload_bytes"))
    more = [F.col("t.payload")] if with_payload else []
    resolved = found.select(F.col("own_id").alias("record_id"), F.col("own_key").alias("key"), size.alias("payload_bytes"), "t.payload_digest", F.lit("revisit").alias("record_type"), "refers_to_id", F.col("t.key").alias("refers_to_key"), *more)
    none = F.lit(None).cast("string")
    return responses.select("record_id", "key", "payload_bytes", "payload_digest", "record_type", none.alias("refers_to_id"), none.alias("refers_to_key"), *(["payload"] if with_payload else [])).unionByName(resolved)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and return what is read back, one row for each page.

    (id, payload_bytes, payload_digest, record_type, refers_to); see ``write_warc`` for nulls,
    ties and repeated rows. An empty table gives an empty result; other columns are not read.
    """
    path = path or new_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    return read_warc(pages.sparkSession, path, with_payload=False).select(
        F.col("key").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast(kind).alias("refers_to"))
