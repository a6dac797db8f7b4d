"""WARC archives through a chunked record table.

A record's payload is a run of rows (record, chunk number, bytes), cut where the table's own cell is read:
no later step, shuffle or sort holds a whole payload. Digests are carried from chunk to chunk. A long
payload is written as WARC segments (a response record and its continuations), each of one chunk, and read
back the same way.

Archives are gzip text files of the shared folder, written and read by Spark, so that any file system
and any lost task is handled by Spark's committer. The reader cuts the stream where a record may begin
and puts together by Content-Length what a payload with such bytes parted; it reads archives of other
writers too. gzip files are never split, so a record's segments reach one reader in order; the reader
checks that.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path

#: Bytes of a chunk.
CHUNK = 16 * 1024
_CRLF, _BEGIN = "\r\n", "WARC/1."
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
#: Archives say when they were made only if the caller does; equal input then gives equal records.
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_rows(rows: DataFrame, payload: str = "payload", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the binary column ``payload`` replaced by chunk_no, chunks and chunk; an empty payload has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / chunk)).cast("int")
    out = rows.withColumn("chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return out.withColumn("chunk", F.substring(F.col(payload), F.col("chunk_no") * chunk + 1, F.lit(chunk))).drop(payload)


def payload_digests(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, tag, payload) -> (id, tag, payload_bytes, payload_digest), by a digest carried over a record's chunk rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha1(), 0
        for batch in batches:
            keys, out = [], ([], [])
            for k, (no, of, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk_no", "chunks", "chunk")), strict=True)):
                if no == 0:
                    state, size = hashlib.sha1(), 0
                state.update(part)
                size += len(part)
                if no == of - 1:
                    keys.append(k)
                    out[0].append(size)
                    out[1].append(_b32(state.digest()))
            at = pa.array(keys, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("tag").take(at), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["id", "tag", "payload_bytes", "payload_digest"])

    return chunk_rows(rows, "payload", chunk).select("id", "tag", "chunk_no", "chunks", "chunk").mapInArrow(run, "id long, tag long, payload_bytes long, payload_digest string")


def _urn(*parts):
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in at]), F.lit(">"))


def _line(name: str, value):
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))


def write_warc(pages: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html", min_bytes: int = 0, chunk: int = CHUNK, date: str = DATE) -> str:
    """Writes a record per row of ``pages`` to archives in the shared folder; gives their folder.

    Of records with equal payloads of at least ``min_bytes`` bytes, those with the largest key are
    responses and the others revisits that refer to it. A null body is an empty payload, a null uri has no
    WARC-Target-URI. A row with a null key is a revisit if its group has a key at all, else a response.
    Rows that repeat key and payload give records alike. Payloads of any length are written whole, as
    segments; other columns are ignored, whatever their names. An empty table gives no records.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(body).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("tag", F.xxhash64("id", "payload"))
    meta, _ = materialise(payload_digests(rows.select("id", "tag", "payload"), chunk).distinct(), "digests")
    # only payloads that occur under several keys need a partner; the table of them is written first, so that
    # the join's sides are plain exchanges and a payload with very many copies is split over tasks
    first = meta.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("id").alias("first"), F.min("id").alias("least"), (F.count(F.lit(1)) > F.count("id")).alias("keyless"))
    first, _ = materialise(first.where("first > least OR (keyless AND first IS NOT NULL)").select("payload_digest", "first"), "first")
    meta = meta.join(first, "payload_digest", "left")
    refers = F.when((F.col("payload_bytes") >= min_bytes) & (F.coalesce(F.col("id") < F.col("first"), F.col("first").isNotNull())), F.col("first"))
    meta = meta.select(F.col("tag"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), "payload_bytes", "payload_digest", refers.alias("refers"))
    meta, _ = materialise(meta, "types")
    # chunk rows meet the small table of types; row keeps the chunks of records alike apart, and all in order
    rows = rows.withColumns({"name": F.coalesce(F.col("id").cast("string"), F.lit("")), "row": F.monotonically_increasing_id()})
    rows = chunk_rows(rows, "payload", chunk).join(meta.hint("shuffle_hash"), ["tag", "name"])
    revisit = F.col("refers").isNotNull()
    rows = rows.where(~revisit | (F.col("chunk_no") == 0)).withColumns({"chunk": F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("chunk")), "chunks": F.when(revisit, F.lit(1)).otherwise(F.col("chunks"))})
    rows = rows.sortWithinPartitions("name", "tag", "row", "chunk_no")
    path = new_path(spark, "warc")
    start, last = F.col("chunk_no") == 0, F.col("chunk_no") == F.col("chunks") - 1
    many = F.col("chunks") > 1
    origin = _urn("name", "payload_digest")
    block = F.when(start, F.concat(F.lit(_HTTP).cast("binary"), F.col("chunk"))).otherwise(F.col("chunk"))
    kind = F.when(revisit, F.lit("revisit")).when(start, F.lit("response")).otherwise(F.lit("continuation"))
    head = F.concat(
        F.lit(f"{_BEGIN}1{_CRLF}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.when(start, origin).otherwise(_urn("name", "payload_digest", F.col("chunk_no")))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("uri", "[\\x00-\\x20]+", "%20")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Segment-Number", F.when(many, (F.col("chunk_no") + 1).cast("string"))),
        _line("WARC-Segment-Origin-ID", F.when(~start, origin)),
        _line("WARC-Segment-Total-Length", F.when(many & last, (F.col("payload_bytes") + len(_HTTP)).cast("string"))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers"), "payload_digest"))),
        _line("X-Refers-To-Key", F.col("refers").cast("string")),
        _line("X-Key", F.col("id").cast("string")),
        _line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        _line("X-Segments", F.col("chunks").cast("string")),
        _line("Content-Type", F.when(start, F.lit("application/http; msgtype=response"))),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_CRLF),
    )
    record = F.concat(head.cast("binary"), block).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", _CRLF * 2).option("compression", "gzip").text(path)
    return path


class Records:
    """Puts records together from the pieces of a stream that was cut at every blank line before ``WARC/1.``."""

    def __init__(self):
        self.held, self.block, self.need = bytearray(), -1, 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
        """(headers by lower-case name, block) of every record that ``piece`` completes."""
        if self.held:
            self.held += f"{_CRLF}{_CRLF}{_BEGIN}".encode()
        elif not piece.startswith(_BEGIN.encode()):
            self.held += _BEGIN.encode()
        self.held += piece
        while self.held:
            if self.block < 0:
                self.block = self.held.find(b"\r\n\r\n") + 4
                if self.block < 4:
                    self.block = -1
                    return
                lines = (line.partition(b":") for line in bytes(self.held[: self.block]).split(b"\r\n")[1:])
                self.head = {name.strip().lower(): value.strip() for name, _, value in lines if name}
                self.need = int(self.head[b"content-length"])
            end = self.block + self.need
            if len(self.held) < end:
                return
            yield self.head, bytes(self.held[self.block : end])
            rest = self.held[end:].lstrip(b"\r\n")
            if rest and not rest.startswith(_BEGIN.encode()):
                raise ValueError(f"no record begins after that of {self.head.get(b'warc-record-id')!r}")
            self.held, self.block = rest, -1

    def close(self) -> None:
        if self.held:
            raise ValueError("an archive ends within a record")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of WARC archives, those of :func:`write_warc` and others.

    Columns: record_id, key, uri, record_type, refers_to, chunk_no, chunks, chunk, and running_bytes and
    running_digest, the length and digest of the payload up to and with this chunk. A payload is what follows
    the HTTP headers, or the whole block where there are none. A revisit has one row without bytes; its running
    values are those that its headers give for the payload it refers to. key, refers_to and the number of
    segments come from headers of this writer: null, null and one in archives of others. Raises if segments
    are missing or out of order, or if a payload doesn't have the SHA-1 in its header.
    """
    schema = "record_id string, key long, uri string, record_type string, refers_to long, chunk_no int, chunks int, chunk binary, running_bytes long, running_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, state, size, due, name = Records(), hashlib.sha1(), 0, 1, b""
        for batch in batches:
            out: list[tuple] = []
            for h, block in (r for value in batch.column(0) for r in records.feed(value.as_py())):
                kind, no, of = h[b"warc-type"], int(h.get(b"warc-segment-number", 1)), int(h.get(b"x-segments", 1))
                origin = h.get(b"warc-segment-origin-id", h[b"warc-record-id"])
                if no == 1:
                    if due != 1:
                        raise ValueError(f"record {name!r} ends before its segment {due}")
                    state, size, name = hashlib.sha1(), 0, origin
                    if h.get(b"content-type", b"").startswith(b"application/http"):
                        block = block.partition(b"\r\n\r\n")[2]
                elif no != due or origin != name:
                    raise ValueError(f"segment {no} of {origin!r} is out of order")
                due = no + 1 if no < of else 1
                state.update(block)
                size += len(block)
                digest, told = _b32(state.digest()), h.get(b"warc-payload-digest", b"").decode()
                told = told[5:] if told.lower().startswith("sha1:") else None
                long = int(h[b"x-payload-bytes"]) if b"x-payload-bytes" in h else None
                revisit = kind == b"revisit"
                if not revisit and no == of and (digest != (told or digest) or size != (size if long is None else long)):
                    raise ValueError(f"payload of {name!r} doesn't have its digest")
                key, refers, uri = h.get(b"x-key"), h.get(b"x-refers-to-key"), h.get(b"warc-target-uri")
                out.append((origin.decode(), key and int(key), uri and uri.decode(), "response" if kind == b"continuation" else kind.decode(), refers and int(refers), no - 1, of, block, long if revisit else size, told if revisit else digest))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["record_id", "key", "uri", "record_type", "refers_to", "chunk_no", "chunks", "chunk", "running_bytes", "running_digest"])
        records.close()
        if due != 1:
            raise ValueError(f"record {name!r} ends before its segment {due}")

    return spark.read.option("lineSep", f"{_CRLF}{_CRLF}{_BEGIN}").text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html", min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Writes ``pages`` as archives and reads them back: key, payload_bytes, payload_digest, record_type, refers_to of each record."""
    path = write_warc(pages, key, uri, body, min_bytes, chunk)
    records = read_warc(pages.sparkSession, path).where("chunk_no = chunks - 1")
    return records.select(F.col("key").alias(key), F.col("running_bytes").alias("payload_bytes"), F.col("running_digest").alias("payload_digest"), "record_type", "refers_to")


