"""WARC archives in Zstandard with a dictionary of their own.

An archive starts with a skippable frame that holds a dictionary trained on the
first of its records; every record is then a frame of its own, so it can be read
from its offset. Pages with the same payload are stored once: the one with the
smallest id is the response, the others are revisits of it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import new_path, ship_code, shuffle_partitions, written

#: Magic number of the skippable frame with the dictionary (fixed by the archive format).
DICTIONARY_FRAME = 0x184D2A5D
#: Payloads below this many bytes are always stored themselves.
LEAST_REVISIT = 100
#: Bytes of records that an archive's dictionary is trained on at most, and the dictionary's size.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
#: An archive is closed beyond so many bytes of compressed records.
ARCHIVE_BYTES = 1 << 30
_STEP = 16 << 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6f1c8e0e-3b1d-5f0a-9a52-7f0c4d1e2b3a")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    """A header value without line breaks and other control characters, which are percent-encoded."""
    return "".join(c if ord(c) >= 0x20 and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """A response record, or a revisit of page ``first``."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-Id: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Type, ids, digest, size and payload of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    out = {"record_type": fields["WARC-Type"], "page_id": None, "refers_to": None, "url": fields.get("WARC-Target-URI")}
    if out["record_type"] == "warcinfo":
        return out
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if out["record_type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = {k: int(fields[x]) if x in fields else None for k, x in (("page_id", "X-Page-Id"), ("refers_to", "X-Refers-To-Page-Id"))}
    return out | number | {"payload_bytes": size, "payload_digest": digest, "payload": payload if out["record_type"] == "response" else None}


class ArchiveWriter:
    """Writes one archive: dictionary, then records, each a frame."""

    def __init__(self, sink: pa.NativeFile, date: str, level: int = 6) -> None:
        self.sink, self.date, self.level = sink, date, level
        self.held: list[bytes] = []
        self.held_bytes = self.size = self.records = 0
        self.squeeze: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.squeeze is None:
            self.held.append(record)
            self.held_bytes += len(record)
            if self.held_bytes >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(self.squeeze.compress(record))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        try:
            d = zstandard.train_dictionary(DICTIONARY_BYTES, [x[: 16 << 10] for x in self.held], k=256, d=8)
        except zstandard.ZstdError:  # too few or too small records to train on: their text is the dictionary
            d = zstandard.ZstdCompressionDict(b"".join(self.held)[:DICTIONARY_BYTES].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(d.as_bytes())) + d.as_bytes())
        d.precompute_compress(level=self.level)
        self.squeeze = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=True)
        body = b"software: siltstone\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {self.date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
        self._put(self.squeeze.compress(head.encode() + body + b"\r\n\r\n"))
        for r in self.held:
            self._put(self.squeeze.compress(r))
        self.held = []

    def close(self) -> None:
        if self.squeeze is None:
            self._begin()
        self.sink.close()


def read_records(source: pa.NativeFile) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    raw = source.read(n)
    trained = raw[:4] == b"\x37\xa4\x30\xec"  # the magic number of a trained dictionary
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    expand = zstandard.ZstdDecompressor(dict_data=d)
    data, at = b"", 0
    while True:
        frame, parts = expand.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                data, at = source.read(4 << 20), 0
                if not data:
                    if parts:
                        raise ValueError("an archive ends within a record")
                    return
            fed = data[at : at + _STEP]
            parts.append(frame.decompress(fed))
            at += len(fed) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(parts)


FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    done, writer, name = [], None, ""

    def end() -> None:
        writer.close()
        done.append({"file": f"{folder}/{name}", "records": writer.records, "bytes": writer.size})

    for b in batches:
        columns = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
        for i in range(b.num_rows):
            row = {c: v[i].as_py() for c, v in columns.items()}
            if writer is None:
                fs.create_dir(root, recursive=True)
                name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"  # a repeated attempt has files of its own
                writer = ArchiveWriter(fs.open_output_stream(f"{root}/{name}"), date)
            writer.add(make_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["_digest"], row["_first"], date))
            if writer.size > ARCHIVE_BYTES:
                end()
                writer = None
    if writer is not None:
        end()
    yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all pages to archives; returns the written table of files (file, records, bytes).

    Of pages with equal payloads of at least 100 bytes the one with the smallest
    id is a response, the others revisit it; rows that repeat the smallest id are
    responses as well. A null page is an empty payload. A null id is none, and
    never the smallest; pages with null ids alone are all responses. A null URL
    is left out. Without a folder a new one is made below ``spark.checkpoint.dir``.
    Only the three columns named are read, so others may have any names; an empty
    table gives no files. All payloads are shuffled once, by page, as that keeps
    copies of one payload apart.
    """
    spark = pages.sparkSession
    ship_code(spark)
    folder = folder or new_path(spark, "archives")
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha2(body, 256).alias("_digest"), F.octet_length(body).alias("_n"))
    narrow = rows.where(F.col("_n") >= LEAST_REVISIT).select("page_id", "_digest")
    narrow = written(narrow, "digests")
    first = written(narrow.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("n")).where("n > 1 AND _first IS NOT NULL").select("_digest", "_first"), "first-pages")
    # Joined by page, not by digest: copies of one payload are dealt out evenly.
    revisits = narrow.join(first, "_digest").where(~F.col("page_id").eqNullSafe(F.col("_first"))).distinct()
    revisits = revisits.select(F.col("page_id").alias("_p"), F.col("_digest").alias("_d"), "_first")
    key = [F.col("page_id").eqNullSafe(F.col("_p")), F.col("_digest") == F.col("_d")]
    dealt = rows.join(revisits, key, "left").select("page_id", "url", "html", "_digest", "_first")
    return written(dealt.mapInArrow(lambda b: _write(b, folder, date), FILES), "archive-list")


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _read(batches: Iterator[pa.RecordBatch], schema: pa.Schema, payload: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file in b.column(b.schema.get_field_index("file")).to_pylist():
            fs, path = pa.fs.FileSystem.from_uri(file)
            with fs.open_input_stream(path) as f:
                held, size = [], 0
                for raw in read_records(f):
                    record = parse_record(raw)
                    if record["record_type"] == "warcinfo":
                        continue
                    size += len(raw) if payload else 100
                    held.append(record if payload else record | {"payload": None})
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """One row per page of the archives; a revisit's payload is null, its size and digest are those of the full payload."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RECORD)
    return files.select("file").repartition(shuffle_partitions(files.sparkSession), "file").mapInArrow(lambda b: _read(b, schema, payload), RECORD)
