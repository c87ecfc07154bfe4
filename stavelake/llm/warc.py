"""Dictionary-compressed WARC archives, written and read by Spark.

An archive is one part file. Its first frame is the dictionary, in a Zstandard skippable frame; every record follows as a
frame of its own, compressed with that dictionary. Spark's text writer puts the frames out, committed per task, with an
empty skippable frame as line separator, so the file is a valid Zstandard stream on any file system Spark can reach and a
lost executor repeats its tasks only. Records with equal payloads (SHA-256) are written once, as the response with the
smallest page_id; the others are revisit records, which keep the HTTP header and so the length of the payload.

The dictionary is trained on a bounded sample: records of every size are drawn by a hash with the chance that gives
``Options.samples`` of them, and of each the stretch of at most ``sample_bytes`` of its payload that starts at a hashed
place; twice as many at most reach the driver. Every record is written and every byte of it is compressed. A task begins a
new file after some ``file_bytes``, each with the dictionary in front, so a file is never too large to be read as one value
(a record alone may be larger than that).

Defined results: null html is an empty payload; null page_ids sort last, and among equal payloads all rows with the
smallest page_id are responses (also if it is null or repeated); a null url is written as an empty target; very long
payloads are single records; an empty table gives no record. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm.common import cut, utf8

#: Fixed values of the format: skippable frame magics (the second marks a dictionary) and the empty frame as separator.
SKIPPABLE, DICTIONARY = 0x184D2A50, 0x184D2A5D
SEPARATOR = SKIPPABLE.to_bytes(4, "little").decode("latin-1") + "\0" * 4
FRAME_MAGIC = zstandard.FRAME_HEADER
READ_SCHEMA = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_READ_ARROW = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


@dataclass(frozen=True)
class Options:
    samples: int = 512
    sample_bytes: int = 32_768
    dictionary_bytes: int = 65_536
    level: int = 6
    min_payload: int = 0
    row_bytes: int = 1 << 20
    file_bytes: int = 64 << 20

    @property
    def rows_per_file(self) -> int:
        return max(1, self.file_bytes // self.row_bytes)


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_uri(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c for c in (url or "") if c not in "\r\n")),
        ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if is_revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_uri(refers_to)),
            ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple:
    """(page_id, record_type, url, digest, payload bytes, refers_to, payload) of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda name: int(fields[name]) if fields.get(name) else None
    is_revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if is_revisit else sha1(payload)
    if not is_revisit and len(payload) != length:
        raise ValueError(f"record of page {fields['X-Page-Id']}: {len(payload)} bytes of payload, {length} announced")
    return number("X-Page-Id"), fields["WARC-Type"], fields["WARC-Target-URI"], digest, length, number("X-Refers-To-Page-Id"), payload


def skippable(magic: int, content: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends: its header, its blocks, its checksum."""
    params = zstandard.get_frame_parameters(data[at : at + 18])
    pos, last = at + zstandard.frame_header_size(data[at : at + 18]), False
    while not last:
        head = int.from_bytes(data[pos : pos + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        pos += 3 + (1 if kind == 1 else size)
    return pos + 4 * params.has_checksum


def records_in(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    data, at, reader = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if magic == DICTIONARY and size:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8 : at + 8 + size])))
            at += 8 + size
        else:
            end = frame_end(data, at)
            yield reader.decompress(data[at:end])
            at = end


def dictionary(pages: DataFrame, options: Options = Options()) -> bytes:
    """A dictionary trained on a bounded sample; empty where there are too few records to train on."""
    rows = pages.select("page_id", "url", utf8(pages["html"]).alias("payload")).where(F.octet_length("payload") > 0)
    share = min(1.0, options.samples / max(1, rows.count()))
    key = F.xxhash64("page_id", "payload")
    places = F.greatest(F.octet_length("payload") - options.sample_bytes, F.lit(0)) + 1
    stretch = F.substring("payload", (F.pmod(F.xxhash64(key), places) + 1).cast("int"), F.lit(options.sample_bytes))
    drawn = rows.where(F.pmod(key, F.lit(1 << 32)) < int(share * (1 << 32)))
    sample = drawn.select("page_id", "url", stretch.alias("payload")).limit(2 * options.samples).collect()
    records = sorted(record_bytes(r["page_id"], r["url"], bytes(r["payload"]), None, False) for r in sample)
    if len(records) < 16:
        return b""
    return zstandard.train_dictionary(min(options.dictionary_bytes, sum(map(len, records)) // 8), records).as_bytes()


def linked(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, is_revisit."""
    rows = pages.select(
        pages["page_id"], pages["url"], utf8(pages["html"]).alias("payload"),
    ).withColumn("key", F.unhex(F.sha2("payload", 256)))
    repeated = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = cut(repeated)  # written, so that the join below can split a payload that very many pages share
    is_revisit = F.coalesce(F.octet_length("payload") >= min_payload, F.lit(False)) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(again, "key", "left")
    return joined.select("page_id", "url", "payload", F.when(is_revisit, F.col("first")).alias("refers_to"), is_revisit.alias("is_revisit"))


def write(pages: DataFrame, path: str, options: Options = Options()) -> None:
    """Archives of all pages below ``path``."""
    trained = pages.sparkSession.sparkContext.broadcast(dictionary(pages, options))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = trained.value
        data = zstandard.ZstdCompressionDict(raw) if raw else None
        compressor = zstandard.ZstdCompressor(level=options.level, dict_data=data, write_content_size=True)
        row, held, n_rows = [], 0, 0
        for batch in batches:
            for fields in zip(*(batch.column(i) for i in range(batch.num_columns))):
                if not row and n_rows % options.rows_per_file == 0:
                    row.append(skippable(DICTIONARY, raw))
                row.append(compressor.compress(record_bytes(*(v.as_py() for v in fields))))
                held += len(row[-1])
                if held >= options.row_bytes:
                    yield pa.record_batch([pa.array([b"".join(row)], pa.binary())], ["frames"])
                    row, held, n_rows = [], 0, n_rows + 1
        if row:
            yield pa.record_batch([pa.array([b"".join(row)], pa.binary())], ["frames"])

    made = linked(pages, options.min_payload).mapInArrow(frames, "frames binary")
    lines = made.select(F.col("frames").cast("string").alias("value"))
    lines.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", options.rows_per_file).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``; the payload of a revisit is empty, its length and digest are not."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for record in records_in(content.as_py()):
                    rows.append(parsed(record))
                    held += len(record)
                    if held > 1 << 22:
                        yield pa.record_batch(list(map(pa.array, zip(*rows), _READ_ARROW.types)), schema=_READ_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch(list(map(pa.array, zip(*rows), _READ_ARROW.types)), schema=_READ_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(unpack, READ_SCHEMA)
