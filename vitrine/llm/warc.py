"""Pages as WARC archives, compressed record by record with a dictionary.

An archive starts with a skippable Zstandard frame that holds a dictionary
built from the archive's own records; every record follows as a frame of its
own, compressed with that dictionary. Spark's text writer puts the frames into
the files, so archives can lie in any store and appear only when their task is
committed. What it writes between two rows is an empty skippable frame, which
readers pass over. (It also names the files ``.txt``.)
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions import skew
from vitrine.llm import blocks
from vitrine.session import fresh_dir

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 112640
# Fixed values of the formats: magic numbers of Zstandard frames, digest alphabet, profile.
DICTIONARY_MAGIC, FIRST_SKIPPABLE, LAST_SKIPPABLE = 0x184D2A5D, 0x184D2A50, 0x184D2A5F
SEPARATOR = "P*M\x18\0\0\0\0"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPARK_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_NAME = "tag:vitrine,2024:page"
_URI_CHARACTERS = "".join(chr(c) for c in range(0x21, 0x7F))
_FEED = 16384


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 without a prefix: 40 bits of it make 8 digits."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _SPARK_DIGITS, BASE32)


def _with_originals(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Adds ``refers_to``: for a page whose payload of ``least_bytes`` or more also stands
    in a page of larger id, the largest such id."""
    same = ["payload_bytes", "payload_hash"]
    slim = pages.select("id", *same).filter(F.col("payload_bytes") >= least_bytes)
    groups = slim.groupBy(*same).agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("pages"))
    shared = groups.filter("pages > 1").drop("pages")
    joined = skew.join(pages, shared, same, "left", spread=["id"], check_small=True)
    other = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    return joined.withColumn("refers_to", F.when(other, F.col("largest"))).drop("largest", *same)


def _uri(name: str | None) -> str:
    return f"<{_NAME}>" if name is None else f"<{_NAME}/{quote(name, safe='')}>"


def _named(uri: str) -> str | None:
    start = f"<{_NAME}/"
    return unquote(uri[len(start) : -1]) if uri.startswith(start) else None


def _lines(first: str, fields: list[tuple[str, str | None]]) -> bytes:
    shown = [f"{name}: {value}" for name, value in fields if value is not None]
    return "\r\n".join([first, *shown, "", ""]).encode()


def _block_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    own = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", _block_digest(block)), ("Content-Length", str(len(block)))]
    return _lines("WARC/1.1", own) + block + b"\r\n\r\n"


def _page_record(name: str | None, url: str | None, payload: bytes, digest: str, original: str | None, moment: str) -> bytes:
    kind = "response" if original is None else "revisit"
    head = _lines("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    fields = [
        ("WARC-Record-ID", _uri(name)),
        ("WARC-Date", moment),
        ("WARC-Target-URI", None if url is None else quote(url, safe=_URI_CHARACTERS)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if original is not None else None),
        ("WARC-Refers-To", _uri(original) if original is not None else None),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return _record(kind, fields, head + payload if original is None else head)


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Built from all records of an archive; None where they are too few or too short. (Such
    an archive takes the dictionary of the task's archive before it, if there is one.)"""
    size = min(DICTIONARY_BYTES, sum(map(len, records)) // 16)
    try:
        return zstandard.train_dictionary(size, records, k=1024, d=8, f=20) if size >= 1024 else None
    except zstandard.ZstdError:
        return None


def _skippable(content: bytes) -> bytes:
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def archive_frames(records: list[bytes], dictionary: zstandard.ZstdCompressionDict | None) -> list[bytes]:
    """The frames of one archive: the dictionary, if there is one, and each record."""
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
    head = [_skippable(dictionary.as_bytes())] if dictionary else []
    return head + [compressor.compress(record) for record in records]


def write(
    pages: DataFrame,
    path: str,
    as_of: datetime,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """One WARC record per row in archives of about ``archive_bytes`` below the new folder ``path``.

    A payload is the column in UTF-8; NULL is an empty one. Of equal payloads of at
    least ``least_bytes`` the row of largest id is written as a response and the others as
    revisits that refer to it; rows without an id are revisits too where such a row
    exists, and else responses, as are repeated rows of the largest id. Every archive
    begins with a ``warcinfo`` record. A URL may be NULL; characters that no URI holds are
    percent-encoded. A payload longer than an archive has one of its own. An empty table
    writes no archive; other columns play no part.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    chosen = blocks.bounded(pages).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")
    )
    hashed = chosen.withColumns({"payload_bytes": F.octet_length("payload"), "payload_hash": F.sha2("payload", 256)})
    rows = _with_originals(hashed, least_bytes).select(
        F.col("id").cast("string"), "url", "payload", base32_sha1(F.col("payload")).alias("digest"), F.col("refers_to").cast("string")
    )
    moment = as_of.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    about = _record(
        "warcinfo",
        [("WARC-Record-ID", f"<{_NAME.replace('page', 'info')}>"), ("WARC-Date", moment), ("Content-Type", "application/warc-fields")],
        b"software: vitrine\r\nformat: WARC File Format 1.1\r\n",
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, records, held, dictionary = 0, [about], 0, None

        def closed() -> pa.RecordBatch:
            nonlocal dictionary
            dictionary = _dictionary(records) or dictionary
            frames = archive_frames(records, dictionary)
            name = f"{TaskContext.get().partitionId():06d}-{number:06d}"
            columns = [pa.array([name] * len(frames)), pa.array(range(len(frames)), pa.int32()), blocks.binaries(frames)]
            return pa.RecordBatch.from_arrays(columns, ["archive", "place", "frame"])

        for batch in batches:
            for name, url, body, digest, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records.append(_page_record(name, url, body, digest, original, moment))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield closed()
                    number, records, held = number + 1, [about], 0
        if len(records) > 1:
            yield closed()

    frames = rows.mapInArrow(blocks.tidy(run), "archive string, place int, frame binary").sortWithinPartitions("archive", "place")
    raw = frames.select(F.col("frame").cast("string").alias("value"), "archive")
    raw.write.partitionBy("archive").option("lineSep", SEPARATOR).text(path)


def archive_records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    decompressor, at = zstandard.ZstdDecompressor(), 0
    while at < len(content):
        magic = int.from_bytes(content[at : at + 4], "little")
        if FIRST_SKIPPABLE <= magic <= LAST_SKIPPABLE:
            end = at + 8 + int.from_bytes(content[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC and at == 0:
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8:end]))
            at = end
            continue
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            piece = content[at : at + _FEED]
            if not piece:
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {name: value for name, _, value in pairs}


def parsed(record: bytes) -> dict:
    """A record's fields, checked against its digests."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != _block_digest(block):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    out = {"type": fields["WARC-Type"]}
    if out["type"] == "warcinfo":
        return out
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(_fields(http)["Content-Length"])
    if out["type"] == "response" and (size != len(payload) or _block_digest(payload) != f"sha1:{digest}"):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return out | {
        "id": _named(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "date": fields["WARC-Date"],
        "payload": payload if out["type"] == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _named(fields["WARC-Refers-To"]) if out["type"] == "revisit" else None,
    }


_READ = "id string, url string, date string, type string, payload binary, payload_bytes bigint, payload_digest string, refers_to string"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The page records of all archives below ``path``, every digest checked; an archive
    is read whole by one task. A revisit has no payload; without ``payloads`` no row has."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    schema = T._parse_datatype_string(_READ)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in archive_records(content.as_py()):
                    row = parsed(record)
                    if row["type"] == "warcinfo":
                        continue
                    held += len(row["payload"] or b"")
                    rows.append(row if payloads else row | {"payload": None})
                    if held >= blocks.BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    binary = pa.binary()
    arrow = pa.schema([(f.name, binary if f.name == "payload" else pa.int64() if f.name == "payload_bytes" else pa.string()) for f in schema])
    return blocks.bounded(files.select("content")).mapInArrow(blocks.tidy(run), schema)


def archived(pages: DataFrame, as_of: datetime, id_col: str = "page_id", **options) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back: per row ``id``,
    ``payload_bytes``, ``payload_digest``, ``type`` and ``refers_to``."""
    path = fresh_dir(pages.sparkSession, "warc")
    write(pages, path, as_of, id_col, **options)
    kind = pages.schema[id_col].dataType
    back = read(pages.sparkSession, path, payloads=False)
    return back.withColumns({"id": F.col("id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).drop("payload", "url", "date")
