"""WARC archives, Zstandard-compressed with a dictionary.

A file starts with a skippable frame that holds the dictionary (itself a Zstandard frame); each
record follows as a frame of its own. Pages with equal payloads of some length are archived
once: the one with the largest id as a response, the others as revisits that name it and carry
only the HTTP header. Spark finds the copies and deals out the rows; a task writes one file.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import math
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_files, arrow_uri, one_a_task, shared_folder, split_join, written

#: The magic number of a dictionary's skippable frame.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
DATE = datetime.datetime(2000, 1, 1, tzinfo=datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def payloads_of(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, length) of each page; a null text is an empty payload."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(page_id).alias("page_id"), url.alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumns({"digest": F.sha1("payload"), "length": F.length("payload")})


def with_revisits(rows: DataFrame, least: int = 1000) -> DataFrame:
    """Adds refers_to to rows of payloads_of(): null for responses.

    Copies meet by digest and length; counts are added up before the shuffle, and the copies of one page are dealt to
    several tasks where they are many. A payload of a revisit is not carried on, only its digest and length.
    Pages alike in id and payload are all responses; a null id is smaller than any other.
    """
    kept = rows.where(F.col("length") >= least).groupBy("digest", "length").agg(F.max("page_id").alias("_kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = F.col("_kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_kept"))
    found = split_join(rows, kept, ["digest", "length"], rows.count(), ["page_id"], "left").withColumn("refers_to", F.when(other, F.col("_kept")))
    return found.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "length", "refers_to")


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")))


def _block(payload: bytes | None, digest: str, length: int, uri: str, url: str | None, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{uri}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(rows: DataFrame, records: int = 400, longest: int = 65536, size: int = 32768) -> bytes:
    """A dictionary of at most `size` bytes from a bounded sample: whole payloads of at most `longest`
    bytes, the `records` of them with the smallest hashes. Where they are too few or too alike to train on, the dictionary is
    their own bytes, after an empty record's."""
    few = rows.where(F.length("payload").between(64, longest))
    # twice the records wanted are taken by hash before they are ordered: else every task would send so many to the driver
    share = min(1.0, 2 * records / max(1, few.count()))
    spot = F.pmod(F.xxhash64("page_id", "digest"), F.lit(1 << 30))
    near = few.where(spot < F.lit(math.ceil(share * (1 << 30))))
    sample = near.orderBy(spot, "digest").limit(records).select("payload", "digest", "length", record_uri(F.col("page_id")), "url").collect()
    texts = [_block(bytes(r[0]), r[1], r[2], r[3], r[4], None) for r in sample]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join([_block(b"", hashlib.sha1(b"").hexdigest(), 0, "urn:page:0", "http://", None), *texts])[:size]


def write(rows: DataFrame, folder: str, trained: bytes, level: int = 6) -> DataFrame:
    """Writes one file per partition of rows; returns (file, records, bytes), a table in the folder.

    A file appears whole, under a name of its own for each attempt; the table names those
    of the attempts that counted, so a task that is run again leaves nothing wrong behind.
    """
    arrow_uri(folder)
    packed = zstandard.ZstdCompressor(level=19).compress(trained)
    records = rows.select("payload", "digest", "length", record_uri(F.col("page_id")).alias("uri"), "url", F.when(F.col("refers_to").isNotNull(), record_uri(F.col("refers_to"))).alias("refers"))

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = arrow_files(folder)
        target.create_dir(base, recursive=True)
        short = f"records-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.zst"
        name = f"{base}/{short}"
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained))
        n = size = 0
        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out = target.open_output_stream(name + ".part", buffer_size=1 << 20)
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
                frame = packer.compress(_block(*(batch.column(c)[i].as_py() for c in range(6))))
                out.write(frame)
                n, size = n + 1, size + len(frame)
        if out is not None:
            out.close()
            target.move(name + ".part", name)
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{short}"], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return written(records.mapInArrow(write_part, "file string, records long, bytes long"), f"{folder}/manifest")


def records_of(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one archive, one record in memory at a time."""
    first = stream.read(8)
    packed = b""
    if len(first) == 8 and struct.unpack("<II", first)[0] == DICTIONARY_FRAME:
        packed = stream.read(struct.unpack("<II", first)[1])
    else:
        stream.seek(0)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))) if packed else zstandard.ZstdDecompressor()
    lines = io.BufferedReader(reader.stream_reader(stream, read_across_frames=True), 1 << 16)
    while line := lines.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        fields = {}
        while line := lines.readline().rstrip(b"\r\n"):
            key, _, value = line.decode().partition(":")
            fields[key] = value.strip()
        block = lines.read(int(fields["Content-Length"]))
        lines.read(4)
        yield fields, block


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names; digests of responses are taken from the payload read.

    A response whose payload does not have the digest in its header fails the job.
    """

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                source, path = arrow_files(name)
                with source.open_input_file(path) as stream:
                    for fields, block in records_of(stream):
                        head, _, body = block.partition(b"\r\n\r\n")
                        http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{name}: {fields['WARC-Record-ID']} is damaged")
                        refers = fields.get("WARC-Refers-To")
                        length = len(body) if fields["WARC-Type"] == "response" else int(http["Content-Length"])
                        rows.append((fields["WARC-Record-ID"][1:-1], fields["WARC-Type"], fields.get("WARC-Target-URI"), refers and refers[1:-1], length, digest, body if payloads else None))
                        size += len(body)
                        if size > 1 << 24 or len(rows) >= 2000:
                            yield _batch(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    files = one_a_task(manifest, "file")
    return files.mapInArrow(read_files, SCHEMA)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", html: str = "html", least: int = 1000) -> DataFrame:
    """Writes pages to WARC files below folder and returns the table of files.

    Empty tables give no file and an empty table. Extra columns do not matter; a table
    without a url column gives records without a target.
    """
    rows = payloads_of(pages, page_id, html)
    return write(with_revisits(rows, least), folder, dictionary(rows))
