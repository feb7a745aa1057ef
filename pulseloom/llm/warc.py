"""Sharded WARC archives: written in id order, rolled by compressed size, committed by manifest, and read back.

Rows are sorted by range, so each task writes the files of its range: ``<prefix>-<shard>-<roll>.warc.gz``, every record a
gzip member of its own. A file is written under a temporary name of its task attempt and renamed when it is whole; a lost
or repeated task writes the same bytes under the same names. The archive is what its manifest lists, a Parquet table in
``_manifest`` that Spark commits after the last file.

Of records with equal payloads of at least ``min_bytes``, those of the smallest id are ``response``, others ``revisit`` it.
Null payloads are empty ones. Rows with a null id come first and are responses; rows that repeat an id are all written.
Null URLs become ``urn:unknown``; characters that would end a header line are percent-encoded. Extra columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseloom.llm.common import attempt_name, file_system, read_file

FILE_BYTES = 256 << 20
LEVEL = 5
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, shard long, roll long, records long, bytes long, first_id long, last_id long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
           "record_date string, payload binary")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """One WARC record as a gzip member."""
    lines = [f"WARC-Type: {kind}", *(f"{name}: {value}" for name, value in fields), f"Content-Length: {len(block)}"]
    head = "WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def header_value(text: str | None) -> str:
    return "urn:unknown" if text is None else "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in text)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """A response, or a revisit of the response with the id ``first``; a revisit's block has the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    fields = [("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", header_value(url)),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
              ("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first}>")]
    return record("response" if first is None else "revisit", fields, block)


def write_archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0, file_bytes: int = FILE_BYTES, prefix: str = "pages", date: str = DATE) -> DataFrame:
    """Writes the archive and returns its manifest, a row for each file."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    # who revisits whom is settled on digests; only rows that revisit send a line to meet their payload in the sort
    digests = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    digests = digests.filter(F.col("size") >= min_bytes)
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    revisits = digests.join(firsts, "digest").filter("page_id > first").select(
        "page_id", F.lit(0).alias("part"), "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload")).distinct()
    both = revisits.unionByName(rows.select("page_id", F.lit(1).alias("part"), F.lit("").alias("digest"), F.lit(None).cast("long").alias("first"), "url", "payload"))
    ordered = both.repartitionByRange("page_id").sortWithinPartitions("page_id", "part", "url", "payload")

    def write(batches):
        shard, attempt = attempt_name()
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        roll, out, name, held, records, first_id, last_id = 0, None, "", 0, 0, None, None
        of_page, wanted = None, {}

        def close():
            out.close()
            system.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "shard": [shard], "roll": [roll], "records": [records], "bytes": [held],
                                               "first_id": pa.array([first_id], pa.int64()), "last_id": pa.array([last_id], pa.int64())})
        for batch in batches:
            for page_id, part, digest, first, url, payload in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if page_id != of_page:
                    of_page, wanted = page_id, {}
                if part == 0:
                    wanted[digest] = first
                    continue
                if out is None:
                    name = f"{prefix}-{shard:06d}-{roll:04d}.warc.gz"
                    out = system.open_output_stream(f"{path}/.{name}.{attempt}", compression=None)
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name),
                                               ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    held, records, first_id = len(info), 0, page_id
                data = payload.encode()
                sha1 = hashlib.sha1(data)
                member = page_record(page_id, url, data, base64.b32encode(sha1.digest()).decode(), wanted.get(sha1.hexdigest()) if wanted else None, date)
                out.write(member)
                held, records, last_id = held + len(member), records + 1, page_id
                if held >= file_bytes:
                    yield close()
                    roll, out = roll + 1, None
        if out is not None:
            yield close()

    ordered.select("page_id", "part", "digest", "first", "url", "payload").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(data: bytes):
    """The contents of the gzip members of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker = zlib.decompressobj(31)
        parts, fed = [], at
        while not unpacker.eof:  # fed in parts, so that the rest of a large file isn't copied for each record
            if fed >= len(view):
                raise ValueError("a record is cut off")
            parts.append(unpacker.decompress(view[fed:fed + 65536]))
            fed = min(fed + 65536, len(view))
        at = fed - len(unpacker.unused_data)
        yield b"".join(parts)


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[:int(fields["Content-Length"])]


def read_archive(spark: SparkSession, folder: str, *, with_payload: bool = True) -> DataFrame:
    """The page records of the files that the manifest lists; digests are checked on the way."""
    number = lambda urn: int(urn[len("<urn:page:"):-1]) if len(urn) > len("<urn:page:>") else None

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for content in members(read_file(folder, name)):
                    fields, block = parse_record(content)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"damaged record in {name}")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    refers = fields.get("WARC-Refers-To")
                    rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], number(refers) if refers else None,
                                 fields["WARC-Payload-Digest"].removeprefix("sha1:"), size, fields["WARC-Date"],
                                 payload if with_payload and refers is None else None))
                    held += len(block)
                    if held > 16 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "record_date", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(read, RECORDS)
