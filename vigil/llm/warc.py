"""WARC archives with a dictionary-compressed writer.

Each archive is one file: a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary built from the archive's own records, then one Zstandard
frame for each record, so any record can be read alone.  A task writes its rows
as archives of ``ARCHIVE_BYTES`` of records; files get their final name by
one rename, and only files that the stored manifest names are read, so a task
that is run again adds nothing.

Payloads that repeat are stored once: of equal payloads of at least
``REVISIT_FROM`` bytes the smallest id is a response, the others are revisits
that name it.  Only (id, digest) pairs are grouped to find them.

Defined cases: a null payload is empty; rows without an id are always responses
and never named by others; rows that repeat the smallest id with the same payload
are all responses; a null URL leaves the target header out, control characters in
it are percent-encoded; an empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import Stored
from vigil.session import scratch_path

REVISIT_FROM = 100
ARCHIVE_BYTES = 16 << 20
READ_BYTES = 128 << 20     # compressed bytes a reading task gets, about
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIXED_DATE = "2000-01-01T00:00:00Z"

_MANIFEST = "path string, n_records long, n_bytes long, n_raw_bytes long, dictionary_bytes long"
_RECORDS = ("page_id long, record_type string, refers_to long, url string, payload_digest string, "
            "payload_bytes long, payload binary, archive string")


# --- one archive -----------------------------------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has no block."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", FIXED_DATE),
            ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>")]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))),
             ("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's block does not have its Content-Length")
    return fields, rest[:size]


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on records spread over the archive (at most SAMPLE_BYTES of them); where there
    is too little to train on, their plain bytes."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    samples = [r[:DICTIONARY_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_archive(out, records: list[bytes]) -> int:
    """Writes the dictionary frame and the records' frames; gives the dictionary's size."""
    raw = build_dictionary(records)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    for r in records:
        out.write(packer.compress(r))
    return len(raw)


def read_archive(source) -> Iterator[bytes]:
    """The records of an open archive, one after the other, in bounded memory."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    rest, frame, parts = b"", unpacker.decompressobj(), []
    while chunk := rest or source.read(1 << 20):
        parts.append(frame.decompress(chunk))
        rest = b""
        if frame.eof:
            yield b"".join(parts)
            rest, frame, parts = frame.unused_data, unpacker.decompressobj(), []
    if parts:
        raise ValueError("the archive ends inside a record")


# --- Spark jobs --------------------------------------------------------------------------------------------

def with_decisions(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): refers_to is null for responses."""
    raw = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), raw.alias("payload")) \
        .withColumn("payload_digest", F.sha2("payload", 256))
    first = rows.where((F.length("payload") >= F.lit(REVISIT_FROM)) & F.col("page_id").isNotNull()) \
        .groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") > F.lit(1)).drop("_n")
    repeated = Stored(first, "warc-repeated").df  # small as a rule: its size is known when the join is planned
    return rows.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(F.col("page_id") != F.col("_first"), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all rows as archives under ``folder`` (a URI that every executor reaches) and gives the
    manifest (one row an archive).  Evaluate it once: store it."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, size, raw = [], 0, 0

        def flush():
            nonlocal held, size
            name = f"{root}/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{name}.open", compression=None) as out:
                dictionary = write_archive(out, held)
                written = out.tell()
            fs.move(f"{name}.open", f"{name}.warc.zst")
            row = pa.RecordBatch.from_pylist([{"path": f"{name}.warc.zst", "n_records": len(held), "n_bytes": written, "n_raw_bytes": size, "dictionary_bytes": dictionary}],
                                             schema=pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("n_records", "n_bytes", "n_raw_bytes", "dictionary_bytes")]]))
            held, size = [], 0
            return row

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, digest, refers_to = (b.column(k)[i].as_py() for k in range(5))
                held.append(record(page_id, url, payload, digest, refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return with_decisions(pages).mapInArrow(run, _MANIFEST)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives that the manifest names; a revisit's payload is null."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for raw in read_archive(source):
                        fields, block = parse(raw)
                        if fields["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != fields["WARC-Payload-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"digest mismatch in {path}")
                        rows.append(_row(fields, block, path))
                        size += len(block)
                        if size >= 4 << 20 or len(rows) >= 4096:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    # a number of its own: a partition of a manifest is a few bytes, and would be merged with all others
    n, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    tasks = max(1, min(n, 4 * manifest.sparkSession.sparkContext.defaultParallelism), -(-size // READ_BYTES))
    return manifest.select("path").repartition(min(tasks, max(n, 1))).mapInArrow(run, _RECORDS)


def qualified(spark: SparkSession, folder: str) -> str:
    """The URI that Spark itself resolves ``folder`` to; a path without a scheme lies on the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, _, rest = uri.partition(":")
    return f"{'s3' if scheme == 's3a' else scheme}://{rest.removeprefix('//')}"


def _row(fields: dict[str, str], block: bytes, path: str) -> tuple:
    own, other, revisit = fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields["WARC-Type"] == "revisit"
    return (int(own[10:-1]) if own.startswith("<urn:page:") else None, fields["WARC-Type"], int(other[10:-1]) if other else None, fields.get("WARC-Target-URI"),
            fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"]) if revisit else len(block), None if revisit else block, path)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    names = ("page_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "payload", "archive")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes the archives and the stored manifest; gives the manifest and the folder."""
    folder = qualified(pages.sparkSession, folder or scratch_path(pages.sparkSession, "warc"))
    return Stored(write_archives(pages, folder), "warc-manifest").df, folder


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Every row written as a record and read back from the archives."""
    manifest, folder = archive_pages(pages, folder)
    return read_archives(manifest, folder)
