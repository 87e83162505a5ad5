"""Packing by concatenate-and-cut.

All documents' token ids, each followed by the end id, form one long stream; it
is cut into windows of ``window`` tokens.  Pass 1 encodes every partition and
stores, with each document, its partition and its start inside it.  Prefix sums
over the partitions' token totals give every partition's global offset, so pass
2 knows each document's place in the stream and cuts it at the window borders; a
document across a border leaves one boundary record (piece) in each window.  All
windows but the last are full.

Only partition totals (one number a task) are summed in one place.

Defined cases: null and empty texts are the end id alone; null ids and repeated
rows are packed like any other row; a text longer than a window spans several;
an empty table gives no pieces; further input columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.byte_bpe import default_vocabulary, encoder
from vigil.llm.common import Stored

WINDOW = 1024
END_ID = 0

_ENCODED = "doc_id long, ids binary, n long, part int, start_in_part long"
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, ids binary")


def encode_partitions(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pass 1: (doc_id, ids, n, part, start_in_part); ids are little-endian numbers of the vocabulary's width."""
    path = vocabulary or default_vocabulary()

    def encode(batches):
        enc = encoder(path)
        end, width = np.asarray([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, 512):  # small batches: a document's ids are as long as its text
                piece = b.slice(at, 512)
                ids = [enc.encode(t) + end for t in piece.column(1).to_pylist()]
                n = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
                starts = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(n),
                     pa.array(np.full(len(ids), part, np.int32)), pa.array(starts)],
                    ["doc_id", "ids", "n", "part", "start_in_part"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(encode, _ENCODED)


def partition_offsets(encoded: DataFrame) -> DataFrame:
    """(part, part_offset): the tokens of all earlier partitions; one row a task of pass 1."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return encoded.groupBy("part").agg(F.sum("n").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("part_offset"))


def cut(encoded: DataFrame, width: int, window: int = WINDOW) -> DataFrame:
    """Pass 2: the pieces of every document, with their ids as unsigned 32-bit little-endian numbers."""
    dtype = np.dtype(f"<u{width}")

    def pieces(batches):
        for b in batches:
            doc, start, length, crc, total, seq, off, out = [], [], [], [], [], [], [], []
            for d, raw, at in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(raw, dtype).astype("<u4")
                done = 0
                while done < len(ids):
                    place = at + done
                    size = min(window - place % window, len(ids) - done)
                    body = ids[done:done + size].tobytes()
                    doc.append(d), start.append(done), length.append(size), crc.append(zlib.crc32(body))
                    total.append(len(ids)), seq.append(place // window), off.append(place % window), out.append(body)
                    done += size
                if len(out) >= 2048:
                    yield _batch(doc, start, length, crc, total, seq, off, out)
                    doc, start, length, crc, total, seq, off, out = [], [], [], [], [], [], [], []
            if out:
                yield _batch(doc, start, length, crc, total, seq, off, out)

    offsets = Stored(partition_offsets(encoded), "packing-offsets").df  # its size is known when the join is planned
    return encoded.join(offsets, "part").select(
        "doc_id", "ids", (F.col("part_offset") + F.col("start_in_part")).alias("at")).mapInArrow(pieces, _PIECES)


def _batch(doc, start, length, crc, total, seq, off, out):
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total, seq, off)] + [pa.array(out, pa.binary())],
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """All pieces of all documents, ids included."""
    path = vocabulary or default_vocabulary()
    encoded = Stored(encode_partitions(docs, path, end_id), "packing-ids").df
    return cut(encoded, encoder(path).dtype.itemsize, window)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, ids array<long>, n_pad): the windows themselves; a group holds one window at most."""
    def build(batches):
        for b in batches:
            seq, parts = b.column(0).to_pylist(), b.column(1).to_pylist()
            ids = [np.concatenate([np.frombuffer(p["ids"], "<u4") for p in sorted(x, key=lambda p: p["offset"])]) for x in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seq, pa.int64()), pa.array([np.pad(x, (0, window - len(x))).astype(np.int64) for x in ids], pa.list_(pa.int64())),
                 pa.array([window - len(x) for x in ids], pa.int64())], ["sequence_id", "ids", "n_pad"])

    return pieces.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts")) \
        .mapInArrow(build, "sequence_id long, ids array<long>, n_pad long")
