import hashlib
import io

import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F

from vigil.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, payload_digest string, refers_to int"


def brute(rows):
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        other = first.get(raw) if i is not None and first.get(raw) != i else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


def test_awkward_rows(spark, tmp_path):
    same = "é" * 60
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://b/\r\nX: y z", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (7, "u", same), (5, "u", same), (5, "u", same),
            (9, "u", same), (None, "u", same), (10, "u", "s" * 99), (11, "u", "s" * 99), (12, "u", "s" * 100), (13, "u", "s" * 100), (14, "u", "x\x00y" * 900_000)]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>page {i} of many, with the usual words</body></html>" * (i % 5)) for i in range(200)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA).repartition(3)
    manifest, folder = W.archive_pages(df, str(tmp_path / "archives"))
    got = W.read_archives(manifest, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    texts = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert bytes(texts[14]) == ("x\x00y" * 900_000).encode() and bytes(texts[3]) == rows[2][2].encode()
    urls = {r.page_id: r.url for r in got}
    assert urls[2] is None and urls[3] == "http://b/%0D%0AX:%20y%20z"
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(rows)


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i}", "a", "b", 1) for i in range(40)]
    manifest, folder = W.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(8), str(tmp_path / "many"))
    read = W.read_archives(manifest, folder)
    assert manifest.count() == 8
    tasks = read.select("archive", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in tasks}) > 1 and len({r.archive for r in tasks}) == len(tasks) == 8


def test_a_path_without_a_scheme_is_resolved_as_spark_does(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    assert W.qualified(spark, f"{tmp_path}/x") == f"file://{tmp_path}/x" == W.qualified(spark, f"file:{tmp_path}/x")
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://127.0.0.1:1")  # names the file system only, nothing is opened
        assert W.qualified(spark, "/ckpt/x") == "hdfs://127.0.0.1:1/ckpt/x"
        assert W.qualified(spark, f"file://{tmp_path}/x") == f"file://{tmp_path}/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_record_can_be_read_alone_and_damage_is_seen(tmp_path):
    records = [W.record(i, f"http://h/{i}", f"body {i} ".encode() * 40, "0" * 64, None) for i in range(50)]
    out = io.BytesIO()
    size = W.write_archive(out, records)
    raw = out.getvalue()
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and list(W.read_archive(io.BytesIO(raw))) == records
    second = raw.index(b"\x28\xb5\x2f\xfd", 8 + size + 4)
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:8 + size])).decompressobj().decompress(raw[second:])
    assert alone == records[1]
    with pytest.raises(Exception):
        list(W.read_archive(io.BytesIO(raw[:-5])))
    assert len(raw) - size < sum(map(len, records)) / 4
    assert pafs.FileSystem.from_uri(f"file://{tmp_path}")
