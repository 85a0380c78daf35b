import io
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    rows = [(1, "http://a/ö", "same"), (2, None, "same"), (3, "u", "other é" * 40_000), (4, "u", None), (5, "u", ""), (6, "u", "x\r\n\r\ny")]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows)).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), 6: ("response", None)}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), warc.digest(data))


def test_least_bytes_text_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab", 1, "k"), (2, "u", "ab", 2, "k"), (3, "u", "abc", 3, "k"), (9, "u", "abc", 3, "k")], "page_id long, url string, html string, top int, kind string")
    manifest = warc.write_warc(df, f"file://{tmp_path}/w", least_bytes=3)
    manifest.write.parquet(f"{tmp_path}/manifest")
    manifest = spark.read.parquet(f"{tmp_path}/manifest")
    got = {(r.page_id, r.record_type, r.refers_to, r.html) for r in warc.read_warc(manifest, with_text=True).collect()}
    assert got == {(1, "response", None, "ab"), (2, "response", None, "ab"), (3, "revisit", 9, ""), (9, "response", None, "abc")}


def test_empty_nulls_and_repeats(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []
    got = [tuple(r)[:1] + tuple(r)[3:] for r in warc.round_trip(pages(spark, [(None, None, "a"), (7, None, "a"), (7, None, "a")])).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, "revisit", 7), (7, "response", None), (7, "response", None)]))


def test_reader_takes_members_one_by_one_and_sees_damage():
    one = warc.record_bytes("response", "<urn:x:1>", b"body" * 50_000, warc.digest(b"body" * 50_000), 200_000)
    two = warc.record_bytes("revisit", "<urn:x:2>", b"", warc.digest(b"z"), 1, refers_to="<urn:x:1>")
    got = list(warc.read_records(io.BytesIO(one + two)))
    assert [r.headers["WARC-Type"] for r in got] == ["response", "revisit"] and warc.payload(got[0]) == (200_000, b"body" * 50_000)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(one[:-9])))
    raw = zlib.decompress(one, 31).replace(b"bodybody", b"bodYbody", 1)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.read_records(io.BytesIO(packer.compress(raw) + packer.flush())))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(b"plain")))


def test_archives_are_read_by_a_task_each(spark):
    manifest = spark.range(1000).selectExpr("concat('file:///a/', lpad(id, 4, '0'), '-x.warc.gz') as file", "1L as records")
    read = warc.read_warc(manifest)
    assert read.rdd.getNumPartitions() == 1000
    dealt = manifest.repartitionByRange(1000, "file").groupBy(F.spark_partition_id().alias("p")).count()
    assert dealt.count() >= 990 and dealt.agg(F.max("count")).first()[0] <= 2


def test_many_archives_come_back_whole(spark):
    rows = [(k, f"u{k}", f"page {k % 700} " * (k % 50)) for k in range(2000)]
    got = {r.page_id: r.payload_bytes for r in warc.round_trip(pages(spark, rows).repartition(40)).collect()}
    assert got == {k: len(h) for k, _, h in rows}


def test_uris(tmp_path):
    assert warc.arrow_uri("s3a://b/x") == "s3://b/x" and warc.arrow_uri("file:/a/b") == "file:///a/b" and warc.arrow_uri("/a") == "file:///a" and warc.arrow_uri("gs://b/x") == "gs://b/x"
