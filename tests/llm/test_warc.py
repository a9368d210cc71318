import gzip
import glob
import hashlib
import base64

import duckdb
import pytest
from pyspark.sql import functions as F

from ratingspark.llm import warc

SF = "/root/testdata/sf0.001"


def test_matches_sql(spark):
    got = warc.page_digests(spark.read.parquet(f"{SF}/pages.parquet")).toPandas()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.sql(warc.ORACLE).df()
    key = lambda df: sorted(map(str, df[sorted(df)].astype(object).where(df[sorted(df)].notna(), None)
                                .itertuples(index=False, name=None)))
    assert [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(want)]


def edge_pages(spark):
    rows = [(1, "http://a", "x"), (2, "http://b\r\nInjected: y", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 200_000),
            (None, "u", "x"), (6, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (2, "http://b\r\nInjected: y", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("header", F.lit(1))


def test_edge_rows(spark, tmp_path):
    got = warc.page_digests(edge_pages(spark)).collect()
    assert len(got) == 8
    types = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert [t for t in types if t[0] == 1] == [(1, "revisit", 2)]
    assert sorted(t[1] for t in types if t[0] == 2) == ["response", "revisit"]
    assert (3, "revisit", 4) in types and (4, "response", None) in types
    for r in got:
        if r.page_id == 5:
            assert r.payload_bytes == 400_000
            assert r.payload_digest == base64.b32encode(hashlib.sha1(("é" * 200_000).encode()).digest()).decode()


def test_empty_table(spark):
    assert warc.page_digests(edge_pages(spark).where("false")).count() == 0


def test_payloads_are_stored_once_and_exported_whole(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(edge_pages(spark), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    warc.export_warc(warc.read_archive(spark, path), str(tmp_path / "warc"))
    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(str(tmp_path / "warc" / "*.gz"))))
    records, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(": ", 1) for x in raw[at:end - 4].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        records.append((fields, raw[end:end + size]))
        assert raw[end + size:end + size + 4] == b"\r\n\r\n"
        at = end + size + 4
    assert len(records) == 8
    assert all("Injected" not in f for f, _ in records)
    for fields, block in records:
        if fields["WARC-Type"] == "response":
            digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
            assert fields["WARC-Payload-Digest"] == f"sha1:{digest}"


def test_changed_payload_is_refused(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(edge_pages(spark), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other"))
    rows = bad.collect()
    spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, path).collect()
