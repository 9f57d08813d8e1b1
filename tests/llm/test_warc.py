import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from loadlens.llm import warc


def _pages(spark, rows):
    return spark.createDataFrame([(k, f"http://a/{k} b", h, 7) for k, h in rows], "page_id long, url string, html string, chunk_no int")


def _round_trip(spark, pages, **options):
    size = options.pop("chunk_bytes", 64)
    manifest = warc.write_archives(warc.chunk_rows(pages, chunk_bytes=size), warc.new_folder(spark), segment_bytes=500)
    return manifest, warc.read_chunks(spark, manifest, chunk_bytes=size)


def test_payloads_come_back_in_chunks_with_running_digests(spark):
    rows = [(1, "é" * 500), (2, None), (3, ""), (4, "WARC/1.1\r\n\r\nin a payload\r\n\r\n" * 9), (5, "a" * 64), (6, "b" * 65)]
    manifest, chunks = _round_trip(spark, _pages(spark, rows))
    found = {}
    for r in chunks.orderBy("record_key", "chunk_no").collect():
        own = found.setdefault(int(r["record_key"]), [])
        assert r["chunk_no"] == len(own) and len(r["data"]) <= 64
        own.append(r)
    for key, html in rows:
        payload, own = (html or "").encode(), found[key]
        assert b"".join(bytes(r["data"]) for r in own) == payload
        assert [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
        for r in own:
            assert r["digest_so_far"] == hashlib.sha256(payload[: r["bytes_so_far"]]).hexdigest()
        assert own[-1]["url"] == f"http://a/{key} b" and own[-1]["payload_bytes"] == len(payload)
    assert manifest.count() > 1  # several segments


def test_archives_are_gzip_members_of_warc(spark):
    manifest, _ = _round_trip(spark, _pages(spark, [(1, "x" * 200), (2, "x" * 200)]))
    text = b""
    for (path,) in manifest.select("path").distinct().collect():
        text += gzip.open(path).read()
    assert text.count(b"WARC/1.1\r\n") == 2 and text.count(b"WARC-Type: revisit") == 1


def test_equal_payloads_are_revisits_of_the_smallest(spark):
    same, short = "x" * 100, "y" * 99
    rows = [(5, same), (3, same), (9, same), (3, same), (None, same), (1, short), (2, short), (7, "z" * 300)]
    _, chunks = _round_trip(spark, _pages(spark, rows))
    found = sorted(
        (str(r["record_key"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in chunks.where("last").collect()
    )
    assert found == sorted([
        ("3", "response", None, 100), ("3", "response", None, 100), ("5", "revisit", "3", 100), ("9", "revisit", "3", 100),
        ("None", "revisit", "3", 100), ("1", "response", None, 99), ("2", "response", None, 99), ("7", "response", None, 300),
    ])


def test_payload_of_many_chunks_and_empty_table(spark):
    _, chunks = _round_trip(spark, _pages(spark, [(1, "ab" * 1_000_000)]), chunk_bytes=1 << 16)
    assert chunks.count() == 31 and chunks.agg(F.max(F.octet_length("data"))).first()[0] == 1 << 16
    _, chunks = _round_trip(spark, _pages(spark, [(1, "a")]).where("false"))
    assert chunks.count() == 0


def test_urls_come_back_as_they_were(spark):
    urls = ["http://a/%20b%2Fc?x=%26", "http://a/b c", "http://ä/€%zz", None, "", "urn:none", "http://a/\r\nx: y"]
    pages = spark.createDataFrame([(k, u, "body") for k, u in enumerate(urls)], "page_id long, url string, html string")
    _, chunks = _round_trip(spark, pages)
    assert {int(r["record_key"]): r["url"] for r in chunks.collect()} == dict(enumerate(urls))


@pytest.mark.parametrize("cut", [1, 40, 150, 250])
def test_truncated_archives_are_errors(spark, cut):
    manifest, _ = _round_trip(spark, _pages(spark, [(1, "".join(chr(97 + k * k % 26) for k in range(3000)))]))
    segment = manifest.first()
    with open(segment["path"].removeprefix("file://"), "rb") as file:
        whole = file.read()
    assert len(whole) > cut
    broken = io.BytesIO(whole[:-cut])
    with pytest.raises(ValueError, match="ends within"):
        for _, _, payload in warc._records(broken, len(whole) - cut):
            list(payload)
