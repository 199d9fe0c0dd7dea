import base64
import gzip
import hashlib
import re
import zlib
from pathlib import Path

import pytest
from helpers import ordered

from demandloom.llm import warc
from demandloom.llm.warc import archive_pages, normalise, read_index, read_records

SCHEMA = "page_id long, url string, html string, payload string, bytes int"
PAGES = [
    (4, "http://a/", "<p>é\r\n\r\nWARC/1.1\r\n", "", 0),
    (2, "http://b/\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\n", "", 0),
    (9, None, None, "", 0),
    (7, "http://c/", "", "", 0),
    (8, "http://c/", "", "", 0),
    (None, "http://d/", "only here", "", 0),
    (5, "http://e/", "long " * 700_000, "", 0),
    (11, "http://e/", "long " * 700_000, "", 0),
    (12, "http://f/", "\n", "", 0),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    got = archive_pages(spark.createDataFrame(PAGES, SCHEMA).repartition(3), str(tmp_path)).drop("url").collect()
    first = {4: 2, 9: 7, 8: 7, 11: 5}
    assert ordered(got) == ordered(
        (k, "revisit" if k in first else "response", len((h or "").encode()), digest(h), first.get(k)) for k, _, h, _, _ in PAGES
    )
    # Each member stands alone, and its index says where.
    index = read_index(spark, f"{tmp_path}/members")
    for r in index.collect():
        raw = Path(re.sub("^file:/+", "/", r.file)).read_bytes()[r.offset : r.offset + r.length]
        one = zlib.decompressobj(31)
        record = one.decompress(raw)
        assert one.eof and not one.unused_data and r.record_id.encode() in record
    assert ordered(read_records(index).select("record_id").collect()) == ordered(index.select("record_id").collect())
    # The whole-file archives hold the same records.
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "raw").glob("*.gz")))
    members = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "members").glob("*.warc.gz")))
    assert sorted(raw.split(b"WARC/1.1\r\n")) == sorted(members.split(b"WARC/1.1\r\n"))


def test_small_payloads_and_empty_table(spark, tmp_path):
    got = archive_pages(spark.createDataFrame(PAGES, SCHEMA), str(tmp_path / "a"), min_bytes=5)
    assert {r.page_id for r in got.collect() if r.record_type == "revisit"} == {4, 11}
    assert archive_pages(spark.createDataFrame([], SCHEMA), str(tmp_path / "b")).count() == 0


def test_a_truncated_archive_stops_the_job(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    whole = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    (tmp_path / "raw" / "x.gz").write_bytes(whole[:-12])
    with pytest.raises(Exception, match="ends"):
        normalise(spark, f"{tmp_path}/raw", f"{tmp_path}/out").collect()
    assert not list((tmp_path / "out").glob("*.warc.gz"))


def test_a_file_of_many_records_is_indexed_as_it_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "INDEX_ROWS", 64)
    (tmp_path / "raw").mkdir()
    one = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{}>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "raw" / "x.gz").write_bytes(gzip.compress("".join(one.format(k) for k in range(1000)).encode()))
    index = normalise(spark, f"{tmp_path}/raw", f"{tmp_path}/out")
    assert [r.record_id for r in index.orderBy("offset").collect()] == [f"<r{k}>" for k in range(1000)]
    assert ordered(read_index(spark, f"{tmp_path}/out").select("offset", "length").collect()) == ordered(
        index.select("offset", "length").collect()
    )
    (tmp_path / "raw" / "y.gz").write_bytes(gzip.compress((one * 300).replace("{}", "s").encode()))
    held = [b.num_rows for b in warc._normalise_one(f"file:{tmp_path}/raw/y.gz", f"file:{tmp_path}/more")]
    assert held == [64, 64, 64, 64, 44]


def test_keys_must_be_whole_numbers(spark, tmp_path):
    pages = spark.createDataFrame([("a", "http://a/", "x")], "page_id string, url string, html string")
    with pytest.raises(ValueError, match="whole number"):
        archive_pages(pages, str(tmp_path))
