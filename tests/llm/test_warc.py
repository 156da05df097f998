import base64
import gzip
import hashlib
import io
import zlib

import pytest

from skylocus.llm import common, files, warc

PAGES = [
    (1, "http://a/ b", "same"), (2, "http://b", "same"), (3, None, ""), (4, "http://d", None), (5, "http://e\r\nX: y", "é" * 5000),
    (6, "http://f", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"), (7, "http://g", "same"), (7, "http://g", "same"), (None, "http://h", "alone"),
    (8, "http://i", "x" * 2_000_000),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    manifest = warc.archive_pages(table(spark, PAGES), common.new_folder(spark, "warc"), least)
    names = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = [tuple(r) for r in warc.read(manifest, names).collect()]
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        alike = [j for j, _, other in PAGES if (other or "").encode() == data and j is not None]
        first = min(alike, default=None) if len(data) >= least else i
        refers = None if first == i else first
        kind = "response" if refers is None else "revisit"
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, data if refers is None else None, len(data), digest, kind, refers))
    key = lambda r: (str(r[0]), r[2])
    assert sorted([(i, None if p is None else bytes(p), *x) for i, p, *x in got], key=key) == sorted(want, key=key)


def test_members_and_index(spark):
    rows = warc.archive_pages(table(spark, PAGES), common.new_folder(spark, "warc")).collect()
    for row in rows:
        data = open(files.local_path(row.archive), "rb").read()
        lines = open(files.local_path(row["index"])).read().splitlines()
        assert lines[0] + "\n" == warc.INDEX_HEAD and len(lines) == row.n_records + 1
        at = 0
        for line in lines[1:]:
            offset, length, kind, record = line.split("\t")
            assert int(offset) == at
            member = gzip.decompress(data[at : at + int(length)])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and f"WARC-Type: {kind}\r\n".encode() in member and record.encode() in member
            at += int(length)
        assert at == len(data)


def test_raw_archive_is_one_stream(spark):
    manifest = warc.write(warc.decide(table(spark, PAGES).coalesce(1)), common.new_folder(spark, "raw"))
    for row in manifest.collect():
        inflater = zlib.decompressobj(31)
        plain = inflater.decompress(open(files.local_path(row.archive), "rb").read())
        assert inflater.eof and not inflater.unused_data and plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_broken_streams():
    good = gzip.compress(warc.page_record(1, "u", b"x" * 100_000, "D", None))
    assert len(list(warc.normalise_stream(io.BytesIO(good), io.BytesIO()))) == 1
    assert list(warc.normalise_stream(io.BytesIO(b""), io.BytesIO())) == []
    with pytest.raises(EOFError):
        list(warc.normalise_stream(io.BytesIO(good[:-40]), io.BytesIO()))
    with pytest.raises(ValueError):
        list(warc.normalise_stream(io.BytesIO(gzip.compress(b"no record\r\n\r\n")), io.BytesIO()))


def test_empty_table(spark):
    manifest = warc.archive_pages(table(spark, []), common.new_folder(spark, "warc"))
    assert warc.read(manifest, ["page_id"]).collect() == []


def test_many_revisits_are_joined(spark, monkeypatch):
    """Beyond the broadcast, pages are joined by page and digest, with the same decisions: ties, nulls and repeated rows too."""
    rows = PAGES + [(None, "u", "same"), (None, "u", "same"), (7001, "u", "same"), (7001, "u", "same"), (7000, None, "same"), (7002, "u", None), (7003, "u", "")]
    decide = lambda: sorted(map(str, warc.decide(table(spark, rows).repartition(3)).select("page_id", "digest", "refers_to").collect()))
    few = decide()
    monkeypatch.setattr(warc, "FEW_REVISITS", -1)
    assert decide() == few and len(few) == len(rows)
    assert sum("refers_to=1)" in x for x in few) == 8
