"""Archives: round trip, revisits, rolling, equal bytes in reruns, and commits that may be repeated."""

from __future__ import annotations

import gzip
import hashlib
import io
from pathlib import Path

import pytest

from grainmill.llm import warc

PAGES = "page_id long, url string, html string, part int, digest string"
BIG, SMALL = "<p>" + "same " * 50 + "</p>", "<p>small</p>"
ROWS = [
    (3, "http://a/é x", BIG), (1, "http://b", BIG), (9, None, BIG), (4, "u", SMALL), (2, "u", SMALL), (5, "u", None), (6, "u", ""),
    (7, "u", "<p>é漢</p>" * 30), (8, "u", "<p>é漢</p>" * 30), (None, "n", BIG), (None, "n", "<b>only without id</b>" * 9), (None, "n", "<b>only without id</b>" * 9),
    (20, "u", "twice " * 40), (20, "u", "twice " * 40), (2**61, "far", "x\r\n\r\ny" * 100),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], PAGES).repartition(4)


def test_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = warc.write(pages, folder, roll_bytes=400, range_bytes=300)
    got = sorted(repr(tuple(r)[:5]) for r in warc.read(manifest, folder).collect())
    expected, seen = [], set()
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        same = [p for p, _, h in ROWS if (h or "").encode() == data and p is not None]
        revisit = len(data) >= 100 and bool(same) and (page_id != min(same) or (page_id, digest) in seen)
        seen.add((page_id, digest))
        expected.append(repr((page_id, len(data), digest, "revisit" if revisit else "response", min(same) if revisit else None)))
    assert got == sorted(expected)
    rows = manifest.collect()
    assert len(rows) > 3 and sum(r.records for r in rows) == len(ROWS)
    for r in rows:
        data = (tmp_path / r["name"]).read_bytes()
        assert len(data) == r["bytes"] and hashlib.sha256(data).hexdigest() == r["sha256"]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert not list((tmp_path / "temp").iterdir())


def test_reruns_give_equal_bytes(spark, pages, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    a = warc.write(pages, f"file://{one}", roll_bytes=500).select("name", "sha256").collect()
    b = warc.write(pages.repartition(2), f"file://{two}", roll_bytes=500).select("name", "sha256").collect()
    assert sorted(a) == sorted(b)


def test_pages_without_id_are_split_by_payload(spark, tmp_path):
    rows = [(None, f"u{i}", f"page {i % 150} " * 30) for i in range(300)] + [(4, "u", "page 3 " * 30), (4, "u", "page 3 " * 30), (4, "u", "page 9 " * 30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(df, f"file://{tmp_path}", range_bytes=10_000)
    assert manifest.select("part").distinct().count() > 5
    got = warc.read(manifest, f"file://{tmp_path}").collect()
    assert len(got) == 303 and sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id) == [(4, "response", None)] * 2 + [(4, "revisit", 4)]
    assert sum(r.refers_to == 4 for r in got) == 5 and sum(r.record_type == "response" for r in got) == 298
    ids = [line for r in manifest.collect() for line in gzip.decompress((tmp_path / r["name"]).read_bytes()).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    referred = {line.split()[1] for r in manifest.collect() for line in gzip.decompress((tmp_path / r["name"]).read_bytes()).split(b"\r\n") if line.startswith(b"WARC-Refers-To")}
    assert referred <= {i.split()[1] for i in ids} and len(referred) == 2


def test_empty(spark, pages, tmp_path):
    manifest = warc.write(pages.limit(0), f"file://{tmp_path}")
    assert manifest.count() == 0 and warc.read(manifest, f"file://{tmp_path}").count() == 0


def test_lost_attempt_leaves_no_trace(tmp_path):
    folder = f"file://{tmp_path}"
    lost = warc.Roller(folder, 0, 10**9)
    list(lost.add(warc.member(b"lost")))  # never finished
    roller = warc.Roller(folder, 0, 10**9)
    assert list(roller.add(warc.member(b"kept"))) == []
    (row,) = roller.done()
    assert (tmp_path / row[3]).exists() and row[4] == 1 and not list(Path(tmp_path).glob("*.gz"))


def test_reader_refuses_changes():
    good = warc.member(warc.record(1, "u", b"payload", None, False))
    ((head, block),) = warc.records_of(io.BytesIO(good))
    assert head["WARC-Type"] == "response" and block.endswith(b"payload")
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(good[:-30])))
