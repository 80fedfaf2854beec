import hashlib

import pytest

from tests.llm.conftest import prose
from vacancia.llm import warc
from vacancia.llm.warc import (CRLF, END, archive_ranges, archive_round_trip, candidate_links, reachable, read_records,
                               with_roles, write_archives)


def fake(body, page=99):
    return (f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:{page}>{CRLF}"
            f"Content-Length: {len(body.encode())}{END}{body}{END}")


@pytest.fixture(scope="module")
def pages(spark):
    same, other = "<p>" + prose(1, 300), "é" * 499 + "xx"             # the other has exactly 1000 bytes
    rows = [
        (1, "http://a/1", same), (2, "http://a/2", same), (7, None, same), (3, "u v\r\nInjected: x", "short"), (4, "u", "short"),
        (5, "u", None), (6, "u", ""), (8, "u", fake("inner") + fake("second")), (9, "u", "WARC/1.1" + CRLF * 3 + fake("z" * 50)),
        (10, "u", other), (11, "u", other), (12, "u", other[:-1]), (13, "u", other[:-1]), (None, "u", same),
        (14, "u", prose(2, 5000)), (14, "u", "again"), (15, "u", END * 40), (16, "u", fake("x")[: -4]),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def brute(rows):
    out = []
    for r in rows:
        body = (r["html"] or "").encode()
        equal = [x["page_id"] for x in rows if (x["html"] or "").encode() == body and x["page_id"] is not None]
        last = max(equal, default=None)
        again = len(body) >= 1000 and r["page_id"] is not None and r["page_id"] != last
        out.append((r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
                    last if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [0, 100])
def test_round_trip(pages, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "MOST_BROADCAST", broadcast)
    got = archive_round_trip(pages)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(pages.collect())
    assert archive_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("size", [100, 777, 1 << 20])
def test_only_the_chain_is_read(pages, spark, tmp_path, size):
    path = f"file://{tmp_path}/archives"
    write_archives(pages, path)
    links = candidate_links(archive_ranges(spark, path, size), size)
    assert links.count() > pages.count()                             # the payloads look like records
    records = read_records(spark, path, size).collect()
    assert len(records) == pages.count()
    assert "<urn:page:99>" not in {r["page"] for r in records}
    assert {r["declared_digest"] for r in records if r["type"] == "response"} == {
        "sha1:" + r["digest"] for r in records if r["type"] == "response"}
    assert reachable(links).count() <= sum(1 for r in records)


def test_a_broken_chain_ends(spark, tmp_path):
    whole = fake("one", 1) + fake("two", 2)
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a").write_bytes((whole + "garbage" + fake("three", 3)).encode())
    (folder / "b").write_bytes(("x" + whole).encode())
    (folder / "c").write_bytes(b"")
    (folder / "d").write_bytes(whole.replace("Content-Length: 3", "Content-Length: 99999", 1).encode())
    (folder / "e").write_bytes(whole.encode()[:-1])
    for size in (40, 1 << 20):
        got = sorted((r["path"][-1], r["page"]) for r in read_records(spark, f"file://{folder}", size).collect())
        assert got == [("a", "<urn:page:1>"), ("a", "<urn:page:2>"), ("e", "<urn:page:1>")]


def test_roles_keep_all_pages(pages):
    assert with_roles(pages).count() == pages.count()


def test_a_long_url_keeps_all_records(spark, tmp_path):
    rows = [(k, "data:," + prose(k, 40_000).replace(" ", "%20") if k == 5 else f"http://a/{k}", prose(k, 50)) for k in range(11)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert len(rows[5][1]) > 200_000
    assert {r["page_id"] for r in archive_round_trip(pages).collect()} == set(range(11))
    path = f"file://{tmp_path}/archives"
    write_archives(pages, path)
    for size in (1000, 1 << 20):
        records = read_records(spark, path, size)
        assert records.count() == 11 and warc.unfinished(records, path).count() == 0


def test_files_that_break_off_are_named(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a").write_bytes((fake("one", 1) + "garbage" + fake("two", 2)).encode())
    (folder / "b").write_bytes(("x" + fake("one", 1)).encode())
    (folder / "c").write_bytes(fake("one", 1).encode())
    found = warc.unfinished(read_records(spark, f"file://{folder}"), f"file://{folder}").collect()
    assert sorted((r["path"][-1], r["end"]) for r in found) == [("a", len(fake("one", 1))), ("b", None)]


def test_little_more_than_the_archive_is_read(spark, tmp_path, monkeypatch):
    """Bytes that the search and the walk ask the store for, with records of 10 KB in ranges of 256 KB."""
    rows = [(k, f"http://a/{k}", prose(k, 1800)) for k in range(300)]
    path = f"file://{tmp_path}/archives"
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    log, real = f"{tmp_path}/read", warc._opened

    def opened(name):
        class Counting:
            def __init__(self, source):
                self.source = source

            def read_at(self, n, at):
                data = self.source.read_at(n, at)
                with open(log, "a") as f:
                    f.write(f"{len(data)}\n")
                return data

            def size(self):
                return self.source.size()

            def __enter__(self):
                return self

            def __exit__(self, *why):
                self.source.close()
        return Counting(real(name))
    monkeypatch.setattr(warc, "_opened", opened)
    monkeypatch.setattr(warc, "AHEAD", 64 << 10)
    assert len({r["page"] for r in read_records(spark, path, 256 << 10).collect()}) == 300
    whole = sum(f.stat().st_size for f in (tmp_path / "archives").glob("part-*"))
    asked = sum(map(int, open(log).read().split()))
    assert whole < asked < 2.5 * whole


def test_stretches_give_the_bytes_of_the_file(tmp_path):
    import random

    import pyarrow.fs as pafs
    data = random.Random(2).randbytes(50_000)
    (tmp_path / "f").write_bytes(data)
    with pafs.LocalFileSystem().open_input_file(f"{tmp_path}/f") as source:
        for ahead in (0, 5000, 100_000):
            held = warc.Stretch(source, 7000, data[7000:9000], ahead)
            for at, n in [(7000, 2000), (0, 10), (8999, 2), (6999, 5), (30_000, 4096), (31_000, 96), (49_990, 8192), (49_999, 1), (8000, 6000)]:
                assert held.read_at(n, at) == data[at:at + n]
