"""Block-wise shards: written, selected through the index, and read by byte range."""
import gzip

import pytest

from vacancia.plans.domain import view
from vacancia.sources import discovery as src
from vacancia.sources.blocks import BlockReader, index_lines, read_blocks, runs, write_blocks
from vacancia.sources.storage import arrow_uri, opened_store, resolved


def shards_of(spark, tmp_path, n=1000, per_block=20):
    keys = ["aa,first)/", "co,lever,jobs)/", "com,ashbyhq,jobs)/", "com,workable,apply)/", "io,greenhouse,boards)/", "io,zzz)/"]
    rows = [(f"{keys[k % 6]}{k:05d}", f'{keys[k % 6]}{k:05d} 2024 {{"url": "https://jobs.lever.co/c{k}"}}') for k in range(n)]
    lines = spark.createDataFrame(rows, "surt string, line string")
    return rows, write_blocks(lines, f"file://{tmp_path}/shards", per_block), f"file://{tmp_path}/shards"


def test_shards_are_plain_gzip_and_the_index_covers_them(spark, tmp_path):
    rows, index, _ = shards_of(spark, tmp_path)
    got = index.collect()
    text = []
    for shard in sorted({r["shard"] for r in got}):
        blocks = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["offset"])
        data = (tmp_path / "shards" / shard).read_bytes()
        assert [b["offset"] for b in blocks] == [sum(b["length"] for b in blocks[:k]) for k in range(len(blocks))]
        assert sum(b["length"] for b in blocks) == len(data)
        for b in blocks:
            lines = gzip.decompress(data[b["offset"]:b["offset"] + b["length"]]).decode().splitlines()
            assert len(lines) == b["lines"] and lines[0].startswith(b["surt"])
        text += gzip.decompress(data).decode().splitlines()
    assert sorted(text) == sorted(r[1] for r in rows) and not list((tmp_path / "shards").glob(".cdx*"))


def test_only_the_selected_bytes_are_read(spark, tmp_path):
    """Every byte outside the selected blocks is overwritten: the result stays the same."""
    rows, index, folder = shards_of(spark, tmp_path)
    blocks = src.cluster_blocks(index_lines(index), include_preceding=True)
    chosen = {(r["shard"], r["offset"], r["length"]) for r in blocks.collect()}
    every = {(r["shard"], r["offset"], r["length"]) for r in index.collect()}
    assert chosen < every
    for shard, offset, length in every - chosen:
        with open(tmp_path / "shards" / shard, "r+b") as f:
            f.seek(offset)
            f.write(b"\0" * length)
    want = sorted(line for surt, line in rows if surt.startswith(("co,lever", "com,ashby", "com,work", "io,greenhouse")))
    lines = read_blocks(spark, blocks, folder)
    got = lines.filter("line rlike '^(co,lever|com,ashby|com,work|io,greenhouse)'").collect()
    assert sorted(r["line"] for r in got) == want
    assert len({(r["doc"], r["line_no"]) for r in got}) == len(got)
    everything = index.select("shard", "offset", "length")
    with pytest.raises(Exception, match="bytes"):
        read_blocks(spark, everything, folder).collect()
    assert {r["line"] for r in read_blocks(spark, everything, folder, on_error="skip").collect()} >= set(want)


def test_the_reader_counts_the_bytes_it_fetches(spark, tmp_path, monkeypatch):
    _, index, folder = shards_of(spark, tmp_path)
    picked = index.filter("surt like 'co,lever%'").select("shard", "offset", "length")
    picked.write.parquet(f"file://{tmp_path}/selected")
    fetched = []

    class Counting:
        def __init__(self, source):
            self.source = source

        def read_at(self, n, at):
            fetched.append(n)
            return self.source.read_at(n, at)

        def close(self):
            self.source.close()

    class Store:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, name):
            return Counting(self.fs.open_input_file(name))
    from vacancia.sources import blocks
    reader = BlockReader({"path": folder, "selected": f"file://{tmp_path}/selected", "taskBytes": "700"})
    parts = reader.partitions()
    assert len(parts) > 1
    monkeypatch.setattr(blocks, "opened_store", lambda uri: (Store(opened_store(uri)[0]), opened_store(uri)[1]))
    n = sum(batch.num_rows for p in parts for batch in reader.read(p))
    whole = sum(f.stat().st_size for f in (tmp_path / "shards").glob("cdx*"))
    assert sum(fetched) == sum(r["length"] for r in picked.collect()) < whole / 3
    assert n == sum(r["lines"] for r in index.filter("surt like 'co,lever%'").collect())


def test_runs():
    blocks = [("a", 0, 5), ("a", 5, 5), ("b", 0, 20), ("a", 10, 1), ("a", 0, 5)]
    assert runs(blocks, 10) == [[("a", 0, 5), ("a", 5, 5)], [("a", 10, 1)], [("b", 0, 20)]]
    assert runs([], 10) == []


def test_query_reads_few_blocks(spark, sf_dir, tmp_path):
    index = write_blocks(view(spark, sf_dir, "crawl_lines"), f"file://{tmp_path}/s", 5)
    found = src.from_index(spark, index_lines(index), f"file://{tmp_path}/s")
    plain = view(spark, sf_dir, "crawl_lines").filter(
        "surt rlike '^(io,greenhouse,boards|com,ashbyhq,jobs|com,workable,apply|co,lever,jobs)[)]'")
    assert found.count() == plain.count() > 0
    assert src.cluster_blocks(index_lines(index), True).select("shard", "offset").distinct().count() < index.count()


def test_empty_and_null_lines(spark, tmp_path):
    none = spark.createDataFrame([], "surt string, line string")
    index = write_blocks(none, f"file://{tmp_path}/none")
    assert index.count() == 0
    assert read_blocks(spark, index, f"file://{tmp_path}/none").count() == 0
    odd = spark.createDataFrame([(None, "a"), ("k", None), ("k", ""), ("k", "é\u2028x")], "surt string, line string")
    index = write_blocks(odd, f"file://{tmp_path}/odd", 2)
    assert sorted(r["line"] for r in read_blocks(spark, index, f"file://{tmp_path}/odd").collect()) == ["", "a", "é\u2028x"]


def test_paths(spark, tmp_path):
    assert arrow_uri("s3a://b/k/x") == "s3://b/k/x" and arrow_uri("file:/tmp/x") == "file:///tmp/x"
    assert arrow_uri("file:///tmp/x") == "file:///tmp/x" and arrow_uri("hdfs://n:1/x") == "hdfs://n:1/x"
    for path in ("viewfs://s/x", "/tmp/x"):
        with pytest.raises(ValueError):
            arrow_uri(path)
    assert resolved(spark, f"{tmp_path}/new/x").rstrip("/").endswith(f"{tmp_path}/new/x")
    assert resolved(spark, f"{tmp_path}/new/x").startswith("file:")
