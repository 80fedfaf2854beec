"""Sorted line files in separately compressed blocks, and reading of chosen blocks only.

A shard is a file of gzip members, each a run of consecutive lines; the index has a
line per block: the first key, the shard, the block's offset and length. A query
picks blocks from the index, and the ``gzip_blocks`` data source reads exactly
those byte ranges: its partitions are runs of chosen blocks, of a bounded number of
bytes, so tasks follow the bytes that are wanted and not the size of the shards.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vacancia.session import reliable, shared_dir
from vacancia.sources.storage import opened_store, resolved

#: Lines of a block, as in the public crawl indexes.
LINES = 3000
#: Compressed bytes that one task reads.
TASK_BYTES = 32 << 20
#: A line's number is its block's offset times this plus its place in the block.
ROWS = 1 << 20


def write_blocks(lines: DataFrame, path: str, lines_per_block: int = LINES) -> DataFrame:
    """Write ``lines(surt, line)`` in the order of keys and lines; the index: surt, shard, offset, length, lines.

    The order is a range partitioning, one shard a task. A shard is written under a name of
    the attempt's own and renamed when it is whole, so a repeated task replaces it. ``surt`` of
    an index row is the key of the block's first line. Null lines are left out.
    """
    spark = lines.sparkSession
    folder = resolved(spark, path)
    fs, local = opened_store(folder)
    fs.create_dir(local, recursive=True)
    ordered = (lines.filter("line is not null").select(F.coalesce("surt", F.lit("")).alias("surt"), "line")
               .repartitionByRange("surt", "line").sortWithinPartitions("surt", "line")
               .select(F.spark_partition_id().alias("task"), "surt", "line"))

    def write(batches):
        import gzip

        import pyarrow as pa

        fs, local = opened_store(folder)
        shard = sink = part = None
        index: list[tuple[str, str, int, int, int]] = []
        keys: list[str] = []
        text: list[str] = []
        at = 0

        def flush() -> None:
            nonlocal at, keys, text
            data = gzip.compress("".join(f"{line}\n" for line in text).encode("utf-8"), mtime=0)
            sink.write(data)
            index.append((keys[0], shard, at, len(data), len(text)))
            at += len(data)
            keys, text = [], []
        for batch in batches:
            if shard is None and batch.num_rows:
                shard = f"cdx-{batch.column('task')[0].as_py():05d}.gz"
                part = f"{local}/.{shard}-{uuid.uuid4().hex}"
                sink = fs.open_output_stream(part)
            for key, line in zip(batch.column("surt").to_pylist(), batch.column("line").to_pylist(), strict=True):
                keys.append(key)
                text.append(line)
                if len(text) == lines_per_block:
                    flush()
        if shard is not None:
            if text:
                flush()
            sink.close()
            fs.move(part, f"{local}/{shard}")
        names = ["surt", "shard", "offset", "length", "lines"]
        columns = list(zip(*index, strict=True)) if index else [[]] * 5
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    return reliable(ordered.mapInArrow(write, "surt string, shard string, offset long, length long, lines long"))


def index_lines(index: DataFrame, doc: str = "cluster.idx") -> DataFrame:
    """The index as text lines ``doc, line_no, line``: key and time, shard, offset, length, number."""
    return index.select(
        F.lit(doc).alias("doc"), F.col("offset").alias("line_no"),
        F.concat_ws("\t", F.concat("surt", F.lit(" 0")), "shard", F.col("offset").cast("string"),
                    F.col("length").cast("string"), F.col("lines").cast("string")).alias("line"))


class BlockRun(InputPartition):
    """Blocks of one task: (shard, offset, length) in the order of the files."""

    def __init__(self, blocks: list[tuple[str, int, int]]) -> None:
        super().__init__(len(blocks))
        self.blocks = blocks


def runs(blocks: list[tuple[str, int, int]], most: int = TASK_BYTES) -> list[list[tuple[str, int, int]]]:
    """``blocks`` in order, cut into tasks of at most ``most`` bytes or a single block."""
    out: list[list[tuple[str, int, int]]] = []
    size = most
    for block in sorted(set(blocks)):
        if size + block[2] > most:
            out.append([])
            size = 0
        out[-1].append(block)
        size += block[2]
    return out


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}        # Spark lower-cases the names
        self.root, self.selected = options["path"], options["selected"]
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.skip = options.get("onerror", "raise") == "skip"

    def partitions(self) -> list[BlockRun]:
        """One partition per run of the selected blocks, read from their table in the shared folder."""
        import pyarrow.dataset as ds

        fs, local = opened_store(self.selected)
        table = ds.dataset(local, filesystem=fs, format="parquet").to_table(columns=["shard", "offset", "length"])
        blocks = list(zip(*(table.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True))
        return [BlockRun(run) for run in runs(blocks, self.task_bytes) or [[]]]

    def read(self, partition: BlockRun) -> Iterator:
        import pyarrow as pa

        fs, local = opened_store(self.root)
        name = source = None
        try:
            for shard, offset, length in partition.blocks:
                if shard != name:
                    if source:
                        source.close()
                    name, source = shard, fs.open_input_file(f"{local}/{shard}")
                try:
                    lines = _lines(source.read_at(length, offset), length)
                except (ValueError, zlib.error) as broken:
                    if self.skip:
                        continue
                    raise ValueError(f"{shard} at {offset}, {length} bytes: {broken}") from broken
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n), pa.array([offset] * n, pa.int64()), pa.array([length] * n, pa.int64()),
                     pa.array(range(n), pa.int64()), pa.array(lines, pa.string())],
                    ["shard", "offset", "length", "row", "line"])
        finally:
            if source:
                source.close()


def _lines(data: bytes, length: int) -> list[str]:
    """The lines of a block, which is one whole gzip member."""
    if len(data) != length:
        raise ValueError(f"only {len(data)} bytes are there")
    unzip = zlib.decompressobj(wbits=31)
    text = unzip.decompress(data) + unzip.flush()
    if not unzip.eof or unzip.unused_data:
        raise ValueError("not one whole gzip member")
    lines = text.decode("utf-8", "replace").split("\n")
    if not lines[-1]:
        lines.pop()
    if len(lines) > ROWS:
        raise ValueError(f"{len(lines)} lines in a block; {ROWS} can be numbered")
    return lines


class GzipBlocks(DataSource):
    """``format("gzip_blocks")``: the lines of selected blocks.

    Options: ``path`` (folder of the shards), ``selected`` (Parquet folder with the columns
    shard, offset, length), ``taskBytes``, and ``onError``: ``raise`` (default) or ``skip``
    blocks that are cut off or no gzip member. Both paths are full ones.
    """

    @classmethod
    def name(cls) -> str:
        return "gzip_blocks"

    def schema(self) -> str:
        return "shard string, offset long, length long, row long, line string"

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def read_blocks(spark: SparkSession, blocks: DataFrame, path: str, on_error: str = "raise",
                task_bytes: int = TASK_BYTES) -> DataFrame:
    """The lines of ``blocks`` (shard, offset, length; more columns are ignored) as ``doc, line_no, line``.

    A block that is selected several times is read once. ``line_no`` rises with the place
    in the shard. Only (shard, offset, length) of the selected blocks passes through the planner, as a
    file listing does; the selection itself and all lines stay on the executors.
    """
    spark.dataSource.register(GzipBlocks)
    selected = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    blocks.select("shard", "offset", "length").distinct().write.parquet(selected)
    lines = (spark.read.format("gzip_blocks").option("selected", resolved(spark, selected)).option("onError", on_error)
             .option("taskBytes", task_bytes).load(resolved(spark, path)))
    return lines.select(F.col("shard").alias("doc"), (F.col("offset") * ROWS + F.col("row")).alias("line_no"), "line")
