"""WARC archives: deduplicating writer, and a reader that verifies record boundaries.

Writing uses the text sink with the record terminator as line separator, so the
archives go through Spark's commit protocol to any file system it can write.

Reading cuts the files into byte ranges. A task finds every place in its range
that looks like a record start, follows the declared lengths, and emits the
candidate's offset and where its chain of successors leaves the range. Payloads
may hold such places too, so no candidate is believed by its looks: starting at
byte 0 of each file, pointer jumping marks the candidates that the chain
reaches. The jumps are doubled in each round, so the number of rounds is the
logarithm of the ranges in a file. Only reachable records are then read.
"""
from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm.texts import whole
from vacancia.session import reliable, shared_dir
from vacancia.sources.storage import opened_store, resolved

CRLF = "\r\n"
END = CRLF + CRLF
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
#: Bytes of a file that one task searches, those of a header that are looked at first, and those that a walk reads ahead.
RANGE = 8 << 20
HEADER = 4 << 10
AHEAD = 1 << 20
#: Bodies that occur more than once are joined by broadcast up to this number (a digest and an id each).
MOST_BROADCAST = 100_000
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: A line that is no header field and does not continue one.
STRAY = re.compile(rb"\r\n(?![ \t])[^:\r]*\r\n")


def _header(fields: list[tuple[str, Column]]) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit(VERSION + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF))


def with_roles(pages: DataFrame, page_id: str = "page_id", payload: str = "html",
               least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, body, digest, n_bytes, refers_to`` of each page.

    Of the pages with equal bodies of at least ``least`` bytes, all but that
    with the largest id refer to it. The largest id per digest is an aggregate
    that is folded map-side. Only digests that occur more than once come back to
    the pages: by broadcast if they are counted to be few, so that no body is
    moved, and otherwise by a join that may be split.
    """
    body = whole(pages[payload])
    url = whole(F.col("url")) if "url" in pages.columns else F.lit("")
    rows = pages.select(pages[page_id].alias("page_id"), url.alias("url"), body.alias("body"),
                        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    large = F.col("n_bytes") >= least
    last = (rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1").select("digest", "last"))
    last = reliable(last)
    if last.count() <= MOST_BROADCAST:
        last = F.broadcast(last)
    return (rows.join(last, "digest", "left")
            .withColumn("refers_to", F.when(large & (F.col("last") != F.col("page_id")), F.col("last")))
            .drop("last"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", payload: str = "html") -> None:
    """Write one record per page: a response with its body, or a revisit that names the response.

    Null ids and repeated ids are written like any other; a null body is empty.
    """
    p = with_roles(pages, page_id, payload)
    revisit = F.col("refers_to").isNotNull()
    name = F.concat(F.lit("urn:page:"), F.col("page_id").cast("string"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    head = _header([
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.concat(F.lit("<"), name, F.lit(">"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        ("X-Payload-Length", F.col("n_bytes").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ])
    p.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _opened(path: str):
    """The file behind a full Spark path, by whichever file system its scheme names."""
    fs, name = opened_store(path)
    return fs.open_input_file(name)


class Stretch:
    """A file with one stretch of it in memory; what lies outside is read, with ``ahead`` bytes the stretch moves on."""

    def __init__(self, source, start: int = 0, data: bytes = b"", ahead: int = 0) -> None:
        self.source, self.start, self.data, self.ahead = source, start, data, ahead

    def read_at(self, n: int, at: int) -> bytes:
        low = at - self.start
        if low < 0 or low + n > len(self.data):
            if not self.ahead or n < HEADER:      # a few bytes elsewhere: where a record should end
                return self.source.read_at(n, at)
            self.start, self.data, low = at, self.source.read_at(max(n, self.ahead), at), 0
        return self.data[low:low + n]

    def size(self) -> int:
        return self.source.size()


def archive_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``path, length, start``: the byte ranges of every archive under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    return ranges.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start")


def _fields(header: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in header.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _record(source, at: int, length: int) -> tuple[dict[str, str], int, int] | None:
    """Header fields, body offset and successor of the candidate at ``at``, if its form holds.

    A header may have any length: reading goes on while its lines look like fields.
    """
    head = source.read_at(min(HEADER, length - at), at)
    if not MAGIC.match(head):
        return None
    seen = 0
    while (end := head.find(b"\r\n\r\n", seen)) < 0:
        if at + len(head) >= length or STRAY.search(head, max(head.rfind(b"\r\n", 0, seen), 0)):
            return None
        seen = len(head) - 3
        head += source.read_at(min(len(head), length - at - len(head)), at + len(head))
    fields = _fields(head[:end])
    declared = fields.get("content-length", "")
    if not (declared.isascii() and declared.isdigit() and len(declared) < 19):
        return None
    body = at + end + 4
    after = body + int(declared) + 4
    if after > length or source.read_at(4, after - 4) != b"\r\n\r\n":
        return None
    return fields, body, after


def candidate_links(ranges: DataFrame, size: int = RANGE) -> DataFrame:
    """``path, offset, exit`` of every place that looks like a record.

    ``exit`` is where the chain of successors from there leaves the range: the
    task follows the links inside its own range, which shortens the chains that
    are left to jump over to one link a range. It is null where the chain
    breaks inside the range.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length, start in zip(batch["path"], batch["length"], batch["start"], strict=True):
                with _opened(path) as source:
                    # A magic that begins in the range may end behind it.
                    data = source.read_at(min(size + 16, length - start), start)
                    places = [start + m.start() for m in MAGIC.finditer(data) if m.start() < size]
                    held = Stretch(source, start, data)
                    links = {at: r[2] for at in places if (r := _record(held, at, length))}
                leaves: dict[int, int | None] = {}
                for at in reversed(places):
                    if at in links:
                        leaves[at] = links[at] if links[at] >= start + size else leaves.get(links[at])
                yield pd.DataFrame({"path": path, "offset": pd.Series(leaves.keys(), dtype="int64"),
                                    "exit": pd.Series(leaves.values(), dtype="Int64")})
    return ranges.mapInPandas(scan, "path string, offset bigint, exit bigint")


def reachable(links: DataFrame) -> DataFrame:
    """``path, offset``: where the chain from byte 0 of each file enters its ranges.

    Every round adds what the reached places jump to and doubles the jumps; it
    ends when nothing new is reached.
    """
    links = reliable(links)               # the archives are searched once
    jumps = reliable(links.filter("exit is not null").select("path", "offset", F.col("exit").alias("to")))
    places = reliable(links.select("path", "offset"))
    reached = reliable(places.filter("offset = 0"))
    count = reached.count()
    while True:
        ahead = reached.join(jumps, ["path", "offset"]).select("path", F.col("to").alias("offset"))
        there = ahead.join(places, ["path", "offset"], "left_semi")
        reached = reliable(reached.union(there).distinct())
        now = reached.count()
        if now == count:
            return reached
        count = now
        further = jumps.select("path", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        jumps = reliable(jumps.join(further, ["path", "to"]).select("path", "offset", F.col("beyond").alias("to")))


def read_records(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """One row per verified record: place, header values, the size and digest of its body, and where it ends.

    A chain that breaks gives the records before the break; ``unfinished`` names such files. A task gets the entry into a range and walks the chain to the range's end.
    """
    entries = reachable(candidate_links(archive_ranges(spark, path, size), size))
    names = ["path", "offset", "type", "page", "refers", "declared_digest", "n_bytes", "digest", "end"]

    def walk(name: str, at: int) -> Iterator[tuple]:
        with _opened(name) as file:
            source = Stretch(file, ahead=AHEAD)
            length, end = source.size(), (at // size + 1) * size
            while at < min(end, length) and (record := _record(source, at, length)):
                fields, body, after = record
                digest, left = hashlib.sha1(), after - 4 - body
                while left:
                    part = source.read_at(min(left, AHEAD), after - 4 - left)
                    digest.update(part)
                    left -= len(part)
                yield (name, at, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"),
                       fields.get("warc-payload-digest"), after - 4 - body, digest.hexdigest(), after)
                at = after

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, at in zip(batch["path"], batch["offset"], strict=True):
                yield pd.DataFrame(walk(name, at), columns=names)
    spread = entries.repartition(spark.sparkContext.defaultParallelism * 4, "path", "offset")
    return spread.mapInPandas(
        read, "path string, offset bigint, type string, page string, refers string, declared_digest string, "
              "n_bytes bigint, digest string, end bigint")


def unfinished(records: DataFrame, path: str) -> DataFrame:
    """``path, length, end`` of the archives under ``path`` whose records do not end at the file's length."""
    files = records.sparkSession.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    ends = records.groupBy("path").agg(F.max("end").alias("end"))
    return files.join(ends, "path", "left").filter(~F.col("end").eqNullSafe(F.col("length")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record.

    A revisit takes size and digest from the response that it names, which is
    checked against the digest that it declares; where that response is missing
    or differs, both are null.
    """
    number = F.regexp_extract("page", r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    other = F.regexp_extract(F.coalesce("refers", F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    rows = records.select(number.alias("page_id"), F.col("type").alias("record_type"), other.alias("refers_to"),
                          "declared_digest", "n_bytes", "digest")
    full = (rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("their"))
            .agg(F.max("n_bytes").alias("their_bytes"))
            .withColumn("declared_digest", F.concat(F.lit("sha1:"), F.col("their"))))
    revisit = F.col("record_type") == "revisit"
    return rows.join(full, ["refers_to", "declared_digest"], "left").select(
        "page_id", F.when(revisit, F.col("their_bytes")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("their")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and return what is read back.

    Raises if an archive cannot be read to its end.
    """
    spark = pages.sparkSession
    path = f"{resolved(spark, shared_dir(spark))}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, page_id, payload)
    records = reliable(read_records(spark, path))
    if broken := unfinished(records, path).take(5):
        raise ValueError(f"archives that break off: {[tuple(r) for r in broken]}")
    return resolve_revisits(records)
