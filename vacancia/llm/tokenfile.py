"""Token-id files with fixed-width bit packing.

An id takes the least number of bits that the vocabulary needs. A file is a
sequence of blocks of ``BLOCK`` ids, each packed on its own from a byte
boundary, then the documents' ids, null marks and lengths, the offsets of the
blocks, and a fixed trailer. A reader finds any id range from the block offsets
and unpacks it with numpy, without touching other blocks.

Documents are dealt by id range, so that each file holds a contiguous stretch
of the ascending order and the files together hold all of it.
"""
from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.ranges import id_bounds, range_number
from vacancia.llm.texts import whole
from vacancia.session import reliable, shared_dir
from vacancia.sources.storage import opened_store, resolved

BLOCK = 1 << 16
MAGIC = b"TOKBITS1"
#: magic, bits, block length, documents, ids, blocks, offset of the document table
TRAILER = "<8sIIQQQQ"
#: Words remembered by a task, and the longest that is.
REMEMBERED, LONGEST = 400_000, 64
#: Ids unpacked at once when documents are read.
READ_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    """The least width that holds the ids 0 to ``vocabulary - 1``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of ``bits`` bits, lowest bit first."""
    if bits in (8, 16, 32):                            # the same bytes, without going through single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8), bitorder="little").reshape(-1, 32)
    return np.packbits(spread[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = fields
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class TokenFileWriter:
    """Streams documents into one file; holds one block and three numbers a document."""

    def __init__(self, sink, bits: int) -> None:
        self.sink, self.bits, self.at, self.total = sink, bits, 0, 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.keys: list[int] = []
        self.nulls: list[bool] = []
        self.lengths: list[int] = []
        self.offsets: list[int] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        done = 0
        while len(ids) - done >= least and done < len(ids):
            data = pack(ids[done: done + BLOCK], self.bits)
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
            done += BLOCK
        self.waiting = [ids[done:]]
        self.held = len(self.waiting[0])

    def close(self) -> None:
        self._flush(1)
        self.sink.write(np.array(self.keys, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes()
                        + np.array(self.lengths, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.sink.write(struct.pack(TRAILER, MAGIC, self.bits, BLOCK, len(self.keys), self.total, len(self.offsets), self.at))


class TokenFile:
    """Random access to a file: the id ranges and the documents."""

    def __init__(self, source) -> None:
        self.source = source
        size = struct.calcsize(TRAILER)
        end = source.size() - size
        magic, self.bits, self.block, n, self.total, blocks, table = struct.unpack(TRAILER, source.read_at(size, end))
        if magic != MAGIC:
            raise ValueError("not a token file")
        data = source.read_at(end - table, table)
        self.keys = np.frombuffer(data, "<i8", n)
        self.nulls = np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)
        self.starts = np.concatenate(([0], np.cumsum(np.frombuffer(data, "<u8", n, 9 * n), dtype=np.int64)))
        self.offsets = np.append(np.frombuffer(data, "<u8", blocks, 17 * n), np.uint64(table)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids in ``[start, stop)``, from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        out = []
        for b in range(first, last + 1):
            lo, hi = (int(self.offsets[k] - self.offsets[first]) for k in (b, b + 1))
            out.append(unpack(data[lo:hi], min(self.block, self.total - b * self.block), self.bits))
        return np.concatenate(out)[start - first * self.block: stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(key, start, ids)`` of each document, unpacking a bounded stretch at a time."""
        at = 0
        while at < len(self.keys):
            stop = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + READ_IDS, "right")) - 1)
            ids, base = self.ids(int(self.starts[at]), int(self.starts[stop])), self.starts[at]
            for d in range(at, stop):
                yield (None if self.nulls[d] else int(self.keys[d]), int(self.starts[d]),
                       ids[self.starts[d] - base: self.starts[d + 1] - base])
            at = stop


class _Known(dict):
    """Packed ids of the words seen, encoded when first asked for."""

    def __init__(self, model, foreign: re.Pattern) -> None:
        super().__init__({"": b""})
        self.model, self.foreign = model, foreign
        # Byte-level models write bytes as printable characters: most as themselves, the rest from 256 on.
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.printed = {b: 256 + k for k, b in enumerate(odd)}
        probes = ("a", "the", "zebra", "qxjkvbzw", "internationally", "é", "straße", "ñandú", "œuvre", "łódź")
        self.plain = all(self._merged(w) == self._encoded(w) for w in probes)

    def _encoded(self, word: str) -> bytes:
        return array("I", self.model.encode(word, add_special_tokens=False).ids).tobytes()

    def _merged(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(self.printed)
        return array("I", [t.id for t in self.model.model.tokenize(word)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        # A run of small Latin letters is a word of its own that no normalisation changes; the merges alone give its ids.
        simple = self.plain and word.isalpha() and word.islower() and not self.foreign.search(word)
        packed = self._merged(word) if simple else self._encoded(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= LONGEST:
            self[word] = packed
        return packed


class WordEncoder:
    """Whole texts by a ``tokenizers`` model that never joins text across blanks.

    A text is cut at ASCII blanks, which such a model drops, and the ids of the
    words seen are remembered. Where the model folds case and parts letters from
    the punctuation behind them (both are tried out first), ASCII texts are
    folded and cut there too, which makes words recur. The ids are those of the
    whole text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.blanks, self.ends = re.compile(r"[ \t-\r]+"), re.compile(r"[.,;:!?](?<=[a-zß-öø-ÿ].)")
        # Outside ASCII, composed Latin letters and general punctuation; the dotted capital I has a long lower case.
        self.foreign = re.compile("[^\0-;=-\x7f\xa1-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e]")
        self.known = _Known(model, self.foreign)
        probes = [("The", "the"), ("QUIck", "quick"), ("end.", "end ."), ("who?!", "who ?!"), ("a,b;c:", "a ,b ;c :"), ("É", "é"), ("Ÿ", "ÿ"), ("ü.", "ü .")]
        self.folds = all(self.known._encoded(x) == self.known._encoded(y) for x, y in probes)

    def ids(self, text: str) -> np.ndarray:
        # Special tokens are matched before folding, so texts that could hold one are left as they are.
        if self.folds and not self.foreign.search(text):
            text = self.ends.sub(r" \g<0>", text.lower())
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.blanks.split(text))), np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int,
                      text: str = "text", doc_id: str = "doc_id", files: int | None = None) -> DataFrame:
    """Encode, pack and write; ``number, file, n_docs, n_ids`` of the files, in ascending order of ids.

    A file is written under a name of the attempt's own and then renamed, so a
    lost or repeated task leaves one whole file.
    """
    spark = docs.sparkSession
    path = resolved(spark, path)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = docs[doc_id].cast("long")
    rows = docs.select(key.alias("doc_id"), key.isNull().alias("missing"), whole(docs[text]).alias("t"))
    bounds = id_bounds(rows.select("doc_id"), "doc_id", files)
    dealt = (rows.withColumn("number", range_number(F.col("doc_id"), bounds).cast("int"))
             .repartition(files, "number").sortWithinPartitions("number", F.col("doc_id").asc_nulls_first(), "t")
             .withColumn("doc_id", F.coalesce("doc_id", F.lit(0))))      # pandas would turn a column with nulls to floats
    bits = bits_for(max(vocabulary, end_id + 1))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, (fs, folder) = WordEncoder(tokenizer_path), opened_store(path)
        fs.create_dir(folder, recursive=True)
        number = writer = sink = part = None

        def finish() -> pd.DataFrame:
            writer.close()
            sink.close()
            name = f"{folder}/{number:06d}.ids"
            fs.move(part, name)
            return pd.DataFrame({"number": [number], "file": [f"{path}/{number:06d}.ids"],
                                 "n_docs": [len(writer.keys)], "n_ids": [writer.total]})
        for batch in batches:
            for key, missing, t, to in zip(*(batch[c] for c in ("doc_id", "missing", "t", "number")), strict=True):
                if to != number:
                    if writer:
                        yield finish()
                    number, part = to, f"{folder}/.{to:06d}-{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(part)
                    writer = TokenFileWriter(sink, bits)
                writer.add(None if missing else key, np.append(encoder.ids(t), np.uint32(end_id)))
        if writer:
            yield finish()
    return reliable(dealt.mapInPandas(write, "number int, file string, n_docs bigint, n_ids bigint"))


def read_token_files(written: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before it. Only the table of
    files, one row each, is ordered as a whole.
    """
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = written.select("number", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    spread = placed.repartition(int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")), "number")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, base in zip(batch["file"], batch["base"], strict=True):
                fs, local = opened_store(name)
                with fs.open_input_file(local) as source:
                    rows = [(key, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                            for key, start, ids in TokenFile(source).documents()]
                found = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                found["doc_id"] = found["doc_id"].astype("Int64")
                yield found
    return spread.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int, text: str = "text",
                          doc_id: str = "doc_id") -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return what is read back.

    Null texts are empty and have the end id alone; documents without an id come
    first; equal ids are ordered by text; an empty table has no files.
    """
    path = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, path, tokenizer_path, vocabulary, end_id, text, doc_id))
