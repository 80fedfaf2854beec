"""Byte-level BPE encoding and decoding of whole texts with tiktoken.

The rank file is read by the task that needs it. A long text is first cut at
places that no match of the pre-split pattern spans, which bounds the stack and
the memory of a call and cannot change the ids; decoding joins raw bytes, since
a token may end inside a character.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from vacancia.llm.texts import map_texts, whole

#: Texts longer than this are cut; a piece may be longer where no cut is safe.
PIECE_CHARS = 50_000
#: A longer run of blanks is handed to the merges without the regular expression, whose stack it could fill.
BLANK_RUN = 10_000
#: The characters with the Unicode property White_Space.
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# Before an ASCII blank that follows no blank, and between a letter or a digit and ASCII punctuation:
# no alternative of the pattern matches across either.
CUTS = r"(?<=[^\s\x1c-\x1f\x85])(?=[\x20\x09-\x0D])|(?<=[\p{L}\p{N}])(?=[!-/:-@\[-`{-~])"


def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a local rank file; a task makes one."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters, cut at safe places only."""
    import regex

    start = 0
    while len(text) - start > limit:
        cut = regex.compile(CUTS).search(text, start + limit)
        if cut is None or cut.start() >= len(text):
            break
        yield text[start: cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc, text: str) -> list[int]:
    """The ids that ``enc`` gives for the whole text without special tokens."""
    import regex

    ids: list[int] = []
    start = 0
    if len(text) > BLANK_RUN:
        for run in regex.finditer(BLANK + "{%d,}" % (BLANK_RUN + 1), text):
            # A run is one match of the pattern, but for a last blank that belongs to what follows it.
            end = run.end() if run.end() == len(text) else run.end() - 1
            for piece in pieces(text[start: run.start()]):
                ids.extend(enc.encode_ordinary(piece))
            ids.extend(enc._encode_single_piece(text[run.start(): end].encode("utf-8")))
            start = end
    for piece in pieces(text[start:] if start else text):
        ids.extend(enc.encode_ordinary(piece))
    return ids


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, ids, decoded``: the token ids of each whole text and the bytes they decode to.

    ``ranks_path`` is a file that every worker has (the vocabulary is installed,
    not shipped). Null and empty texts have no ids and decode to no bytes; null
    ids and repeated rows are carried along.
    """
    return _per_document(docs, ranks_path, pattern, text, doc_id, {"ids": "array<int>", "decoded": "binary"},
                         lambda ids, raw: (ids.astype(np.int32), raw))


def encoding_digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode_documents``, without its arrays."""
    return _per_document(
        docs, ranks_path, pattern, text, doc_id,
        {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        lambda ids, raw: (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))


def _per_document(docs: DataFrame, ranks_path: str, pattern: str, text: str, doc_id: str, fields: dict[str, str],
                  shape) -> DataFrame:
    def compute():
        enc = encoding(ranks_path, pattern)

        def each(texts: list[str]) -> list[tuple]:
            out = []
            for t in texts:
                ids = encode(enc, t)
                out.append(shape(np.array(ids, "<u4"), enc.decode_bytes(ids)))
            return out
        return each
    return map_texts(docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("t")), "t", compute, fields)
