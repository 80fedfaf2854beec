import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from tests.llm.conftest import prose, rows_of
from vacancia.llm.bpe import BLANK_RUN, encode, encode_documents, encoding, encoding_digests, pieces

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return encoding(RANKS, P.PATTERN)


def each_match(enc, text):
    """Every match of the pattern on its own, by the merges alone."""
    return [i for m in regex.findall(P.PATTERN, text) for i in enc._encode_single_piece(m.encode())]


TEXTS = ["", "a", " ", "don't 'stop'S", "x  y\n\n z\t", "naïve ÉCOLE 漢字かな 한글 👩‍👩‍👧", "1234 5a6b!?..", "<|endoftext|>",
         "a'b'c's't", " x y", "é " * 5]


def test_pieces_do_not_change_the_ids(enc):
    texts = TEXTS + [prose(3, 2000), (prose(4, 200) + "\n ,;") * 5, "a1b2" * 500, "!?" * 900 + "ab", "漢" * 3000]
    for text in texts:
        cut = list(pieces(text, 37))
        assert "".join(cut) == text
        whole = enc.encode_ordinary(text)
        assert [i for p in cut for i in enc.encode_ordinary(p)] == whole == each_match(enc, text)


def test_long_runs_of_blanks(enc):
    n = BLANK_RUN + 5
    for text in ["a" + " " * n + "b", " " * n, "\n" * n + "x", " " * n + "\nx y" + "\t" * n, "q" + "  " * n + "'s"]:
        assert encode(enc, text) == enc.encode_ordinary(text)
    assert enc.decode_bytes(encode(enc, " " * 1_500_000 + "z")) == b" " * 1_500_000 + b"z"


def test_very_long_single_matches(enc):
    text = "ab" * 400_000
    assert enc.decode_bytes(encode(enc, text)) == text.encode()


def test_awkward_rows(enc, awkward, nothing):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in awkward.select("doc_id", "text").collect():
        ids = own.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = encoding_digests(awkward, RANKS, P.PATTERN)
    assert rows_of(got, *got.columns) == sorted(want, key=lambda r: [(x is None, str(x)) for x in r])
    assert encoding_digests(nothing, RANKS, P.PATTERN).count() == 0
    full = encode_documents(awkward, RANKS, P.PATTERN).collect()
    assert all(enc.decode_bytes(r["ids"]) == bytes(r["decoded"]) for r in full)
