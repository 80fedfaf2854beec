import zlib

import numpy as np
import pyarrow.fs as pafs
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from vacancia.llm import tokenfile
from vacancia.llm.tokenfile import TokenFile, TokenFileWriter, WordEncoder, bits_for, pack, token_file_round_trip, unpack

MODEL = P.path("word_bpe_49k.json")


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 4, 5, 49_408, 65_536, 65_537)] == [1, 1, 2, 2, 3, 16, 16, 17]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2 ** 32 - 1), max_size=70))
def test_pack_round_trip(bits, ids):
    ids = np.array([i % 2 ** bits for i in ids], np.uint32)
    data = pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert unpack(data, len(ids), bits).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [11, 16, 17])
def test_file_round_trip_and_random_access(tmp_path, monkeypatch, bits):
    monkeypatch.setattr(tokenfile, "BLOCK", 100)
    monkeypatch.setattr(tokenfile, "READ_IDS", 150)
    rng = np.random.default_rng(bits)
    docs = [(k if k % 5 else None, rng.integers(0, 2 ** bits, n, dtype=np.uint32))
            for k, n in enumerate([0, 1, 99, 100, 101, 350, 0, 7, 200])]
    fs = pafs.LocalFileSystem()
    with fs.open_output_stream(f"{tmp_path}/x") as sink:
        writer = TokenFileWriter(sink, bits)
        for key, ids in docs:
            writer.add(key, ids)
        writer.close()
    with fs.open_input_file(f"{tmp_path}/x") as source:
        file = TokenFile(source)
        got = list(file.documents())
        assert [(k, i.tolist()) for k, _, i in got] == [(k, i.tolist()) for k, i in docs]
        every = np.concatenate([i for _, i in docs])
        for a, b in [(0, 0), (0, 1), (99, 101), (150, 820), (0, len(every)), (857, 858)]:
            assert file.ids(a, b).tolist() == every[a:b].tolist()


def test_words_are_encoded_as_in_the_whole_text(monkeypatch):
    model = Tokenizer.from_file(MODEL)
    texts = ["", " ", "Hello,  WORLD's\tnew\nday 1234", "naïve ÉCOLE ΣΑΣ ß", "áb ́c", "漢字 かな　x y z",
             "<|endoftext|> x<|startoftext|>y", "a\x1cb\x85c", "👩‍👩‍👧 é", prose(3, 500), "x" * 3000, "!!?? ''s 're don't",
             "<|ENDOFTEXT|> A<|endoftext|>", "End... of;it?!yes a.b,C wow!'s x.'t\x1c9.Q", "abc" * 40,
             "Ünder.Straße, ÉTÉ! İstanbul.Ça", "ÀÉ.e\u0301.E\u0301,", "don’t – “Quoted”… Œuvre.", "Ŀŀ.ŉ,ſ.ĳ:"]
    encoder = WordEncoder(MODEL)
    for _ in range(2):
        for t in texts:
            assert encoder.ids(t).tolist() == model.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(tokenfile, "REMEMBERED", 3)
    for t in texts:
        assert encoder.ids(t).tolist() == model.encode(t, add_special_tokens=False).ids


def brute(rows):
    model, at, out = Tokenizer.from_file(MODEL), 0, []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        out.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_awkward_rows(awkward, nothing):
    got = token_file_round_trip(awkward, MODEL, 49_408, 2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(awkward.collect())
    assert token_file_round_trip(nothing, MODEL, 49_408, 2).count() == 0


def test_query(spark, sf_dir):
    import __spark_entry__ as entry
    got = entry.queries()["op3_packed_token_files"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs)
