import glob
import random

import pandas as pd
import pytest
import sentencepiece

from causeway.llm import spm


@pytest.fixture(scope="module")
def data():
    with open(spm.default_path(), "rb") as f:
        return f.read()


def test_parity_with_the_library(data):
    r = random.Random(2)
    bits = ["the", " ", "  ", "   ", "\n", "é", "日本", "😀", "▁", "<s>", "<0x0A>", "\t", "Zyx", "12", ".", "\x00", "a" * 40, "´", "ffi"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(800)]
    texts += [" " * n for n in range(70)] + [" " * n + "the" for n in range(40)] + ["", None, "x" * 3000, "日" * 500, "a b " * 20_000]
    given = [t or "" for t in texts]
    encoder, ref = spm.Encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    ids, parity = encoder.encode(texts)
    want = ref.encode(given)
    assert [i.tolist() for i in ids] == want
    assert all(parity)
    assert encoder.decode(ids) == [t.replace("▁", " ") for t in given]


def test_tokenizer_without_cutting(data):
    encoder, ref = spm.Encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["Hello  there, world", " a", "tab\there\n\nx", "日本語 text"]
    assert [e.ids for e in encoder.tok.encode_batch(texts)] == ref.encode(texts)


def test_table(spark, data):
    rows = [(1, "Hello world", 0), (None, "a", 1), (2, None, 2), (2, "", 3), (3, "a▁b", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = spm.tokenize(df).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(sentencepiece.SentencePieceProcessor(model_proto=data).encode(t or "")) for _, t, _ in rows)
    assert all(r.round_trip and r.parity for r in got)
    assert spm.tokenize(df.limit(0)).count() == 0


def test_all_test_documents(data):
    texts = pd.read_parquet(glob.glob("/root/testdata/sf0.001/documents.parquet")[0])["text"].tolist()
    ids, parity = spm.Encoder(data).encode(texts)
    assert all(parity)
    assert [i.tolist() for i in ids] == sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)


def test_unigram_scores():
    """A unigram model made here by hand: its protobuf is read and the best path by scores is taken."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def msg(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("a", -4.0, 1), ("b", -4.0, 1), ("ab", -4.5, 1), ("c", -5.0, 1)]
    data = b"".join(msg(1, msg(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    data += msg(2, varint(3 << 3) + varint(1)) + msg(3, msg(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1))
    ref = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab", "abc ab", "  c   ab ", "cab", "a b"]
    assert spm.Encoder(data, check=False).encode(texts)[0][0].tolist() == [2]
    assert [i.tolist() for i in spm.Encoder(data, check=False).encode(texts)[0]] == ref.encode(texts)
