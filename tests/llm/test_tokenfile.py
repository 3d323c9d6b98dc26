import random
import zlib

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from causeway.llm import tokenfile as O


def brute(rows):
    tok, out, at = Tokenizer.from_file(O.default_path()), [], 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def rows():
    r = random.Random(8)
    bits = ["The", " ", "  ", "\n", "É", "é", "日本", "😀", "<|endoftext|>", "<|startoftext|> x", "don't", "12", "ΑΣ", "\t", "\xa0", " ", "\x85", "\x1c", "İ", "...", "x" * 70, "́", "~", "a~b", ", ", ". ", "<|ENDOFTEXT|>", "A."]
    return [(i * 7 % 101, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for i in range(101)] + [(None, "null id"), (200, None), (201, ""), (202, "word " * 30_000), (3, "again"), (3, "again")]


def test_files_equal_brute_force(spark):
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows()], "doc_id long, text string, part int, ids int")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in O.digest(df, file_bytes=64).collect())
    want = sorted((s, d, n, c) for d, s, n, c in brute(rows()))
    assert got == want


def test_whole_texts_of_the_test_documents():
    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"].tolist()
    tok = Tokenizer.from_file(O.default_path())
    with open(O.default_path(), encoding="utf-8") as f:
        got = O.WordEncoder(f.read())(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_empty(spark):
    assert O.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lookup_by_id_is_pushed_down(spark, tmp_path):
    df = spark.createDataFrame([(d, t) for d, t in rows() if d is not None], "doc_id long, text string")
    O.write(df, str(tmp_path / "t"))
    plan = O.read(spark, str(tmp_path / "t")).where("doc_id = 42")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,42)" in plan
