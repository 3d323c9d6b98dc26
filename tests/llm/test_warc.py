import hashlib
import io

import pytest
import zstandard

from causeway.llm import warc as A

PAGES = [
    (5, "http://a/1", "x" * 100, "k"),
    (2, "http://a/2", "x" * 100, "k"),
    (9, None, "x" * 100, "k"),
    (2, "http://a/again", "x" * 100, "k"),
    (None, "http://a/no id", "x" * 100, "k"),
    (3, "http://a/3", "x" * 99, "k"),
    (4, "http://a/4", "x" * 99, "k"),
    (6, "http://a/b\r\nWARC-Type: x", None, "k"),
    (7, "", "", "k"),
    (8, "http://a/8", "é" * 50, "k"),
    (1, "http://a/1", "é" * 50, "k"),
    (10, "http://a/10", "<p>" + "long " * 200_000, "k"),
]


def brute(rows):
    first = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        re = first.get(h) if i is not None and len(b) >= 100 and first[h] != i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if re is None else "revisit", re))
    return out


@pytest.mark.parametrize("size", [1, 64 << 20])
def test_round_trip(spark, size):
    rows = PAGES + [(100 + i, f"http://b/{i}", f"<html><p>page {i} of many, number {i * i}</p></html>" * 4, "k") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = A.digest(df, archive_bytes=size).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame([r[:3] for r in PAGES], "page_id long, url string, html string")
    got = A.read(spark, A.write(df, f"file://{tmp_path}/w"), payloads=True).collect()
    full = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert full[10] == PAGES[-1][2] and full[6] == "" and full[1] == "é" * 50
    urls = {r.page_id: r.url for r in got}
    assert urls[6] == "http://a/b%0D%0AWARC-Type:%20x" and urls[9] is None


def archive(trained, records):
    out = io.BytesIO()
    w = A.Writer(out, trained)
    for r in records:
        w.add(r)
    return out.getvalue()


def test_dictionary_frame():
    trained = A.dictionary([f"<html><body><p>sample {i} text {i * 7}</p>".encode() * 20 for i in range(200)])
    assert trained
    recs = [A.record(i, "http://x", b"<html><body><p>sample", hashlib.sha256(b"<html><body><p>sample").hexdigest(), None) for i in range(3)]
    data = archive(trained, recs)
    assert data[:4] == A.SKIPPABLE
    assert list(A.frames(io.BytesIO(data), 7)) == recs
    n = 8 + int.from_bytes(data[4:8], "little")
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[n:])  # not without the dictionary
    plain = A.SKIPPABLE + len(trained).to_bytes(4, "little") + trained + data[n:]
    assert list(A.frames(io.BytesIO(plain))) == recs
    assert list(A.frames(io.BytesIO(archive(b"", recs)))) == recs
    assert list(A.frames(io.BytesIO(b""))) == []


def test_broken_archives():
    good = A.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert A.parse(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), b"", good.replace(b"WARC-Type", b"Kind"), good + b"x"):
        with pytest.raises(A.Broken):
            A.parse(bad)
    data = archive(b"", [good, good])
    for cut in (data[:-3], data[:6], b"garbage" * 4):
        with pytest.raises(A.Broken):
            list(A.frames(io.BytesIO(cut)))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert A.digest(df).count() == 0
