"""Contexts' shares move only to blocks that back off from them; others are told whether something is left."""

import zlib

import pytest
from pyspark.sql import functions as F

from causeway.llm import katz as K
from tests.llm.test_katz import Plain


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("unseen", [0, 3])
def test_shares_go_where_an_ngram_is_unseen(spark, monkeypatch, unseen):
    told, exchange = [], K.Tables.exchange

    def watched(self, ask, kinds):
        exchange(self, ask, kinds)
        rows = spark.table(self.names[-1]).where("block >= 0").select(F.explode(f"answers{len(self.names) - 1}").alias("a")).where("a.kind < 0").select("a.*")
        told.extend((r.kind, len(K._unpacked(r.asDict(), "a")), len(K._unpack(r["first"], "u1"))) for r in rows.collect())

    monkeypatch.setattr(K.Tables, "exchange", watched)
    learned = [(i, " ".join(f"w{(i * j + j) % 7}" for j in range(30)) + " just so" * 8) for i in range(60) if not held(i)]
    apart = [(i, "w1 so w2 just") for i in range(100, 200) if held(i)][:unseen]
    got = K.score(spark.createDataFrame(learned + apart, "doc_id long, text string"), block_tokens=300, part_tokens=200).collect()
    model = Plain([t for _, t in learned], 3)
    want = {i: round(model.score(t), 6) for i, t in learned + apart}
    assert {r.doc_id: round(r.score, 6) for r in got} == want
    for kind in (-2, -3):
        shares = sum(n for k, n, _ in told if k == kind)
        assert sum(n for k, _, n in told if k == kind) > 0
        assert shares <= sum(r.n_tokens for r in got if r.held_out)
    assert (sum(n for _, n, _ in told) > 0) == bool(unseen)

