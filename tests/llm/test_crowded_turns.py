"""Turns over large buckets read the shingles of all their texts again only where many texts have gone."""

from causeway.llm import simhash as S
from tests.llm.test_crowded_copies import family, shingles


def test_shingles_are_not_joined_again_each_turn(spark, monkeypatch):
    made, kind = [], type(spark.range(1))
    join = kind.join

    def watched(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if self.columns == ["node", "gram"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(kind, "join", watched)
    texts = family(10, 120)
    got = S.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=(4, 5), many=16).count()
    sets = [shingles(t) for t in texts]
    linked = [any(5 * len(a & b) >= 4 * len(a | b) for b in sets[:i]) for i, a in enumerate(sets)]
    assert got == len(texts) - sum(linked)
    assert sum(made) <= sum(map(len, sets))
