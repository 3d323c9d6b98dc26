"""op7's ids come from whole columns of texts: Python looks a word up once a batch, however often it stands there."""

import numpy as np
import pyarrow as pa

from causeway.llm import tokenfile as O
from tests.llm.test_tokenfile import rows


def test_columns_equal_the_tokenizer_and_words_are_looked_up_once():
    with open(O.default_path(), encoding="utf-8") as f:
        encoder = O.WordEncoder(f.read())
    asked = []

    class Watched(dict):
        def get(self, word, default=None):
            asked.append(word)
            return dict.get(self, word, default)

    encoder.recent.young = Watched()
    texts = [t or "" for _, t in rows()] + ["", "it's*** ab!! ab'd d'ab. x_y a<b a|b ÿ;; ß", " ", "", "ab!! " * 2_000]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    got = encoder.column(column, O.END)
    assert got.to_pylist() == [[*encoder.tok.encode(t, add_special_tokens=False).ids, O.END] for t in texts]
    assert 0 < len(asked) == len(set(asked))
    assert encoder.column(column, O.END).equals(got)
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder(texts)] == [x[:-1] for x in got.to_pylist()]
