"""What a worker of op7 keeps of words fits beside Spark's heap: two workers share an executor."""

import tracemalloc

from causeway.llm import tokenfile
from causeway.llm.common import Recent


def test_kept_words_stay_small():
    tracemalloc.start()
    recent = Recent(tokenfile._CACHE)
    for n in range(tokenfile._CACHE):
        recent.young[b"word%08d" % n] = n.to_bytes(12, "little")
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 130e6
