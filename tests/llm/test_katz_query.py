from causeway.llm import katz
from causeway.llm.common import read
from causeway.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_query_is_of_order_three(spark):
    got = {r.doc_id: round(r.score, 6) for r in QUERIES["op8_katz_scoring"](spark, SF).collect()}
    want = {r.doc_id: round(r.score, 6) for r in katz.score(read(spark, SF, "documents"), order=3).collect()}
    assert got == want
