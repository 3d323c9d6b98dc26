"""What a block's questions and answers cost doesn't go by the number of partitions."""

from pyspark.sql import functions as F

from causeway.llm import katz as K


def test_partitions_make_no_batch_and_no_answer_each(spark, monkeypatch):
    seen, exchange = [], K.Tables.exchange

    def watched(self, ask, kinds):
        rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        exchange(self, ask, kinds)
        column = f"answers{len(self.names) - 1}"
        answers = spark.table(self.names[-1]).where("block >= 0").agg(F.max(F.size(column))).first()[0]
        seen.append((int(rows), answers, self.parts, kinds))

    monkeypatch.setattr(K.Tables, "exchange", watched)
    data = [(i, " ".join(f"w{(i * j) % 50}" for j in range(30))) for i in range(40)]
    got = K.score(spark.createDataFrame(data, "doc_id long, text string"), block_tokens=200, part_tokens=100)
    assert got.count() == 40
    assert len(seen) == 4 and all(parts >= 12 for _, _, parts, _ in seen)
    assert all(rows > 100 and answers <= kinds for rows, answers, _, kinds in seen)
