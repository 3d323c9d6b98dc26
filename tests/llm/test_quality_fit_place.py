"""The classifier is fitted on an executor: the driver never holds the features."""

import os

import numpy as np

from causeway.llm import quality as Q


def test_fitted_outside_the_driver(spark, monkeypatch):
    def told(rows, grades):
        return np.array([float(os.getpid()), len(rows)]), np.array([0.0, 1.0])

    monkeypatch.setattr(Q, "fit", told)
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    (pid, n), _ = Q.train(docs, labels)
    assert pid != os.getpid() and n == 40
