"""Quality by ordinal regression: one weight a hashed text feature, ordered thresholds between the grades.

P(grade > k) = sigmoid(w x - theta_k), theta rising. Grades from the ratings: 0 toxic, 1 of low quality, 2 good.
The expected grade ranks documents; the tail probability P(grade = 2) selects them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.common import small_batches

BITS = 18
GRADES = 3
#: Rated rows that the model is fitted on at most: those whose hashed ids come first.
MAX_RATED = 12_000
#: Features in fewer of these rows than this get no weight.
MIN_ROWS = 5
L2, STEPS, RATE = 2.0, 200, 0.05
_CHUNK = 500
CUT = 0.6
#: Bytes of a word's beginning that count as a feature of their own: inflected words share them.
PREFIXES = (4, 5)
_CACHE = 300_000


def grade(quality: Column, toxic: Column) -> Column:
    """Null where the ratings say too little."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality >= 1, 2)


_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Bytes to words: signs and digits part words, A to Z are lower-cased, what isn't ASCII belongs to words.
_WORDS = bytes(32 if c < 128 and not chr(c).isalpha() else ord(chr(c).lower()) if c < 128 else c for c in range(256))
_UPPER = bytes(range(65, 91))


def _level(x: float, steps: int) -> int:
    return int(min(max(x, 0.0), 1.0) * steps)


def tokens(text: str | None) -> set[bytes]:
    """Distinct words in lower case, how they begin (marked ^), and coarse measures of the whole text's shape (their names have a space)."""
    data = text.encode("utf-8", "replace") if text else b""
    found = data.translate(_WORDS).split()
    distinct = set(found)
    if not found:
        distinct.add(b" empty")
        return distinct
    n, size = len(found), len(data)
    varied = len(distinct) / n
    distinct |= {b"^" + w[:k] for w in distinct for k in PREFIXES if len(w) > k}
    counts = [(b" upper", size - len(data.translate(None, _UPPER)), 10), (b" signs", size - len(data.translate(None, _SIGNS)), 40)]
    counts += [(b" sign %c" % c, data.count(c), 40) for c in b"*#$%&!|"]
    for name, k, steps in counts:
        distinct.add(b"%s %d" % (name, _level(k / size, steps)))
        distinct.add(b"%s number %d" % (name, k.bit_length()))
    distinct.add(b" varied %d %d" % (_level(varied, 10), min(n.bit_length(), 12)))
    distinct.add(b" length %d" % min(n.bit_length(), 16))
    lines = data.split(b"\n")
    distinct.add(b" lines %d" % _level(len(set(lines)) / len(lines), 10))
    return distinct


class Known(dict):
    """A number for each token, worked out once; emptied by trim() when it has grown too large."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: bytes):
        value = self[token] = self.make(token)
        return value

    def trim(self) -> None:
        if len(self) > _CACHE:
            self.clear()


def bucket(token: bytes) -> int:
    return crc32(token) & (1 << BITS) - 1


def columns(text: str | None, known: Known) -> np.ndarray:
    known.trim()
    return np.sort(np.array([known[t] for t in tokens(text)], np.int32))


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, l2: float = L2, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) with the best penalised likelihood seen on the way of shrinking gradient steps; without rows or with one grade, only thresholds."""
    w = np.zeros(1 << BITS)
    counts = np.bincount(grades, minlength=GRADES) if len(grades) else np.zeros(GRADES)
    above = (counts[::-1].cumsum()[::-1][1:] + 1) / (counts.sum() + 2)
    theta = -np.log(above / (1 - above))
    theta = np.maximum.accumulate(theta + 1e-6 * np.arange(GRADES - 1))
    if len(set(grades.tolist())) < 2:
        return w, theta
    seen = np.zeros(1 << BITS, np.int32)
    for r in rows:
        np.add.at(seen, np.unique(r), 1)
    used = np.flatnonzero(seen >= MIN_ROWS)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    w, parts = np.zeros(len(used)), []
    for i in range(0, len(rows), _CHUNK):  # what a step holds besides the features stays small
        some = [place[r][place[r] >= 0] for r in rows[i : i + _CHUNK]]
        parts.append((i, i + len(some), np.concatenate(some), np.repeat(np.arange(len(some), dtype=np.int16), [len(r) for r in some])))
    b, logs = theta[0], np.log(np.diff(theta))  # theta = b, b + exp(logs[0]), ...: always rising
    params = [w, np.array([b]), logs]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n, best, kept = len(rows), -np.inf, (w, theta)
    for step in range(1, steps + 1):
        w, (b,), logs = params
        theta = b + np.concatenate([[0.0], np.exp(logs).cumsum()])
        x = np.empty(n)
        for i, j, cols, owner in parts:
            x[i:j] = np.bincount(owner, w[cols], minlength=j - i)
        # P(y > k) for k = -1 .. GRADES - 1
        tail = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(theta - x[:, None], -40, 40))), np.zeros((n, 1))])
        slope = tail * (1 - tail)
        at = np.arange(n)
        p = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-12)
        gain = np.log(p).sum() - l2 / 2 * np.square(w).sum()
        if gain > best:
            best, kept = gain, (w.copy(), theta)
        gx = (slope[at, grades] - slope[at, grades + 1]) / p
        gt = np.zeros((n, GRADES + 1))
        gt[at, grades] -= slope[at, grades] / p
        gt[at, grades + 1] += slope[at, grades + 1] / p
        gt = gt[:, 1:GRADES].sum(0)
        later = gt[::-1].cumsum()[::-1]
        gw = np.zeros(len(w))
        for i, j, cols, owner in parts:
            gw += np.bincount(cols, gx[i:j][owner], minlength=len(w))
        grads = [gw - l2 * w, later[:1], later[1:] * np.exp(logs)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] + rate * (1 - step / (steps + 1)) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    out = np.zeros(1 << BITS)
    out[used] = kept[0]
    return out, kept[1]


def tails(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade > k), a column for each threshold."""
    return 1 / (1 + np.exp(np.clip(theta[None, :] - x[:, None], -40, 40)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rated: int = MAX_RATED) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most max_rated rated documents; ratings without id or grade don't count, of repeated ones the lowest does.

    The fit is one task on an executor, whatever the input: the driver gets the weights only.
    """
    rated = labels.select(F.col(id_col).alias("_id"), grade(F.col("quality"), F.col("toxic")).alias("_grade")).where("_id is not null and _grade is not null")
    rated = rated.groupBy("_id").agg(F.min("_grade").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(max_rated)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(rated), "_id").select("_id", "_grade", "_text")

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(bucket)
        for part in parts:
            yield pd.DataFrame({"id": part["_id"], "grade": part["_grade"], "cols": [columns(t, known).tobytes() for t in part["_text"]]})

    def fitted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, grades = [], []
        for part in parts:
            rows += [np.frombuffer(c, np.int32) for c in part["cols"]]
            grades += part["grade"].tolist()
        w, theta = fit(rows, np.array(grades, np.int64))
        yield pd.DataFrame({"w": [w.tobytes()], "theta": [theta.tobytes()]})

    small_batches(docs.sparkSession)
    rows = texts.mapInPandas(features, "id long, grade int, cols binary").groupBy("id").agg(F.min(F.struct("grade", "cols")).alias("r")).select("id", "r.*")
    got = rows.coalesce(1).sortWithinPartitions("id").mapInPandas(fitted, "w binary, theta binary").collect()  # 2 MB
    if not got:
        return fit([], np.array([], np.int64))
    return np.frombuffer(got[0].w), np.frombuffer(got[0].theta)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """A row for each input row: id_col, expected_grade, tail_prob, keep (tail_prob >= cut). Null texts count as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 1 MB, whatever the input
    rows = docs.select(F.col(id_col).alias("id"), rate_udf(shared)(F.col(text_col)).alias("r"))
    return rows.select(F.col("id").alias(id_col), "r.expected_grade", "r.tail_prob", (F.col("r.tail_prob") >= cut).alias("keep"))


def rate_udf(shared):
    kind = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_prob", T.DoubleType())])

    @F.pandas_udf(kind)
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, theta = shared.value
        known = Known(lambda t: float(w[bucket(t)]))
        for texts in parts:
            known.trim()
            x = np.array([fsum(map(known.__getitem__, tokens(t))) for t in texts], np.float64)
            t = tails(x, theta)
            yield pd.DataFrame({"expected_grade": t.sum(1), "tail_prob": t[:, -1]})

    return rate


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The input rows whose tail probability reaches cut. All columns stay."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), rate_udf(shared)(F.col(text_col)).alias("_rated"))
    return row.where(F.col("_rated.tail_prob") >= cut).select(*(F.col("_row")[c].alias(c) for c in docs.columns))
