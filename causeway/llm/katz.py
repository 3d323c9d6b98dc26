"""Katz backoff language model.

n-grams of order k: P(w | c) = d_r r / C(c) if the n-gram was seen r times in training, else alpha(c) P(w | c
without its first word); alpha(c) shares out exactly what the discounts leave. d_r are Good-Turing discounts
for r up to GT; a context without discounted n-grams keeps one count for what wasn't seen. Unknown words share
one place below the unigrams.

Documents are cut into blocks of tokens, which stay where they are. Order by order, a block asks for its distinct
n-grams, with its own counts; tables partitioned by n-gram hash add up what all blocks bring and answer each
block in its order. An n-gram isn't asked for if no other block has its context, or its last words: its counts
are known then. Contexts are asked for what their n-grams leave, by blocks that have an unseen n-gram of theirs;
by others, if it isn't certain, only for whether anything is left. Only contexts that occur in held-out text, or
may have no discounted n-gram, get anything. No key meets more than one row a block, however frequent it is, and
no vocabulary is held anywhere as a whole.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import Scratch, small_batches

ORDER = 3
#: Counts up to this are discounted.
GT = 5
BLOCK_TOKENS = 5 << 17
#: Tokens of the input for each partition of a table.
PART_TOKENS = 1 << 20
FOLDS, HELD_OUT = 7, 2
#: Sums of probabilities travel as whole multiples of 2 ** -UNIT.
UNIT = 48
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Key of what no word can be: it has a blank.
END = xxhash.xxh64_intdigest(b" end", 0)
#: Keys of the contexts of first words, by order.
START = [np.uint64(xxhash.xxh64_intdigest(b" start %d" % k, 0)) for k in range(64)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a batch sent to Python: a few blocks, or many questions.
BATCH_BYTES = 1 << 20
#: Of gaps between keys, counts, floating numbers and sums of UNIT, so many low bytes of each stand together; the rest, mostly zeros,
#: stands in a column of its own.
GAP, COUNT, FLOAT, SUM = 6, 1, 8, UNIT // 8
#: What is asked of a context: nothing, whether something is left, or how much as well.
NOTHING, WHETHER, SHARE = range(3)
_ASK = "at int, kind int, part int, block long, keys binary, keys_up binary, a binary, a_up binary, b binary, b_up binary, asked binary"
_ANSWER = "block long, kind int, part int, a binary, a_up binary, b binary, b_up binary, first binary, stats array<double>"
_TOLD = "array<struct<kind int, size int, a binary, b binary, first binary, stats array<double>>>"


def _pack(a: np.ndarray) -> bytes:
    """Bytes of a's numbers, byte plane after byte plane, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes()) if len(a) else b""


def _unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their contexts and last words."""
    x = (context ^ (context >> np.uint64(31))) * _MIX + word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Blocks of documents: distinct words' keys in rising order, and each document's words as numbers among them, the end last."""
    task, made = TaskContext.get().partitionId(), 0

    def block() -> pd.DataFrame:
        keys = np.array([END if w is None else xxhash.xxh64_intdigest(w, 0) for w in numbers], np.uint64)
        order = np.argsort(keys)
        place = np.empty(len(keys), np.uint32)
        place[order] = np.arange(len(keys), dtype=np.uint32)
        row = {"block": (task << 32) + made, "ids": ids, "held": held, "lens": [len(t) for t in toks], "keys": _gaps(keys[order]), "toks": _pack(place[np.concatenate(toks)]), "n": sum(map(len, toks))}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    numbers, ids, held, toks, n = _Numbers(), [], [], [], 0
    for b in batches:
        for i, h, t in zip(b["id"], b["held"], b["text"], strict=True):
            words = t.encode("utf-8", "replace").translate(_LOWER).split() if t else []
            words.append(None)
            toks.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            ids.append(i)
            held.append(bool(h))
            n += len(words)
            if n >= size:
                yield block()
                made += 1
                numbers, ids, held, toks, n = _Numbers(), [], [], [], 0
    if ids:
        yield block()


def _gaps(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _from_gaps(data: bytes) -> np.ndarray:
    return _unpack(data, np.uint64).cumsum(dtype=np.uint64)


def _bits(x: np.ndarray) -> bytes:
    return _pack(np.packbits(x))


def _from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(_unpack(data, np.uint8))[:n].astype(bool)


def _least(parts: int) -> np.ndarray:
    """The least key of each partition."""
    n = np.uint64(parts)
    return ((np.arange(parts, dtype=np.uint64) << np.uint64(32)) + n - np.uint64(1)) // n << np.uint64(32)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's keys begin among sorted ones, and their number at the end."""
    return np.append(np.searchsorted(keys, _least(parts)), len(keys))


def _size(*numbers: np.ndarray) -> int:
    """Bytes that hold each of the whole numbers."""
    return max([1, *((int(x.max()).bit_length() + 7) // 8 for x in numbers if len(x))])


def _pieces(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column from the bytes of all rows and where they part, from 0 on."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes, and each row's number of them."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8), np.diff(ends).astype(np.int64)


def _split(numbers: np.ndarray, low: int, ends: np.ndarray) -> list[pa.Array]:
    """Numbers of 64 bits as two columns: each row's `low` low bytes of them, and their other bytes as far as any isn't zero."""
    planes = numbers.view(np.uint8).reshape(-1, 8)
    up = max(0, _size(numbers) - low) if low < 8 else 0
    return [_pieces(np.ascontiguousarray(planes[:, i:j]).ravel(), ends * (j - i)) for i, j in ((0, low), (low, low + up))]


def _joined(rows: pa.Table, column: str, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of such columns, and how many a row has."""
    data, lens = _bytes(_column(rows, column))
    n = lens // low
    out = np.zeros((int(n.sum()), 8), np.uint8)
    out[:, :low] = data.reshape(-1, low)
    data, lens = _bytes(_column(rows, column + "_up"))
    size = lens // np.maximum(n, 1)
    for w in np.unique(size[size > 0]).tolist():
        out[np.repeat(size == w, n), low : low + w] = data[np.repeat(size == w, lens)].reshape(-1, w)
    return out.view(np.uint64).ravel(), n


def _column(rows: pa.Table, name: str) -> pa.Array:
    return rows[name].combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(name).type)


def _asks(block: int, kind: int, first: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray, asked: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each partition that has some of the sorted keys. All rows are cut from the same buffers: a row costs next to nothing."""
    cut = _cuts(keys, parts)
    full = np.flatnonzero(np.diff(cut))
    ends = np.append(cut[full], len(keys))
    gaps = np.diff(keys, prepend=np.uint64(0))
    gaps[ends[:-1]] = keys[ends[:-1]] - _least(parts)[full]
    low, same = (COUNT, COUNT) if kind > 0 else (FLOAT, SUM), lambda x: pa.array(np.full(len(full), x, np.int32))
    columns = [pa.array((first + full).astype(np.int32)), same(kind), pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block, np.int64)), *_split(gaps, GAP, ends)]
    columns += [x for c, k in zip((a, b), low, strict=True) for x in _split(c.view(np.uint64), k, ends)]
    return pa.RecordBatch.from_arrays([*columns, _pieces(asked.view(np.uint8), ends if len(asked) else ends * 0)], _names(_ASK))


def _told(at: int, kind: int, part: int, block: int, stats: list[float]) -> pa.RecordBatch:
    """A row without keys: statistics, to be added up."""
    numbers = [pa.array([x], pa.int32()) for x in (at, kind, part)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (b"", b"", np.array(stats).tobytes(), b"", b"", b"", b""))], _names(_ASK))


def _answered(rows: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    """One partition's answers.

    Of n-grams (kind > 0): their counts in training and in held-out documents over all blocks, and which block is
    the first that asked; besides, a row of statistics. Of contexts (kind < 0), to those who ask: whether their
    n-grams leave something, and, if asked for, what they leave over 1 - the lower orders' probabilities of them
    (or 1 over that, if nothing is left).
    """
    kind, part = rows["kind"][0].as_py(), rows["part"][0].as_py()
    rows = rows.sort_by("block").combine_chunks()
    empty = _bytes(_column(rows, "keys"))[1] == 0
    told = [np.frombuffer(x, np.float64) for x in rows.filter(pa.array(empty))["a"].to_pylist()]
    rows = rows.filter(pa.array(~empty))
    block = _column(rows, "block")
    gaps, n = _joined(rows, "keys", GAP)
    ends = np.append(0, n.cumsum())
    keys = gaps.cumsum(dtype=np.uint64)
    keys += np.repeat(_least(parts)[part] - keys[ends[:-1]] + gaps[ends[:-1]], n)
    order = np.argsort(keys)
    new = np.append(True, np.diff(keys[order]) > 0)[: len(keys)]
    at = np.empty(len(keys), np.int64)
    at[order] = new.cumsum() - 1
    a, b = (_joined(rows, c, k)[0] for c, k in zip("ab", (COUNT, COUNT) if kind > 0 else (FLOAT, SUM), strict=True))
    same = lambda k, x: pa.array(np.full(k, x, np.int32))
    head = [block, same(len(block), kind), same(len(block), part)]
    none = pa.nulls(len(block), pa.list_(pa.float64()))
    if kind > 0:
        a, b = (np.bincount(at, x, minlength=int(new.sum())).astype(np.uint64) for x in (a, b))
        first = np.zeros(len(at), np.uint8)
        if len(at):
            first[np.minimum.reduceat(order, np.flatnonzero(new))] = 1
        yield pa.RecordBatch.from_arrays([*head, *_split(a[at], COUNT, ends), *_split(b[at], COUNT, ends), _pieces(first, ends), none], _names(_ANSWER))
        stats = [float(x) for x in np.sum([_statistics(a), *told], axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), same(1, kind), same(1, part), *[pa.array([b""], pa.binary())] * 5, pa.array([stats], pa.list_(pa.float64()))], _names(_ANSWER))
    else:
        left = np.bincount(at, a.view(np.float64), minlength=int(new.sum()))
        lower = np.bincount(at, b.astype(np.float64), minlength=len(left)) / (1 << UNIT)
        share = np.where(left > 0, left, 1.0) / np.maximum(1 - lower, 1e-300)
        asked = _bytes(_column(rows, "asked"))[0]
        wide, some = asked == SHARE, asked > NOTHING
        to = lambda mask: np.append(0, mask.cumsum())[ends]
        empty = _pieces(np.empty(0, np.uint8), ends * 0)
        yield pa.RecordBatch.from_arrays([*head, _pieces(share[at[wide]].view(np.uint8), to(wide) * 8), empty, empty, empty, _pieces((left[at[some]] > 0).view(np.uint8), to(some)), none], _names(_ANSWER))


def _gathered(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Answers in the order of blocks, kinds and partitions -> a row a block, with one answer of each kind."""

    def packed(rows: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(rows)
        kind = t["kind"][0].as_py()
        a, b = (_joined(t, c, COUNT if kind > 0 else FLOAT)[0] for c in "ab")
        size = _size(a, b)
        numbers = {k: _pack(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :size])) for k, x in (("a", a), ("b", b))}
        stats = [x for x in t["stats"].to_pylist() if x is not None]
        return {"kind": kind, "size": size, **numbers, "first": _bits(_bytes(_column(t, "first"))[0]), "stats": [float(x) for x in np.sum(stats, axis=0)] if stats else None}

    def row(block: int, found: list[dict]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("size", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("first", pa.binary()), ("stats", pa.list_(pa.float64()))]))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([found], kind)], ["block", name])

    last, rows, found = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        block, kind = batch["block"].to_numpy(), batch["kind"].to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:], strict=False):
            now = (int(block[i]), int(kind[i]))
            if last is not None and now != last:
                found.append(packed(rows))
                rows = []
                if now[0] != last[0]:
                    yield row(last[0], found)
                    found = []
            last = now
            rows.append(batch.slice(i, j - i))
    if last is not None:
        yield row(last[0], [*found, packed(rows)])


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, whose lists of numbers are arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: x[i].values.to_numpy(zero_copy_only=False) if c in ("held", "lens") else x[i].as_py() for c, x in zip(batch.schema.names, batch.columns, strict=True)}


def _statistics(r: np.ndarray) -> list[float]:
    """Tokens, distinct n-grams, and how many were seen 1, 2, ... GT + 1 times."""
    return [float(r.sum()), float((r > 0).sum()), *(float((r == k).sum()) for k in range(1, GT + 2))]


def discounts(of_count: list[float]) -> np.ndarray:
    """d_0 .. d_GT from the numbers of n-grams seen 1, 2, ... GT + 1 times: Katz's Good-Turing discounts.

    Where the counts of counts don't allow one (a zero, or a value outside (0, 1]), 1 - D / r with D = n1 / (n1 +
    2 n2) stands in for all of them.
    """
    n = [0.0, *of_count]
    d = np.ones(GT + 1)
    with np.errstate(all="ignore"):
        common = (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
        for r in range(1, GT + 1):
            star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
            d[r] = (star / r - common) / (1 - common) if common != 1 else 0.0
    if not ((d > 0) & (d <= 1)).all():
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = np.array([1.0, *(1 - cut / r for r in range(1, GT + 1))])
    return d


def _mass(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d_r r; 0 for what wasn't seen."""
    r = np.asarray(r, np.float64)
    return np.where(r <= GT, d[np.minimum(r, GT).astype(np.int64)], 1.0) * r


class Unigrams:
    """P(w) = d_c c / N for known words; the rest of the mass is the unknown word's."""

    def __init__(self, total: float, discounted: float, d: np.ndarray):
        self.d = d
        self.whole = total if discounted < total or not total else total + 1
        self.unknown = 1 - discounted / self.whole if self.whole else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _mass(c, self.d) / (self.whole or 1.0), self.unknown)


class Block:
    """A block's n-grams with what is known of them so far.

    Of each order: keys (distinct, in order) and at (which of them each token ends); after its answers, count (in
    training) and other (in held-out documents) over all blocks, and first (whether this block speaks for it).
    """

    def __init__(self, row: dict, parts: int):
        self.number, self.parts = int(row["block"]), parts
        word, tok = _from_gaps(row["keys"]), _unpack(row["toks"], np.uint32).astype(np.int32)
        self.lens = np.asarray(row["lens"], np.int64)
        self.held = np.repeat(np.asarray(row["held"], bool), self.lens)
        self.starts = self.lens.cumsum() - self.lens
        self.word, self.keys, self.at = word[tok], [word], [tok]
        self.count: list[np.ndarray] = []
        self.other: list[np.ndarray] = []
        self.first: list[np.ndarray] = []

    @property
    def order(self) -> int:
        return len(self.keys)

    def before(self, of_token: np.ndarray, start) -> np.ndarray:
        """What the token before each one has; `start` for a document's first."""
        out = np.empty_like(of_token)
        out[1:] = of_token[:-1]
        out[self.starts] = start
        return out

    def longer(self) -> None:
        """n-grams of the next order."""
        gram = _mixed(self.before(self.keys[-1][self.at[-1]], START[self.order]), self.word)
        keys, at = np.unique(gram, return_inverse=True)
        self.keys.append(keys)
        self.at.append(at.astype(np.int32))

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """This block's counts of the n-grams of the highest order, in training and in held-out documents."""
        at, n = self.at[-1], len(self.keys[-1])
        return np.bincount(at[~self.held], minlength=n), np.bincount(at[self.held], minlength=n)

    def shared(self) -> np.ndarray:
        """Of the highest order, which n-grams another block may have too: their contexts and their last words both occur elsewhere."""
        n = len(self.keys[-1])
        if self.order == 1:
            return np.ones(n, bool)
        mine = np.bincount(self.at[-2], minlength=len(self.keys[-2]))
        elsewhere = (self.count[-1] + self.other[-1] > mine)[self.at[-2]]
        out = np.zeros(n, bool)
        out[self.at[-1]] = elsewhere & self.before(elsewhere, True)
        return out

    def learn(self, answer: dict | None) -> None:
        """Counts of the highest order from the answer."""
        asked = self.shared()
        self.count.append((own := self.own())[0])
        self.other.append(own[1])
        self.first.append(~asked)
        for name, c in (("count", "a"), ("other", "b")):
            got = _unpacked(answer, c)
            if len(got) != asked.sum():
                raise ValueError(f"{len(got)} answers to {asked.sum()} questions")
            all_of = getattr(self, name)
            all_of[-1][asked] = got
            if len(all_of[-1]) and all_of[-1].max() < 1 << 31:
                all_of[-1] = all_of[-1].astype(np.int32)
        self.first[-1][asked] = _from_bits(answer["first"], int(asked.sum())) if answer else False

    @property
    def documents(self) -> int:
        """Training documents: so often their ends were counted."""
        return int(self.count[0][np.searchsorted(self.keys[0], np.uint64(END))])

    def contexts(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of order `level`: the contexts' keys in order, which one each token has, how often it was seen, and whether it occurs in held-out documents."""
        keys, n = self.keys[level - 2], len(self.keys[level - 2])
        place = int(np.searchsorted(keys, START[level - 1]))
        keys = np.insert(keys, place, START[level - 1])
        at = self.before(self.at[level - 2], n)
        at = np.where(at == n, place, at + (at >= place)).astype(np.int32)
        return keys, at, np.insert(self.count[level - 2], place, self.documents), np.insert(self.other[level - 2] > 0, place, True)

    def gives(self, level: int, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, what is left, lower-order probabilities, asked) for the contexts of an order that this block brings something to, or asks for."""
        keys, at, seen, outside = self.contexts(level)
        r = self.count[level - 1]
        one = np.zeros(len(r), np.int64)  # one token of each n-gram stands for it
        one[self.at[level - 1]] = np.arange(len(self.at[level - 1]))
        wanted = outside | (seen > self.sure(d))
        mine = self.first[level - 1] & (r > 0) & wanted[at[one]]
        where, r_mine = at[one[mine]], r[mine]
        left = np.bincount(where, r_mine - _mass(r_mine, d), minlength=len(keys))
        units = np.bincount(where, np.rint(lower[one[mine]] * (1 << UNIT)), minlength=len(keys)).astype(np.uint64)  # at most 2 ** UNIT: exact
        brings = np.bincount(where, minlength=len(keys)) > 0
        asked = self.asks(level, at, seen, d)
        some = brings | (asked > NOTHING)
        return keys[some], left[some], units[some], asked[some]

    @staticmethod
    def sure(d: np.ndarray) -> int:
        """A context seen so often at most has a discounted n-gram for sure."""
        return GT if (d[1:] < 1).all() else 0

    def asks(self, level: int, at: np.ndarray, seen: np.ndarray, d: np.ndarray) -> np.ndarray:
        """What this block asks of each context: its share for an n-gram that training hasn't seen, else at most whether something is left."""
        r = self.count[level - 1][self.at[level - 1]]
        out = np.full(len(seen), NOTHING, np.uint8)
        out[at[seen[at] > self.sure(d)]] = WHETHER
        out[at[r == 0]] = SHARE
        out[seen == 0] = NOTHING
        return out

    def above(self, level: int, lower: np.ndarray, d: np.ndarray, answer: dict | None) -> np.ndarray:
        """Each token's probability at an order from that below and the answer about its contexts."""
        keys, at, seen, _ = self.contexts(level)
        asked = self.asks(level, at, seen, d)
        place, wide = np.flatnonzero(asked), np.flatnonzero(asked == SHARE)
        got = _unpacked(answer, "a").view(np.float64)
        if len(got) != len(wide) or (len(place) and not answer):
            raise ValueError(f"{len(got)} answers to {len(wide)} questions of {len(place)}")
        share, some = np.ones(len(seen)), np.ones(len(seen), bool)
        share[wide], some[place] = got, _from_bits(answer["first"], len(place)) if answer else False
        r, n = self.count[level - 1][self.at[level - 1]], seen[at]
        whole = np.maximum(n + ~some[at], 1).astype(np.float64)
        return np.where(r > 0, _mass(r, d) / whole, np.where(n > 0, share[at] / whole, 1.0) * lower)


def _unpacked(answer: dict | None, column: str) -> np.ndarray:
    """An answer's numbers, as 64 bits each."""
    if not answer or not answer[column]:
        return np.empty(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(answer[column]), np.uint8).reshape(answer["size"], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.int64).ravel()


def _known(row: dict, level: int, parts: int) -> tuple[Block, dict[int, dict]]:
    """A block with the counts of its n-grams up to `level`, and the answers by kind."""
    given = {a["kind"]: a for c in row if c.startswith("answers") and row[c] is not None for a in row[c]}
    block = Block(row, parts)
    for k in range(1, level + 1):
        if k > 1:
            block.longer()
        block.learn(given.get(k))
    return block, given


def _rid(spark: SparkSession) -> None:
    """Lets Spark's cleaner see that the exchanges so far have ended: their files go when the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Unigrams:
    """P(w) = d_c c / N for known words; the rest of the mass is the unknown word's."""

    def __init__(self, stats: list[float], d: np.ndarray):
        total, _, *of_count = stats
        discounted = total - sum((1 - d[r]) * r * of_count[r - 1] for r in range(1, GT + 1))
        self.d = d
        self.whole = total if discounted < total or not total else total + 1
        self.unknown = 1 - discounted / self.whole if self.whole else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _mass(c, self.d) / (self.whole or 1.0), self.unknown)


class Tables:
    """The blocks and what they were answered, in tables bucketed by block: only questions and answers move."""

    def __init__(self, spark: SparkSession, label: str, buckets: int, parts: int):
        self.spark, self.label, self.buckets, self.parts, self.names = spark, label, buckets, parts, []

    def blocks(self) -> DataFrame:
        out = self.spark.table(self.label)
        for name in self.names:
            out = out.join(self.spark.table(name), "block", "left")
        return out

    def exchange(self, ask, kinds: int) -> None:
        """Every block's questions, and their answers in one more table. ask: a block's row -> frames of questions."""
        spark, parts = self.spark, self.parts
        asks = self.blocks().drop("ids").mapInArrow(lambda batches: (f for row in _rows(batches) for f in ask(row) if f.num_rows), _ASK)
        laid = asks.repartitionById(max(1, kinds * parts), F.col("at")).drop("at")

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [b for b in batches if b.num_rows]
            if rows:
                t = pa.Table.from_batches(rows)
                for k in np.unique(t["kind"].to_numpy()).tolist():
                    yield from _answered(t.filter(pa.compute.equal(t["kind"], k)), parts)

        name, told = f"{self.label}_{len(self.names)}", f"answers{len(self.names)}"
        out = laid.mapInArrow(answer, _ANSWER).repartition(self.buckets, "block").sortWithinPartitions("block", "kind", "part")
        out.mapInArrow(lambda batches: _gathered(batches, told), f"block long, {told} {_TOLD}").write.bucketBy(self.buckets, "block").saveAsTable(name)
        self.names.append(name)
        del asks, laid, out
        _rid(spark)

    def statistics(self, level: int) -> list[float]:
        """Sums over the partitions of an order."""
        i = len(self.names) - 1
        rows = self.spark.table(self.names[i]).where("block = -1").select(F.explode(f"answers{i}").alias("a")).where(F.col("a.kind") == level)
        got = rows.agg(*(F.sum(F.col("a.stats")[k]).alias(f"s{k}") for k in range(GT + 3))).first()
        return [float(got[f"s{k}"] or 0.0) for k in range(GT + 3)]

    def drop(self) -> None:
        for name in [*self.names, self.label]:
            self.spark.sql(f"drop table if exists {name}")


def _probabilities(block: Block, given: dict[int, dict], level: int, uni: Unigrams, d: tuple) -> np.ndarray:
    p = uni(block.count[0][block.at[0]])
    for k in range(2, level + 1):
        p = block.above(k, p, d[k - 1], given.get(-k))
    return p


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """A row for each input row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(id as text) leaves HELD_OUT when divided by FOLDS are held out; the rest, and rows
    without id, are learned from. Null texts count as empty: their only token is the end. Without training
    tokens every probability is that of the unknown word, 1. Repeated rows are learned from each time; an empty
    table gives an empty one. Other columns aren't read.
    """
    spark = docs.sparkSession
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(most)
    small_batches(spark)
    scratch = Scratch(spark, "katz")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    kind = "block long, ids array<string>, held array<boolean>, lens array<int>, keys binary, toks binary, n long"
    label = f"causeway_blocks_{scratch.root[-32:]}"
    tables = Tables(spark, label, int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    try:
        # with fewer buckets than a shuffle has partitions, the planner would shuffle the blocks as well
        rows.mapInPandas(lambda batches: _blocks(batches, block_tokens), kind).write.bucketBy(tables.buckets, "block").saveAsTable(label)
        tables.parts = parts = max(1, -(-(spark.table(label).agg(F.sum("n")).first()[0] or 0) // part_tokens))
        spark.conf.set(most, str(BATCH_BYTES))
        d: list[np.ndarray] = []
        stats: list[list[float]] = []

        def questions(level: int, of_level: int):
            """What a block asks: about n-grams of `level` (0: none) and contexts of `of_level` (0: none)."""
            ways, uni = tuple(d), Unigrams(stats[0], d[0]) if d else None

            def ask(row: dict) -> Iterator[pa.RecordBatch]:
                block, given = _known(row, level - 1 if level else of_level, parts)
                if of_level:
                    keys, left, units, asked = block.gives(of_level, _probabilities(block, given, of_level - 1, uni, ways), ways[of_level - 1])
                    yield _asks(block.number, -of_level, parts if level else 0, keys, left, units, asked, parts)
                if level:
                    if level > 1:
                        block.longer()
                    want = block.shared()
                    a, b = block.own()
                    one = block.number % parts
                    yield _told(one, level, one, block.number, _statistics(a[~want]))  # what nobody is asked about
                    if level == order:
                        b[:] = 0  # no longer n-gram has one of these as its context
                    yield _asks(block.number, level, 0, block.keys[-1][want], a[want], b[want], np.zeros(0, bool), parts)

            return ask

        for level in range(1, order + 1):
            tables.exchange(questions(level, level - 1 if level > 2 else 0), 2 if level > 2 else 1)
            stats.append(tables.statistics(level))
            d.append(discounts(stats[-1][2:]))
        if order > 1:
            tables.exchange(questions(0, order), 1)
        ways, uni, (total, known) = tuple(d), Unigrams(stats[0], d[0]), stats[0][:2]

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                block, given = _known(row, order, parts)
                n = len(block.lens)
                doc = np.repeat(np.arange(n, dtype=np.int32), block.lens)
                c = block.count[0][block.at[0]]
                base = np.bincount(doc, np.log10((c + 1) / (total + known + 1)), minlength=n)
                p = _probabilities(block, given, order, uni, ways)
                numbers = {"n_tokens": block.lens, "n_known": np.bincount(doc, c > 0, minlength=n).astype(np.int64), "train_tokens": np.full(n, int(total)), "base_score": base, "score": np.bincount(doc, np.log10(p), minlength=n)}
                yield pa.RecordBatch.from_pydict({"id": pa.array(row["ids"], pa.string()), "held_out": np.asarray(row["held"], bool), **numbers})

        out = scratch.write(tables.blocks().mapInArrow(rate, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    finally:
        spark.conf.set(most, before)
        tables.drop()
    return out.select(F.col("id").cast("long").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
