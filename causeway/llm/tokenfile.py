"""Token ids in ORC files: sorted by document, indexed, and read back.

One file a range of document ids; in it, integer run-length encoded ids, a row index every ROWS rows and a
Bloom filter on the document id, so that readers take stripes in parallel and skip by metadata.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from causeway.llm.common import Recent, shared_path, small_batches

END = 1
#: Bytes of text that make a file.
FILE_BYTES = 24 << 20
ROWS = 1_000
STRIPE_BYTES = 8 << 20
#: Words kept by a worker, the longest of them, and how many new ones are encoded in one text.
_CACHE, _LONGEST, _GROUP = 800_000, 64, 1_000
MARK, MARK_BYTE = "~", b"~"
_LOWER = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words that no step before the model changes or splits, small letters of Latin-1, and ASCII marks after them, which are a token of
#: their own; the apostrophe may make one with letters, and special tokens have "<|".
_ENDED = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=>?@[-`{}]*)")
#: Texts whose words are told apart at once.
_TEXTS = 512


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, as bytes of 32-bit numbers.

    A space or line end parts words in every step of the tokenizer, which lower-cases first, so words seen before
    aren't encoded again. New words are encoded many at a time: words of small letters, which normalising and
    splitting leave as they are, with the model alone, others with a mark between them that none of them holds.
    """

    def __init__(self, data: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(data)
        self.recent = Recent(_CACHE)
        mark = self.tok.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.last, self.model = self._model(data)

    @property
    def known(self) -> dict[bytes, bytes]:
        return self.recent.young

    def _model(self, data: str):
        """(which ids end a word, a tokenizer of the same model that only splits at spaces); None where ids don't tell, or letters may be split."""
        from tokenizers import Tokenizer

        made = json.loads(data)
        suffix, split = made["model"].get("end_of_word_suffix"), made.get("pre_tokenizer") or {}
        if not suffix or made["model"].get("dropout") or split.get("type") != "Sequence" or r"|[^\s\p{L}\p{N}]+" not in str(split).replace("\\\\", "\\") or any(x["type"] not in ("NFC", "Lowercase", "Replace") for x in (made.get("normalizer") or {}).get("normalizers", [])):
            return None, None
        level = [x for x in split["pretokenizers"] if x["type"] == "ByteLevel"]
        made |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *level]}}
        last = np.zeros(max(made["model"]["vocab"].values()) + 1, bool)
        last[[i for t, i in made["model"]["vocab"].items() if t.endswith(suffix)]] = True
        return last, Tokenizer.from_str(json.dumps(made))

    def _cut(self, text: str) -> list[bytes]:
        data = text.encode("utf-8", "replace")
        if b"<|" in data:  # may hold special tokens, whose case counts
            return data.replace(b"\n", b" ").split(b" ")
        return data.translate(_LOWER).split(b" ")

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        if self.model is not None:
            found = list(map(_ENDED.fullmatch, b"\n".join(words).decode("utf-8").split("\n"))) if words else []
            parts = [(w, m[1].encode(), m[2].encode()) for w, m in zip(words, found, strict=True) if m and m[2]]
            known, old = self.known, self.recent.old
            small = {m[1] for m in found if m and not m[2]}
            for stem in {stem for _, stem, _ in parts}.difference(known):
                if stem in old:
                    known[stem] = old[stem]
                else:
                    small.add(stem.decode("utf-8"))
            self._letters(list(small))
            self._plain(sorted({x for _, _, x in parts}.difference(known)))
            known.update((w, known[stem] + known[x]) for w, stem, x in parts if stem in known)
        self._plain([w for w in words if w not in self.known])

    def _plain(self, words: list[bytes]) -> None:
        plain = [w for w in words if self.mark is not None and MARK_BYTE not in w and b"<|" not in w]
        self._together(plain)
        rest = [w for w in words if w not in self.known]
        for start in range(0, len(rest), 4096):
            part = rest[start : start + 4096]
            self.known.update(zip(part, self._ids([w.decode("utf-8") for w in part]), strict=True))

    def _letters(self, words: list[str]) -> None:
        groups = [words[i : i + _GROUP] for i in range(0, len(words), _GROUP)]
        for start in range(0, len(groups), 16):
            some = groups[start : start + 16]
            for group, e in zip(some, self.model.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<i4")
                edges = np.flatnonzero(self.last[ids]) + 1
                if len(edges) == len(group) and edges[-1] == len(ids):
                    raw, ends = ids.tobytes(), (edges * 4).tolist()
                    self.known.update(zip((w.encode() for w in group), (raw[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True))

    def _together(self, words: list[bytes]) -> None:
        groups = [words[i : i + _GROUP] for i in range(0, len(words), _GROUP)]
        for start in range(0, len(groups), 16):
            some = groups[start : start + 16]
            texts = [f" {MARK} ".encode().join(g).decode("utf-8") for g in some]
            for group, e in zip(some, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<i4")
                edges = np.flatnonzero(ids == self.mark)
                if len(edges) == len(group) - 1:
                    raw, at = ids.tobytes(), [0, *((edges + 1) * 4).tolist()]
                    ends = [*(edges * 4).tolist(), len(raw)]
                    self.known.update(zip(group, (raw[i:j] for i, j in zip(at, ends, strict=True)), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        new = self.recent.missing(set().union(*cut))
        known = self.known
        self._learn(new)
        out = [b"".join(map(known.__getitem__, xs)) for xs in cut]
        for x in new:
            if len(x) > _LONGEST:
                known.pop(x, None)
        return out

    def column(self, texts: pa.Array, end: int) -> pa.Array:
        """Each text's ids with `end` after them, as lists. Words are told apart in Arrow; Python sees each one once a batch."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if texts.buffers()[2] else b""
        offsets = offsets - offsets[0]
        low = data.translate(_LOWER)
        if b"<|" in data:
            edges = offsets.tolist()
            low = b"".join(x.replace(b"\n", b" ") if b"<|" in (x := data[i:j]) else low[i:j] for i, j in zip(edges, edges[1:], strict=False))
        letters = np.frombuffer(low, np.uint8)
        space = letters == 32
        # a word ends at a space, or where its text ends, which comes before a space at the same place
        ends = np.sort(np.concatenate([2 * offsets[1:], 2 * np.flatnonzero(space) + 1]), kind="stable")
        last = np.flatnonzero(ends % 2 == 0)
        at = np.append(0, ends // 2 - (ends % 2).cumsum() + ends % 2).astype(np.int32)  # without the spaces
        coded = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(letters[~space])]).dictionary_encode()
        del data, low, letters, space, ends, at
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.recent.turn()
        known, old = self.known, self.recent.old
        found = list(map(known.get, words))
        places = [i for i, x in enumerate(found) if x is None]
        for i in places:
            if (x := old.get(words[i])) is not None:
                found[i] = known[words[i]] = x
        places = [i for i in places if found[i] is None]
        new = [words[i] for i in places]
        self._learn(new)
        for i in places:
            found[i] = known[words[i]]
        for x in new:
            if len(x) > _LONGEST:
                known.pop(x, None)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        of_word = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(np.append(0, lens.cumsum())), pa.py_buffer(b"".join(found))])
        ids = np.frombuffer(of_word.take(coded.indices).buffers()[2] or b"", "<i4")
        sizes = (lens // 4)[coded.indices.to_numpy()].cumsum()[last]
        return pa.ListArray.from_arrays(pa.array(np.append(0, sizes + np.arange(1, len(last) + 1)).astype(np.int32)), pa.array(np.insert(ids[: sizes[-1]] if len(last) else ids, sizes, end).astype(np.int32)))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(data: str) -> WordEncoder:
    """One encoder a worker: later tasks go on with the words it knows."""
    if data not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[data] = WordEncoder(data)
    return _ENCODERS[data]


def write(docs: DataFrame, path: str, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END, file_bytes: int = FILE_BYTES) -> None:
    """Write part, doc_id, first (ids of the file before this document), n_tokens, ids as ORC files in ascending document order.

    Null texts count as empty and have the end id only. Null ids come first; documents with one id are
    ordered by their texts. The folder must not exist.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path or default_path(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    files = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // file_bytes))

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, first, number = encoder_of(shared.value), 0, TaskContext.get().partitionId()
        for part in parts:
            for at in range(0, part.num_rows, _TEXTS):
                some = part.slice(at, _TEXTS)
                ids = encoder.column(some["text"], end)
                before = ids.offsets.to_numpy().astype(np.int64)
                columns = [pa.array(np.full(some.num_rows, number, np.int32)), some["doc_id"], pa.array(first + before[:-1]), pa.array(np.diff(before)), ids]
                first += int(before[-1])
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "first", "n_tokens", "ids"])
                pa.default_memory_pool().release_unused()

    laid = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text").select(F.col("doc_id").cast("string"), "text")
    out = laid.mapInArrow(encode, "part int, doc_id string, first long, n_tokens long, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))
    settings = {"orc.bloom.filter.columns": "doc_id", "orc.create.index": "true", "orc.row.index.stride": str(ROWS), "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd"}
    out.write.options(**settings).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids from the files."""
    schema = "part int, doc_id long, first long, n_tokens long, ids array<int>"
    rows = spark.read.schema(schema).orc(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


@F.pandas_udf(T.LongType())
def crc32_udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for ids in parts:
        yield pd.Series([zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in ids], dtype="int64")


def digest(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each input row, from files written and read back; see write()."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, path, **kw)
    rows = read(docs.sparkSession, path)
    return rows.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), crc32_udf("ids").alias("ids_crc32"))
