"""SentencePiece models on the tokenizers library.

The model's protobuf is read here field by field; normaliser, metaspace marker, scores (or the merges they
imply) and byte fallback are rebuilt as a tokenizers.Tokenizer. Texts are cut before each run of markers: no
piece has a marker after another character, so nothing is ever merged across such a place. Pieces of text seen
before aren't encoded again; each new one is checked against the sentencepiece library.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.common import Recent, small_batches

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
_RUN = re.compile(f"{MARK}+[^{MARK}]*")
#: Words kept by a worker, the longest of them, and how many new ones are encoded in one text.
_CACHE, _LONGEST, _GROUP = 250_000, 64, 1_000
#: Threads of a worker's batches.
THREADS = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    unk: int = 0


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        wire = key & 7
        if wire == 0:
            value, i = _varint(data, i)
        else:
            n = 8 if wire == 1 else 4
            if wire == 2:
                n, i = _varint(data, i)
            elif wire not in (1, 5):
                raise ValueError(f"wire type {wire} in a model file")
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            kind = piece.get(3, NORMAL)
            if kind == UNKNOWN:
                m.unk = len(m.pieces)
            m.pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece.get(2, bytes(4)))[0], kind))
        elif number == 2:
            trainer = dict(_fields(value))
            m.kind, m.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            norm = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """The merges that pieces and scores imply, the best first.

    Of pieces with one score, the library extends the leftmost match: as it has grown longest, longer left
    parts come first.
    """
    known = {p: (s, i) for i, (p, s, k) in enumerate(m.pieces) if k in (NORMAL, USER)}
    found = []
    for p, (s, i) in known.items():
        for cut in range(1, len(p)):
            left, right = p[:cut], p[cut:]
            if left in known and right in known:
                found.append((-s, -cut if not p.strip(MARK) else 0, i, known[left][1], known[right][1], left, right))
    return [(x[-2], x[-1]) for x in sorted(found)]


def build(m: Model):
    """The tokenizers.Tokenizer of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.kind == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk, m.byte_fallback))
    else:
        tok = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence(parts + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return tok


class Encoder:
    """Encodes and decodes batches of texts."""

    def __init__(self, data: bytes, check: bool = True):
        self.model = parse(data)
        self.tok = build(self.model)
        self.recent = Recent(_CACHE)
        self.odd: set[str] = set()  # of those, what the library encodes otherwise
        self.first = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        # pieces of text may stand alone only if nothing is normalised or merged across a marker
        self.cuts = self.model.dummy_prefix and self.model.escape and not self.model.squeeze and not self.model.charsmap
        self.cuts = self.cuts and self.model.kind == BPE and not any(MARK in p.lstrip(MARK) for p, _, k in self.model.pieces if k in (NORMAL, USER))
        self.cuts = self.cuts and self.tok.token_to_id(MARK) is not None
        # a step more where a text holds many words, which never go together
        from tokenizers import pre_tokenizers

        self.apart = pre_tokenizers.Split(MARK, "merged_with_next")
        self.spm = None
        if check:
            import sentencepiece

            self.spm = sentencepiece.SentencePieceProcessor(model_proto=data)

    @property
    def known(self) -> dict[str, bytes]:
        return self.recent.young

    def _cut(self, text: str) -> list[str]:
        """The text's pieces, each without its first marker."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:].replace(MARK, " ") for x in _RUN.findall(MARK + text.replace(" ", MARK))]

    def _alone(self, words: list[str]) -> None:
        """Encodes and checks each word for itself."""
        for start in range(0, len(words), 4096):
            part = words[start : start + 4096]
            ids = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            for x, i, j in zip(part, ids, self.spm.encode(part) if self.spm else ids, strict=True):
                self.known[x] = np.array(i, "<i4").tobytes()
                if i != j:
                    self.odd.add(x)

    def _learn(self, words: list[str]) -> None:
        """Encodes and checks new words, plain ones many in a text: only a word's first id has a marker."""
        plain = [x for x in words if x and " " not in x and MARK not in x] if self.cuts else []
        groups = [plain[i : i + _GROUP] for i in range(0, len(plain), _GROUP)]
        if groups:
            self.tok.pre_tokenizer = self.apart
        for start in range(0, len(groups), 16):
            texts = [" ".join(g) for g in groups[start : start + 16]]
            ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            for group, i, j in zip(groups[start : start + 16], ids, self.spm.encode(texts) if self.spm else ids, strict=True):
                a = np.array(i, "<i4")
                at = (np.flatnonzero(self.first[a]) * 4).tolist()
                if i == j and len(at) == len(group):
                    raw = a.tobytes()
                    self.known.update(zip(group, (raw[x:y] for x, y in zip(at, [*at[1:], len(raw)], strict=True)), strict=True))
        if groups:
            self.tok.pre_tokenizer = None
        self._alone([x for x in words if x not in self.known])

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """(ids, whether the sentencepiece library gives the same) of each text; null counts as empty."""
        cut = [self._cut(t or "") for t in texts]
        new = self.recent.missing(set().union(*cut))
        known, odd = self.known, self.odd
        if self.cuts:
            known[""] = np.array([self.tok.token_to_id(MARK)], "<i4").tobytes()  # a marker at the very end
        self._learn([x for x in new if x not in known])
        out = [np.frombuffer(b"".join(map(known.__getitem__, xs)), "<i4") for xs in cut]
        parity = [not odd or odd.isdisjoint(xs) for xs in cut]
        for x in new:
            if len(x) > _LONGEST:
                del known[x]
                odd.discard(x)
        return out, parity

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


_ENCODERS: dict[tuple[bytes, bool], Encoder] = {}


def encoder_of(data: bytes, check: bool) -> Encoder:
    """One encoder a worker: later tasks go on with the words it knows."""
    if (data, check) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[data, check] = Encoder(data, check)
    return _ENCODERS[data, check]


def tokenize(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """A row for each input row: id_col, ids, n_tokens, round_trip (decoding gives the text back), parity.

    Null texts count as empty; an empty text has no ids. A marker character in a text comes back as a space, and
    the text counts as given back. Repeated rows stay. Other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path or default_path(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())])

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        encoder = encoder_of(shared.value, check)
        for texts in parts:
            given = [t or "" for t in texts]
            ids, parity = encoder.encode(given)
            back = [a == b.replace(MARK, " ") for a, b in zip(encoder.decode(ids), given, strict=True)]
            yield pd.DataFrame({"ids": ids, "round_trip": back, "parity": parity})

    rows = docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("r"))
    return rows.select(F.col("id").alias(id_col), "r.ids", F.size("r.ids").cast("long").alias("n_tokens"), "r.round_trip", "r.parity")
