"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The model file is read with a small reader of its own; the library is not needed at run time. Supported are BPE models
with the identity normaliser (dummy prefix or not, white space kept), byte fallback and no user-defined symbols; for
any other the reader raises.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import fresh, holds, lean, rows_by_bytes
from veilspark.llm.merge_rounds import MergeTable, WordCache, merge, spell, strings

SLICE_BYTES = 2 << 20
CACHE_WORDS = 120_000
MARK = "▁"  # stands for a space
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if b[i - 1] < 128:
                return value, i

    i = 0
    while i < len(b):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if tag & 7 == 2 else ({5: 4, 1: 8}[tag & 7], i)
            value, i = b[i : i + size], i + size
        yield tag >> 3, value


class PieceBpe:
    """Encoder and decoder of one model. The cache of encoded words is emptied when it is full."""

    def __init__(self, model: bytes, decimal: bool = False):
        """``decimal``: encoded() spells ids as decimal numbers, each followed by a space; else as four bytes each."""
        pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                d = dict(_fields(value))
                pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                kinds.append(d.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not trainer.get(35) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("not a BPE model with identity normaliser, kept white space and byte fallback")
        self.prefix = bool(normalizer.get(3, 1))
        self.pieces, kinds = pieces, np.array(kinds)
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        self.end = next(i for i, p in enumerate(pieces) if kinds[i] == CONTROL and p == "</s>")
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_ids[int(pieces[i][1:-1], 16)] = i
        ranked = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        left, right, rank, made = [], [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(ranked[scores[i]]), made.append(i)
        self.table = MergeTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int64), np.array(made, np.int64), len(pieces), np.array(list(map(len, pieces))))
        self.letter = np.full(0x110000, -1, np.int32)  # by code point
        for p, i in self.ids.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        # No merge crosses from another letter to the mark, nor a line end, unless a piece does.
        crosses = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        lines = any("\n" in p and len(p) > 1 for p in self.ids)
        self.words = (lambda t: [t]) if crosses else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if lines else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        # What a piece becomes when it is decoded; bytes are joined before they are read as UTF-8.
        self.out = strings([bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)])
        self.spelled = strings([b"%d " % i if decimal else i.to_bytes(4, "little") for i in range(len(pieces))])
        self.is_byte, self.is_control = kinds == BYTE, kinds == CONTROL
        self.cache = WordCache(CACHE_WORDS)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number for each word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.letter[points]
        sym = np.where(sym < 0, -2 - points.astype(np.int64), sym)  # letters without a piece keep their code point
        sym, lens = merge(sym, lens, self.table)
        odd = np.flatnonzero(sym < 0)
        if not len(odd):
            return sym, lens
        spelled = [chr(-2 - int(s)).encode() for s in sym[odd]]
        many = np.ones(len(sym), np.int64)
        many[odd] = list(map(len, spelled))
        out = np.repeat(sym, many)
        at = np.repeat(sym < 0, many)
        out[at] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        owner = np.repeat(np.arange(len(lens)), lens)
        return out, np.bincount(owner, weights=many, minlength=len(lens)).astype(np.int64)

    def normal(self, text: str) -> str:
        return (MARK + text if self.prefix and text else text).replace(" ", MARK)

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[bytes, int, bytes]]:
        """For each text its ids as spelled, without the end id, their number, and the bytes they decode to."""
        parts = [self.words(self.normal(t or "")) for t in texts]
        words = self.cache.missing(set().union(*parts))
        if words:
            ids, lens = self.encode_words(words)
            self.cache.young.update(zip(words, zip(spell(ids, lens, *self.spelled), lens.tolist(), spell(ids, lens, *self.out), strict=True), strict=True))
        for p in parts:
            spelled, counts, decoded = zip(*map(self.cache.young.__getitem__, p), strict=True) if p else ((), (), ())
            yield b"".join(spelled), sum(counts), b"".join(decoded)

    def finish(self, raw: bytes, prefixed: bool = True) -> str:
        """Text of decoded bytes: bytes that are no UTF-8 become U+FFFD one by one, and the space of the dummy prefix goes."""
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text, at = "", 0
            while at < len(raw):
                try:
                    text += raw[at:].decode()
                    break
                except UnicodeDecodeError as e:
                    text += raw[at : at + e.start].decode() + "�"
                    at += e.start + 1
        return text.removeprefix(" ") if self.prefix and prefixed else text

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, with the end id."""
        words = self.words(self.normal(text or ""))
        return [*(self.encode_words(words)[0].tolist() if words else []), self.end]

    def decode(self, ids: list[int]) -> str:
        a = np.asarray(ids, np.int64)
        first = a[~self.is_control[a]][:1]  # a space that was spelled as a byte is no prefix
        return self.finish(spell(a, np.array([len(a)]), *self.out)[0], not self.is_byte[first].any())


_loaded: dict[tuple[int, bool], PieceBpe] = {}
holds(__name__, _loaded.clear)


def _codec(model: bytes, decimal: bool = False) -> PieceBpe:
    key = hash(model), decimal
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceBpe(model, decimal)
    return _loaded[key]


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str, text: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` without ``text``, with the ids of each whole text (end id last) and the text they decode to.

    Adds n_tokens, ids (array of int) and decoded; with ``digests`` instead of the last two ids_sha256 (decimal ids
    joined by one space) and decoded_sha256 (UTF-8). Columns of these names in ``docs`` are replaced. A null or empty
    text has the end id alone and decodes to the empty text. Rows that repeat are each encoded. Texts go through in
    slices of a few MB, a longer one alone. No shuffle; the model file (under a MB, fixed) is read on the driver and
    broadcast."""
    shared = _model(docs, model)
    added = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("n_tokens", "ids", "decoded")
    kept = [c for c in docs.columns if c not in added and c != text]
    (hidden,) = fresh(docs, "encoded_text")
    source = docs.select(*[docs[c] for c in kept], docs[text].cast("string").alias(hidden))
    kinds = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = source.drop(hidden).withColumns({c: F.lit(None).cast(kinds[c]) for c in added}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, digests)
        end = b"%d" % codec.end if digests else codec.end.to_bytes(4, "little")
        for b in rows_by_bytes(batches, hidden, SLICE_BYTES):
            counts, ids, texts = [], [], []
            for spelled, n, raw in codec.encoded(b.column(b.schema.get_field_index(hidden)).to_pylist()):
                counts.append(n + 1)
                spelled += end
                decoded = codec.finish(raw)
                ids.append(hashlib.sha256(spelled).hexdigest() if digests else np.frombuffer(spelled, np.int32))
                texts.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
            columns = [pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i, f in enumerate(b.schema) if f.name != hidden] + columns, names=[*kept, *added])

    return source.mapInArrow(lean(run), schema)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the array column ``ids`` decodes to, in column ``out`` (replaced if there). Null ids give null."""
    shared = _model(df, model)
    source = df.drop(out) if out in df.columns else df
    schema = source.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return source.mapInArrow(lean(run), schema)
