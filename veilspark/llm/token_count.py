"""Token counts of whole texts by rank-synchronous array merging.

The vocabulary file is a tokenizer JSON: byte-level BPE whose words end in a marked symbol, texts in NFC and lower
case, white space dropped. Counts are those of the library that reads such files.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import fresh, holds, lean, rows_by_bytes
from veilspark.llm.merge_rounds import MergeTable, WordCache, merge

SLICE_BYTES = 2 << 20
CACHE_WORDS = 300_000
#: fixed values: capitals that Python's tables don't know, and their small letters
NEWER_CAPITALS = {"\ua7cb": "\u0264", "\ua7dc": "\u019b"}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _must_be_known(j: dict) -> None:
    """Raises for a file that asks for anything that isn't done here: it would be counted wrongly without a word."""
    model, normal, split = j.get("model") or {}, j.get("normalizer") or {}, j.get("pre_tokenizer") or {}
    steps = normal.get("normalizers") or [normal]
    kinds = [(s.get("type"), *((s.get("pattern"), s.get("content")) if s.get("type") == "Replace" else ())) for s in steps]
    parts = split.get("pretokenizers") or [split]
    plain = [("NFC",), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase",)]
    checks = {
        "a BPE model": model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")),
        "words that end in a marked symbol": bool(model.get("end_of_word_suffix")),
        "texts in NFC and lower case": kinds in (plain, [plain[0], plain[2]]),
        "a split that keeps what a pattern matches, then bytes": [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and (parts[0].get("behavior"), parts[0].get("invert"), [*parts[0]["pattern"]]) == ("Removed", True, ["Regex"])
        and not parts[1].get("add_prefix_space") and parts[1].get("use_regex") is False,
        "special tokens that are taken as they stand": not any(t.get(k) for t in j.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        "all letters of bytes": all(x + end in model.get("vocab", {}) for x in _byte_letters() for end in ("", model.get("end_of_word_suffix") or "")),
    }
    if bad := [what for what, ok in checks.items() if not ok]:
        raise ValueError(f"not a tokenizer of the kind that is counted here: no {', no '.join(bad)}")


class WordBpe:
    """Counts tokens of texts. Memory is bounded: the cache of counted words is emptied when it is full."""

    def __init__(self, spec: bytes):
        j = json.loads(spec)
        _must_be_known(j)
        vocab, suffix = j["model"]["vocab"], j["model"]["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges]) for k in (0, 1))
        made = np.array([vocab["".join(m)] for m in merges])
        sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        sizes[list(vocab.values())] = list(map(len, vocab))
        self.table = MergeTable(left, right, np.arange(len(merges)), made, len(sizes), sizes)
        letters = _byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int32)
        split = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        special = sorted((t["content"] for t in j["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cache = WordCache(CACHE_WORDS)

    def count(self, texts: list[str | None]) -> list[int]:
        fixed, parts = [], []
        for text in texts:
            n, words = 0, []
            for piece in self._between(text or ""):
                if piece is None:
                    n += 1
                else:
                    words += self.words(self._normal(piece))
            fixed.append(n)
            parts.append(words)
        counted = self._counted(self.cache.missing(set().union(*parts)))  # may begin a new generation
        self.cache.young.update(counted)
        return [n + sum(map(self.cache.young.__getitem__, words)) for n, words in zip(fixed, parts, strict=True)]

    def _between(self, text: str) -> Iterator[str | None]:
        """The stretches between special tokens, and None for each of these."""
        if self.special is None or not self.special.search(text):
            yield text
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()]
            yield None
            at = m.end()
        yield text[at:]

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter, so no final sigma
            for capital, small in NEWER_CAPITALS.items():
                text = text.replace(capital, small)
        return text.lower()

    def _counted(self, words: list[str]) -> dict[str, int]:
        if not words:
            return {}
        coded = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(coded), np.uint8)
        lens = np.fromiter(map(len, coded), np.int64, len(coded))
        sym = self.inner[flat]
        ends = np.cumsum(lens) - 1
        sym[ends] = self.last[flat[ends]]
        _, n = merge(sym, lens, self.table)
        return dict(zip(words, n.tolist(), strict=True))


_loaded: dict[int, WordBpe] = {}
holds(__name__, _loaded.clear)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048, count_column: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of each whole text, its UTF-8 bytes and whether it is over ``limit``.

    Adds n_bytes, ``count_column`` and over_limit; columns of these names in ``docs`` are replaced. A null or empty
    text has no bytes and no tokens. Rows that repeat are each counted. Texts go through in slices of a few MB, a
    longer text alone. No shuffle. The vocabulary file (some MB, fixed) is read on the driver and broadcast."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    added = ("n_bytes", count_column, "over_limit")
    rest = [c for c in docs.columns if c not in added]
    (hidden,) = fresh(docs, "counted_text")
    source = docs.select(*[docs[c] for c in rest if c != text], docs[text].cast("string").alias(hidden))
    kept = [c for c in rest if c != text]
    schema = source.drop(hidden).withColumns({"n_bytes": F.lit(0).cast("long"), count_column: F.lit(0).cast("long"), "over_limit": F.lit(False)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _loaded:
            _loaded[key] = WordBpe(spec.value)
        counter = _loaded[key]
        for b in rows_by_bytes(batches, hidden, SLICE_BYTES):
            column = b.column(b.schema.get_field_index(hidden))
            n = counter.count(column.to_pylist())
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i, f in enumerate(b.schema) if f.name != hidden] + [size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[*kept, *added],
            )

    return source.mapInArrow(lean(run), schema)
