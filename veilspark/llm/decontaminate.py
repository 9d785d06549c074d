"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of a test item is a seed, however many documents hold it: an edited copy of a frequent passage may have no
rare one. Documents that hold a seed are aligned with its item around that place; the alignment forgives changed, added
and left-out words. Places whose words can't reach the least score are left out before.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veilspark.llm.common import KeyFilter, fresh, lean, rows_by_bytes, stage

GRAM = 4
MATCH, MISS, GAP = 2, -1, -1
LEAST = 0.5  # of the score of the whole item
LONG = 40  # matching words at least that count as a leak of any item, however long
ITEMS_BYTES = 4 << 20  # of test items that are broadcast at once; more go in several rounds
SLICE_BYTES = 4 << 20
HITS = 1 << 20  # places of seeds, times the items that have them, that are held at once; a text with more stands alone
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
UNSPACED = ("CJK ", "HIRAGANA ", "KATAKANA", "HALFWIDTH KATAKANA", "THAI ", "LAO ", "KHMER ", "MYANMAR ")
_M = np.uint64(0x9E3779B97F4A7C15)


class _Letters(dict):
    """For str.translate: what is no letter, mark or digit becomes a space; letters of UNSPACED scripts stand alone; invisible signs go."""

    def __missing__(self, c: int) -> str:
        kind = unicodedata.category(chr(c))
        if c < 128:
            out = chr(c) if chr(c).isalnum() else " "
        elif kind == "Cf":
            out = ""
        elif kind[0] in "LM" and unicodedata.name(chr(c), "").startswith(UNSPACED):
            out = f" {chr(c)} "
        else:
            out = chr(c) if kind[0] in "LMN" else " "
        self[c] = out
        return out


_LETTERS = _Letters()


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters, marks and digits in lower case; each letter of a script that is written without spaces is a word."""
    text = text or b""
    return text.lower().translate(_SPACED).split() if text.isascii() else text.decode().lower().translate(_LETTERS).encode().split()


def _codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n ids from each place on; alignment decides, so that hashes that meet do no harm."""
    out = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
    for k in range(n):
        out = (out ^ ids[k : len(ids) - n + 1 + k].astype(np.uint64)) * _M
        out ^= out >> np.uint64(29)
    return out


class Items:
    """Test items as word ids, and their n-grams: code, item, place. Items of fewer words than GRAM have one n-gram, of all their words."""

    def __init__(self, texts: list[bytes | None]):
        self.ids: dict[bytes, int] = {}
        self.words = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(t)], np.int64) for t in texts]
        self.widths = sorted({min(GRAM, len(w)) for w in self.words if len(w)})
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in self.widths:
            mine = [(i, _codes(w, n)) for i, w in enumerate(self.words) if len(w) and min(GRAM, len(w)) == n]
            code = np.concatenate([c for _, c in mine])
            item = np.concatenate([np.full(len(c), i) for i, c in mine])
            place = np.concatenate([np.arange(len(c)) for _, c in mine])
            order = np.argsort(code, kind="stable")
            self.grams[n] = code[order], item[order], place[order]
        #: by n: the different codes, and where each one's rows begin in ``grams``, with the end
        self.codes, self.span = {}, {}
        for n, (code, _, _) in self.grams.items():
            self.codes[n], begin = np.unique(code, return_index=True)
            self.span[n] = np.r_[begin, len(code)]
        self.length = np.array([len(w) for w in self.words], np.int64)
        #: item and word in one number, of all words that an item has
        self.unit = len(self.ids) + 1
        self.has = np.unique(np.concatenate([w + i * self.unit for i, w in enumerate(self.words)]))

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of the texts, 0 for words that no item has, with zeros between the texts; and where each text begins."""
        parts = [words(t) for t in texts]
        gap = [b""] * GRAM
        flat = [w for p in parts for w in (*p, *gap)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + GRAM
        return np.fromiter(map(self.ids.get, flat, repeat(0)), np.int64, len(flat)), np.cumsum(sizes) - sizes

    def hits(self, ids: np.ndarray, n: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a code of the sorted ``among`` begins, and that code's row."""
        if not len(among) or len(ids) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = _codes(ids, n)
        ok = ids[: len(code)] > 0
        for k in range(1, n):
            ok &= ids[k : len(code) + k] > 0
        at = np.flatnonzero(ok)
        row = np.searchsorted(among, code[at])
        row[row == len(among)] = 0
        same = among[row] == code[at]
        return at[same], row[same]


def align(items: list[np.ndarray], regions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its region: score, and the region's words from begin to end.

    Smith and Waterman's recurrence, row by row for all pairs at once; gaps within a row are a running maximum. With
    each score goes the place where its alignment began."""
    n, rows, width = len(items), max(map(len, items)), max(map(len, regions))
    x = np.full((n, rows), -1, np.int64)
    y = np.full((n, width), -2, np.int64)
    for k, (a, b) in enumerate(zip(items, regions, strict=True)):
        x[k, : len(a)], y[k, : len(b)] = a, b
    # score and begin in one number: the higher score, then the later begin
    unit = 1 << 31
    column = np.arange(width)
    fresh_start = np.broadcast_to(column, (n, width))
    h = np.concatenate([np.zeros((n, 1), np.int64), fresh_start + 1], 1)  # an alignment that begins after column j
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    slope = -GAP * unit * np.arange(width)
    for i in range(rows):
        step = np.where(x[:, i : i + 1] == y, MATCH, MISS) * unit
        now = np.maximum(h[:, :-1] + step, h[:, 1:] + GAP * unit)
        now = np.where(now >= unit, now, fresh_start + 1)
        now = np.maximum(np.maximum.accumulate(now + slope, 1) - slope, fresh_start + 1)
        now = np.where(now >= unit, now, fresh_start + 1)
        h[:, 1:] = now
        top = now.argmax(1)
        value = now[np.arange(n), top]
        better = (value >> 31) > (best >> 31)
        best[better], end[better] = value[better], top[better] + 1
    return best >> 31, best & (unit - 1), end


def _leaks(items: Items, ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
    """Text, item, score, begin and end (in words) of the best alignment of each text and item with an n-gram in common."""
    found = []
    for n, (code, item, place) in items.grams.items():
        at, row = items.hits(ids, n, items.codes[n])
        lo, hi = items.span[n][row], items.span[n][row + 1]
        found.append((at, lo, hi - lo, np.searchsorted(begins, at, side="right") - 1, item, place))
    load = sum((np.bincount(text, weights=many, minlength=len(begins)) for _, _, many, text, _, _ in found), np.zeros(len(begins)))
    out, t0 = [], 0
    while t0 < len(begins):
        t1 = max(t0 + 1, int(np.searchsorted(np.cumsum(load[t0:]), HITS, side="right")) + t0)
        if load[t0:t1].any():
            out += _aligned(items, [tuple(x[(f[3] >= t0) & (f[3] < t1)] for x in f[:4]) + f[4:] for f in found], ids, begins, sizes, least)
        t0 = t1
    return out


def _aligned(items: Items, found: list[tuple], ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
    """_leaks() of the texts that these places are in: place, first gram and grams with its code, text; items and places of the grams."""
    rows = []
    for at, lo, many, text, item, place in found:
        at, text = np.repeat(at, many), np.repeat(text, many)
        pick = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        rows.append(np.stack([text, item[pick], at - begins[text] - place[pick]], 1))
    hits = np.concatenate(rows)
    hits = hits[np.lexsort(hits.T[::-1])]  # by text, item, diagonal
    length = items.length
    new = np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(1) | (hits[1:, 2] - hits[:-1, 2] > length[hits[1:, 1]])]
    first, last = hits[new], hits[np.r_[np.flatnonzero(new)[1:] - 1, len(hits) - 1]]
    t, i = first[:, 0], first[:, 1]
    slack = length[i] // 2 + GRAM
    lo, hi = np.maximum(0, first[:, 2] - slack), np.minimum(sizes[t], last[:, 2] + length[i] + slack)
    ok = _can_reach(items, ids, i, begins[t] + lo, begins[t] + hi, least)
    pairs = np.stack([t, i, lo, hi], 1)[ok].tolist()
    pairs.sort(key=lambda p: (p[3] - p[2]) * 4096 + length[p[1]])  # alike sizes together: little padding
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    k = 0
    while k < len(pairs):
        stop = k
        while stop < len(pairs) and (stop == k or (stop - k + 1) * (pairs[stop][3] - pairs[stop][2]) <= 100_000):
            stop += 1
        part = pairs[k:stop]
        k = stop
        score, begin, end = align([items.words[i] for _, i, _, _ in part], [ids[begins[t] + lo : begins[t] + hi] for t, _, lo, hi in part])
        for (t, i, lo, _), s, a, b in zip(part, score.tolist(), begin.tolist(), end.tolist(), strict=True):
            share = s / (MATCH * int(length[i]))
            if (share >= least or s >= MATCH * LONG) and (t, i) not in best or (t, i) in best and share > best[t, i][0]:
                best[t, i] = (share, lo + a, lo + b)
    return [(t, i, *v) for (t, i), v in best.items()]


def _can_reach(items: Items, ids: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float) -> np.ndarray:
    """Whether so many words of each stretch of ``ids`` are in its item that an alignment can reach a score that is reported.

    No leak is lost: a score is at most MATCH for each of the stretch's words that the item has."""
    out = np.zeros(len(item), bool)
    wide = np.cumsum(hi - lo)
    k = 0
    while k < len(item):
        stop = max(k + 1, int(np.searchsorted(wide, (wide[k - 1] if k else 0) + HITS, side="right")))
        size = hi[k:stop] - lo[k:stop]
        owner = np.repeat(np.arange(stop - k), size)
        words = ids[np.arange(size.sum()) + np.repeat(lo[k:stop] - (np.cumsum(size) - size), size)]
        some = np.flatnonzero(words)
        key = item[k:stop][owner[some]] * items.unit + words[some]
        at = np.searchsorted(items.has, key)
        at[at == len(items.has)] = 0
        shared = np.bincount(owner[some][items.has[at] == key], minlength=stop - k)
        out[k:stop] = shared >= np.minimum(least * items.length[item[k:stop]] - 1e-9, LONG)
        k = stop
    return out


def alignments(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, items_bytes: int = ITEMS_BYTES) -> DataFrame:
    """Every row of ``docs`` (all columns but text) with each item it leaks: item_id, score, begin_word, end_word.

    score: share of the whole item's alignment score; reported from ``least`` on, or from 40 matching words on. Null and
    empty texts and items leak nothing; items of under four words need all their words in a row as a seed. Items and
    rows that repeat are reported each. Columns of ``docs`` with these names are left out. Items are broadcast in
    rounds of ``items_bytes``."""
    spark = docs.sparkSession
    made, kind = ("item_id", "score", "begin_word", "end_word"), dict(benchmark.dtypes)["item_id"]
    kept = [c for c in docs.columns if c not in made and c != "text"]
    (hidden,) = fresh(docs, "aligned_text")
    source = docs.select(*[docs[c] for c in kept], docs["text"].cast("string").alias(hidden))
    schema = source.drop(hidden).withColumns({"item_id": F.lit(None).cast(kind), "score": F.lit(0.0), "begin_word": F.lit(0), "end_word": F.lit(0)}).schema
    bench = benchmark.select("item_id", F.col("text").cast("string")).where("text IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // items_bytes))
    out = None
    for r in range(rounds):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r).orderBy("item_id", "text").collect()  # items_bytes at most, or an item
        if not rows:
            continue
        part = _round(spark, source, hidden, kept, schema, rows, least)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _round(spark, source: DataFrame, hidden: str, kept: list[str], schema, rows: list, least: float) -> DataFrame:
    shared = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text.encode() for r in rows]))

    kind = to_arrow_type(schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value[1])
        names = pa.array(shared.value[0], kind)
        for b in rows_by_bytes(batches, hidden, SLICE_BYTES):
            at = b.schema.get_field_index(hidden)
            ids, begins = items.read(b.column(at).cast(pa.binary()).to_pylist())
            sizes = np.diff(np.r_[begins, len(ids)]) - GRAM
            found = _leaks(items, ids, begins, sizes, least)
            if found:
                t, i, score, lo, hi = (np.array(x) for x in zip(*found, strict=True))
                of = pa.array(t)
                columns = [names.take(pa.array(i)), pa.array(score), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(k).take(of) for k in range(b.num_columns) if k != at] + columns, names=[*kept, "item_id", "score", "begin_word", "end_word"])

    return source.mapInArrow(lean(run), schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item, by doc_id and text; rows with a null id too.

    The keys of leaking rows are written; rows that a filter on them rules out stay where they are, so that only
    leaking rows, and a few others, are shuffled."""
    h1, h2, flag, k1, k2 = fresh(docs, "key", "key_2", "in_doubt", "leak", "leak_2")
    of = lambda seed: F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    rows = docs.withColumns({h1: of(1), h2: of(2)})
    leaks = alignments(rows.select(F.col(h1).alias("key"), F.col(h2).alias("key_2"), "text"), benchmark).select("key", "key_2").distinct()
    leaks = stage(leaks, "leaks")
    rows = KeyFilter(leaks, "key", "key_2").flagged(rows, flag, h1, h2)
    leaks = leaks.select(F.col("key").alias(k1), F.col("key_2").alias(k2))
    unsure = rows.where(F.col(flag)).join(leaks, (F.col(h1) == F.col(k1)) & (F.col(h2) == F.col(k2)), "left_anti")
    return rows.where(~F.col(flag)).select(*docs.columns).union(unsure.select(*docs.columns))
