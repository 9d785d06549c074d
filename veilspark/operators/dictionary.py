"""Scrubbing by dictionaries of known values (names, ids, ...): which values a text has, and the text without them.

A dictionary of up to BROADCAST_BYTES is one Aho-Corasick automaton that every task holds: a single pass over the texts,
without a shuffle. A larger one is an inverted index that stays distributed: each value is posted under the rarest of its
grams (runs of six bytes; a shorter value is its own gram), texts send the grams that may be posted, both meet by a join,
and a value counts once it stands in the text as a whole. The texts are read twice then, however large the dictionary is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.frames import fresh, same_columns, sliced

#: Values up to this many bytes are one automaton, sent to all tasks; more are an index.
BROADCAST_BYTES = 8 << 20  # each Python worker has an automaton of its own, which takes some twenty times as many bytes with its values
GRAM = 6  # bytes; a gram and its length are one whole number
FILTER_BITS = 1 << 29  # of the filter that is sent to all tasks, at most: 64 MB
_MAP_BITS = 1 << 15  # of one bitmap that Spark builds


def dictionary_of(df: DataFrame, source: str) -> DataFrame:
    """source and value of every non-empty cell of a table."""
    cells = F.explode(F.array(*[F.trim(F.col(c).cast("string")) for c in df.columns]))
    return df.select(F.lit(source).alias("source"), cells.alias("value")).where("value <> ''").distinct()


def _fits(values: DataFrame, most: int | None) -> bool:
    return (values.agg(F.sum(F.octet_length("value"))).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def _automaton(values: list[str]):
    import ahocorasick

    words = ahocorasick.Automaton()
    for v in values:
        words.add_word(v, v)
    words.make_automaton()
    return words


def matches(texts: DataFrame, values: DataFrame, id: str = "id", text: str = "text", most: int | None = None) -> DataFrame:
    """id, source and value for every value that stands anywhere in the text, each once for each row of ``texts``, whatever its id.

    ``values`` (source, value) is measured first: over ``most`` bytes (BROADCAST_BYTES) it is an index. Null texts and null or empty values match nothing."""
    values = values.where("value <> ''").select("source", "value").distinct()
    kind = dict(texts.dtypes)[id]
    if not _fits(values, most):
        key, body = fresh([id, "source", "value"], "key", "body")
        rows = texts.where(F.col(text).isNotNull()).select(F.col(id), _key(F.col(text)).alias(key), F.col(text).alias(body))
        found = indexed(texts.select(F.col(text).alias("text")), values.select("value").distinct())
        found = found.select(F.col("key").alias(key), F.explode("values").alias("value"))
        return rows.join(found, key).where(F.contains(body, "value")).join(values, "value").select(id, "source", "value")
    shared = texts.sparkSession.sparkContext.broadcast([(v.source, v.value) for v in values.collect()])  # BROADCAST_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: dict[str, list[str]] = {}
        for s, v in shared.value:
            sources.setdefault(v, []).append(s)
        words = _automaton(list(sources)) if sources else None
        for b in sliced(batches, 1) if words else ():
            rows = [(i, s, v) for i, t in enumerate(b.column(1).to_pylist()) if t for v in {v for _, v in words.iter(t)} for s in sources[v]]
            if rows:
                i, s, v = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(s), pa.array(v)], names=[id, "source", "value"])

    return texts.select(F.col(id), F.col(text).alias(fresh([id], "text")[0])).mapInArrow(run, f"`{id}` {kind}, source string, value string")


def scrub(texts: DataFrame, values: DataFrame, id: str = "id", text: str = "text", placeholder: str = "<REDACTED>", most: int | None = None) -> DataFrame:
    """``texts`` with scrubbed_text: every dictionary value that the text has replaced, longer values first, then by the value itself.

    Every row is scrubbed, whether its id is null, repeated or not there at all: rows aren't told apart by ids. A column
    scrubbed_text of the caller's is replaced, all others stay as they are."""
    values = values.where("value <> ''").select("value").distinct()
    rows = texts.select(*same_columns(texts, "scrubbed_text"), F.col(text).alias(fresh(texts.columns, "body")[0]))
    body, keep = rows.columns[-1], rows.columns[:-1]
    if not _fits(values, most):
        key, found = fresh([*rows.columns, "scrubbed_text"], "key", "found")
        index = indexed(texts.select(F.col(text).alias("text")), values).select(F.col("key").alias(key), F.col("values").alias(found))
        joined = rows.withColumn(key, _key(F.col(body))).join(index, key, "left")
        longest = F.array_sort(F.filter(found, lambda v: F.contains(body, v)), _longest_first)
        clean = F.aggregate(longest, F.col(body), lambda t, v: F.replace(t, v, F.lit(placeholder)))
        return joined.select(*keep, F.coalesce(clean, F.col(body)).alias("scrubbed_text"))
    shared = texts.sparkSession.sparkContext.broadcast([v.value for v in values.collect()])  # BROADCAST_BYTES at most
    schema = rows.select(*keep, F.col(body).alias("scrubbed_text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _automaton(shared.value) if shared.value else None

        def clean(t: str | None) -> str | None:
            for v in sorted({v for _, v in words.iter(t)}, key=lambda v: (-len(v), v)) if t and words else ():
                t = t.replace(v, placeholder)
            return t

        for b in sliced(batches, len(keep)):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(map(clean, b.column(len(keep)).to_pylist()), pa.string())], names=[*keep, "scrubbed_text"])

    return rows.mapInArrow(run, schema)


def _longest_first(a: Column, b: Column) -> Column:
    return F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)


def _key(text: Column) -> Column:
    """Equal texts are one: what a text holds doesn't depend on its row. Texts of one hash share their candidates, which are verified on each."""
    return F.xxhash64(text)


# --- the distributed index


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """All runs of ``length`` bytes as whole numbers, each with its length in the top byte."""
    n = len(data) - length + 1
    out = np.full(max(n, 0), length << 56, np.int64)
    for k in range(length if n > 0 else 0):
        out |= data[k : k + n].astype(np.int64) << (8 * k)
    return out


def posted(values: DataFrame) -> DataFrame:
    """gram and value: each value once, under the gram that the fewest values have (ties by the gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 0, 256 << 10):
            own = [np.unique(grams(np.frombuffer(v.encode(), np.uint8), min(GRAM, len(v.encode())))) for v in b.column(0).to_pylist()]
            at = np.repeat(np.arange(len(own)), [len(g) for g in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), b.column(0).take(pa.array(at))], names=["gram", "value"])

    every = values.select("value").mapInArrow(run, "gram long, value string")
    sizes = every.groupBy("gram").agg(F.count("*").alias("n"))
    return every.join(sizes, "gram").groupBy("value").agg(F.min(F.struct("n", "gram")).alias("g")).select("g.gram", "value")


def gram_filter(spark: SparkSession, index: DataFrame, bits: int) -> tuple[np.ndarray, set[int]]:
    """A bitmap of the posted grams (by a hash that numpy can follow) and their lengths."""
    at = index.select(_slot(F.col("gram"), bits).alias("at"), F.shiftrightunsigned("gram", 56).alias("length"))
    rows = at.groupBy(F.floor(F.col("at") / _MAP_BITS).alias("no")).agg(F.bitmap_construct_agg(F.col("at") % _MAP_BITS).alias("bitmap"), F.collect_set("length").alias("lengths")).collect()  # bits / 8 bytes
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.no * _MAP_BITS // 8 : (r.no + 1) * _MAP_BITS // 8] = np.frombuffer(bytes(r.bitmap), np.uint8)
    return out, {int(x) for r in rows for x in r.lengths}


_STEP = 0x9E3779B1  # spreads grams over the bitmap


def _slot(gram: Column, bits: int) -> Column:
    """Two halves of a gram, each times an odd constant, folded: the same in Spark and numpy, within 63 bits."""
    low, high = gram.bitwiseAND(F.lit((1 << 28) - 1)), F.shiftrightunsigned(gram, 28)
    mixed = (low * _STEP).bitwiseXOR(high.bitwiseAND(F.lit((1 << 28) - 1)) * 0x85EBCA77)
    return F.shiftrightunsigned(mixed, 7).bitwiseAND(F.lit(bits - 1))


def slot(gram: np.ndarray, bits: int) -> np.ndarray:
    mask = np.int64((1 << 28) - 1)
    mixed = ((gram & mask) * np.int64(_STEP)) ^ (((gram >> np.int64(28)) & mask) * np.int64(0x85EBCA77))
    return (mixed >> np.int64(7)) & np.int64(bits - 1)


def indexed(texts: DataFrame, values: DataFrame) -> DataFrame:
    """key (of a text) and values that may stand in it: those whose posted gram the text has. ``texts``: text; ``values``: value."""
    index = posted(values)
    n = values.count()
    bits = min(FILTER_BITS, max(_MAP_BITS, 1 << (16 * n - 1).bit_length())) if n else _MAP_BITS
    known, lengths = gram_filter(texts.sparkSession, index, bits)
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in sliced(batches, 1):
            keys, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                data = np.frombuffer(t.encode(), np.uint8)
                for length in lengths:
                    every = grams(data, length)
                    at = slot(every, bits)
                    hit = np.unique(every[((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)])
                    keys.append(np.full(len(hit), i))
                    out.append(hit)
            if keys and sum(map(len, out)):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(keys))), pa.array(np.concatenate(out))], names=["key", "gram"])

    hits = texts.where(F.col("text").isNotNull()).select(_key(F.col("text")).alias("key"), "text").mapInArrow(run, "key long, gram long").distinct()  # copies of a text are one
    return hits.join(index, "gram").groupBy("key").agg(F.collect_set("value").alias("values"))
