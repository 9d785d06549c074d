"""How filters interact: what each of them removes in every order of application.

Each document fails a set of filters, a mask of five bits. Whether its text is a copy is decided on fingerprints: texts
whose fingerprint comes once need no look; the others are routed by their xxhash through an RDD, each partition first
keeping one entry a text. Where they meet, a fingerprint has a chain of full texts with their least id, so that texts
that merely share a hash stay apart; ids over the least are emitted. Documents are then counted by part and mask in
vectors that combineByKey merges, and every order's figures follow from a part's vector.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from veilspark.llm.common import KeyFilter, lean, stage

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
SPACE = r"[\x20\x09-\x0D]+"
HELD = 32 << 20  # bytes of texts that a partition holds before it sends them on
MASKS = 1 << len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_mask(text: Column) -> Column:
    """Filters A to D that a text fails, as bits; a null text is an empty one."""

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE, -1), lambda w: w != "")
        return F.get(F.transform(F.array(words), lambda w: bits(t, F.size(w), F.size(F.array_distinct(w)))), F.lit(0))

    def bits(t: Column, n: Column, distinct: Column) -> Column:
        capitals = F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z]", ""))
        fails = (n < 200, F.lit(100).cast("long") * distinct < F.lit(50).cast("long") * n, F.lit(100).cast("long") * capitals > F.lit(2).cast("long") * F.char_length(t), t.rlike("[#$%&*|]"))
        out = F.lit(0)
        for k, f in enumerate(fails):
            out = out + F.when(f, 1 << k).otherwise(0)
        return out

    return F.get(F.transform(F.array(F.coalesce(text, F.lit(""))), of), F.lit(0))


class Chains:
    """Texts by fingerprint: each text once, with its least id and the rows that have this id; rows with more are copies."""

    def __init__(self):
        self.by_print: dict[int, list[list]] = {}
        self.size = 0

    def add(self, fingerprint: int, text: bytes, id: int, rows: Counter) -> tuple[int, Counter] | None:
        """Takes rows of a text; gives the id and rows that are now known to be copies."""
        chain = self.by_print.setdefault(fingerprint, [])
        for entry in chain:
            if entry[0] == text:
                if id == entry[1]:
                    entry[2].update(rows)
                    return None
                if id > entry[1]:
                    return id, rows
                out = entry[1], entry[2]
                entry[1:] = id, Counter(rows)
                return out
        chain.append([text, id, Counter(rows)])
        self.size += len(text) + 200
        return None

    def entries(self) -> Iterator[tuple[int, bytes, int, Counter]]:
        for fingerprint, chain in self.by_print.items():
            for text, id, rows in chain:
                yield fingerprint, text, id, rows


def _combined(rows: Iterator[Row], most: int) -> Iterator[tuple[int, tuple]]:
    """By fingerprint, one entry for each text of a partition; copies that are seen here go on without their text, by their id."""
    held = Chains()
    for r in rows:
        if copy := held.add(r.fp, bytes(r.body), r.id, Counter({(r.part, r.mask): 1})):
            yield copy[0], (None, *copy)  # dealt by id, as the copies of one text may be a third of all
        if held.size > most:
            for fingerprint, text, id, n in held.entries():
                yield fingerprint, (text, id, n)
            held = Chains()
    for fingerprint, text, id, n in held.entries():
        yield fingerprint, (text, id, n)


def _decided(pairs: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, str, int, int]]:
    """id, part, mask and rows, with the bit of copies."""
    held = Chains()
    for fingerprint, (text, id, rows) in pairs:
        copy = (id, rows) if text is None else held.add(fingerprint, text, id, rows)
        if copy:
            yield from ((copy[0], part, mask | COPY, n) for (part, mask), n in copy[1].items())
    for _, _, id, rows in held.entries():
        yield from ((id, part, mask, n) for (part, mask), n in rows.items())


def masks(docs: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id, part, mask and n (rows alike) of all documents, with all five filters.

    Only rows whose fingerprint another row has too travel with their texts, and of these a text once for each ``held`` bytes of a partition."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("fp"), text.alias("body"))
    small = stage(rows.select("id", "part", "fp", own_mask(F.col("body")).alias("mask")), "masks")
    recurring = small.where("id IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    meet = KeyFilter(stage(recurring, "recurring"), "fp")
    alone = meet.flagged(small, "may", "fp").where("NOT may OR id IS NULL").select("id", "part", "mask", F.lit(1).cast("long").alias("n"))
    met = meet.hits(rows.where("id IS NOT NULL"), "fp").select("id", "part", "fp", own_mask(F.col("body")).alias("mask"), F.encode("body", "UTF-8").alias("body"))
    routed = met.rdd.mapPartitions(lambda it: _combined(it, held)).partitionBy(_width(docs))
    decided = routed.mapPartitions(_decided).toDF("id long, part string, mask int, n long")
    return alone.union(decided).withColumnRenamed("id", "doc_id")


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def part_counts(rows: DataFrame, labels: DataFrame):
    """An RDD of each part's counts: documents, good ones and toxic ones by mask."""
    of = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(of("quality"), of("toxic")).where("quality + toxic > 0")
    judged = rows.join(stage(known, "known"), F.col("doc_id") == F.col("labelled"), "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            part = b.column(0).dictionary_encode()
            mask, n, good, toxic = (b.column(c).to_numpy() for c in range(1, 5))
            codes = part.indices.to_numpy()
            for code, name in enumerate(part.dictionary.to_pylist()):
                at = codes == code
                one = held.setdefault(name, np.zeros((3, MASKS), np.int64))
                for k, weight in enumerate((n, n * good, n * toxic)):
                    np.add.at(one[k], mask[at], weight[at])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tobytes() for v in held.values()])], names=["part", "counts"])

    partial = judged.mapInArrow(lean(vectors), "part string, counts binary").rdd.map(lambda r: (r.part, np.frombuffer(r.counts, np.int64).reshape(3, MASKS)))
    return partial.combineByKey(lambda v: v.copy(), lambda a, v: a + v, lambda a, b: a + b, _width(rows))


def figures(counts: np.ndarray) -> Iterator[tuple]:
    """filter_order, step and COUNTS for all orders, from a part's counts by mask."""
    every = np.arange(MASKS)
    rows, shapley = [], Counter()
    for order in map("".join, permutations(FILTERS)):
        gone = np.zeros(MASKS, bool)
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails = (every & bit) > 0
            here = fails & ~gone
            removed, good, toxic = counts[:, here].sum(1).tolist()
            redundant = int(counts[0, fails & gone].sum())
            gone |= fails
            shapley[name] += removed
            rows.append((order, step, name, int(counts[0, ~gone].sum()), removed, redundant, int(counts[0, bit]), good, toxic))
    for order, step, name, *values in rows:
        yield (order, step, *values, shapley[name])


def audit(docs: DataFrame, labels: DataFrame, held: int = HELD) -> DataFrame:
    """part, filter_order, step and COUNTS: one row for each part, order of the five filters and step.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic; other columns don't matter. A null text is an empty
    one, a null source the part of the empty string. E compares with smaller ids only: rows that share an id and a text are no
    copies of each other, and rows without an id neither are copies nor make others copies; they have no labels. Of
    several label rows of a document any 1 counts. Rows that repeat count each. An empty table gives no rows, a part has all
    its 600. A text or a part of any share is one entry for each partition before anything is shuffled."""
    rows = part_counts(masks(docs, held), labels).flatMap(lambda kv: [(kv[0], *f) for f in figures(kv[1])])
    return rows.toDF("part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
first AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
m AS (SELECT w.doc_id, part, (len(words) < 200)::INTEGER AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER AS b, (100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 2 * length(w.text))::INTEGER AS c,
             regexp_matches(w.text, '[#$%&*|]')::INTEGER AS d, coalesce(doc_id > least, FALSE)::INTEGER AS e FROM w JOIN first USING (text)),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS x, a + b + c + d + e AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
u AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT p.k || q.k || r.k || s.k || t.k AS filter_order FROM u p, u q, u r, u s, u t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
os AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM o),
y AS (SELECT *, filter_order[step] AS k FROM os),
z AS (SELECT part, filter_order, step, k, n, good, toxic, fails, CASE k WHEN 'A' THEN x['A'] WHEN 'B' THEN x['B'] WHEN 'C' THEN x['C'] WHEN 'D' THEN x['D'] ELSE x['E'] END AS hit,
             list_sum(list_transform(range(1, step), lambda i: CASE filter_order[i] WHEN 'A' THEN x['A'] WHEN 'B' THEN x['B'] WHEN 'C' THEN x['C'] WHEN 'D' THEN x['D'] ELSE x['E'] END)) AS before FROM f, y),
g AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (hit = 0 AND coalesce(before, 0) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit = 1 AND coalesce(before, 0) = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit = 1 AND before > 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (hit = 1 AND fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (hit = 1 AND coalesce(before, 0) = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (hit = 1 AND coalesce(before, 0) = 0), 0)::BIGINT AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM g
"""
