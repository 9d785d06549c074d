"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to whole numbers, and each block of rows is kept as bitmaps: one for each attribute and binary
digit, a bit for each row. A pack of queries is scored together: an attribute's multiples are added up once for the
block, and each query adds those that its digits call for, by bitmap arithmetic (full adders), which leaves the scores
as slices again. The top rows are read from the most significant slice downwards; rows that tie at the boundary are
resolved by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import lean

SCALE = 256
BLOCK = 8192  # rows of a block of the index
QUERIES = 64  # queries that go to a block together
DIGIT = 4  # binary digits of a query's weight that are looked up at once


def quantise(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as whole numbers of 64 bits; a component that leaves these is an error."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if scaled.size and (scaled.max() >= 2.0**63 or scaled.min() < -(2.0**63)):
        raise ValueError("a quantised component leaves 64 bits")
    return scaled.astype(np.int64)


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of two sliced numbers (lowest slice first)."""
    out, carry = [], None
    for k in range(max(len(a), len(b))):
        x, y = (z[k] if k < len(z) else None for z in (a, b))
        if x is None or y is None:
            x = y if x is None else x
            out.append(x if carry is None else x ^ carry)
            carry = None if carry is None else x & carry
            continue
        half = x ^ y
        out.append(half if carry is None else half ^ carry)
        carry = (x & y) if carry is None else (x & y) | (half & carry)
    return out if carry is None else [*out, carry]


class SlicedBlock:
    """Bitmaps of up to BLOCK quantised rows. ``low`` is each attribute's least value; the slices hold what is above it."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.low = values.min(0)
        above = values.astype(np.uint64) - self.low.astype(np.uint64)  # right in 64 bits without a sign
        self.words = -(-self.n // 64)
        self.slices = [[self._bits((above[:, d] >> np.uint64(j)) & np.uint64(1)) for j in range(int(above[:, d].max()).bit_length())] for d in range(values.shape[1])]
        self.ones = self._bits(np.ones(self.n, bool))
        self._tables: dict[int, np.ndarray] = {}

    def _bits(self, flags: np.ndarray) -> np.ndarray:
        packed = np.packbits(flags.astype(bool), bitorder="little")
        return np.r_[packed, np.zeros(self.words * 8 - len(packed), np.uint8)].view(np.uint64)

    def multiples(self, d: int) -> np.ndarray:
        """Slices of 0 to 15 times the attribute, then of 0 to 15 times its complement below the highest value of its slices."""
        if d in self._tables:
            return self._tables[d]
        slices = self.slices[d]
        out = self._tables[d] = np.zeros((2 << DIGIT, len(slices) + DIGIT, self.words), np.uint64)
        for at, one in ((0, slices), (1 << DIGIT, [self.ones & ~s for s in slices])):
            total: list[np.ndarray] = []
            for m in range(1, 1 << DIGIT):
                total = _added(total, one)[: out.shape[1]]  # what is beyond is empty
                out[at + m, : len(total)] = total
        return out

    def scores(self, queries: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Slices of all rows' inner products with each query (by slice, query and word; lowest first), less an offset for each query.

        A negative weight counts an attribute's complement below its highest value, so that all summands are positive."""
        size = np.where(queries < 0, (~queries).astype(np.uint64) + np.uint64(1), queries.astype(np.uint64))
        low, most, offset = self.low.tolist(), 0, []
        for q in queries.tolist():
            most = max(most, sum(abs(w) * ((1 << len(s)) - 1) for w, s in zip(q, self.slices, strict=True)))
            offset.append(sum(w * (x + ((1 << len(s)) - 1 if w < 0 else 0)) for w, x, s in zip(q, low, self.slices, strict=True)))
        total = np.zeros((most.bit_length() + 1, len(queries), self.words), np.uint64)
        carry, half, spare, added = (np.empty(total.shape[1:], np.uint64) for _ in range(4))
        for d, slices in enumerate(self.slices):
            if not slices or not size[:, d].any():
                continue
            table, sign = self.multiples(d), np.where(queries[:, d] < 0, 1 << DIGIT, 0)
            for shift in range(0, int(size[:, d].max()).bit_length(), DIGIT):
                pick = sign + ((size[:, d] >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                top = min(table.shape[1], len(total) - shift)
                carry.fill(0)
                for j in range(top):
                    np.take(table[:, j], pick, 0, added)
                    a = total[shift + j]
                    np.bitwise_xor(a, added, out=half)
                    np.bitwise_and(a, added, out=spare)
                    np.bitwise_xor(half, carry, out=a)
                    np.bitwise_and(half, carry, out=half)
                    np.bitwise_or(spare, half, out=carry)
                for k in range(shift + top, len(total)):
                    if not carry.any():
                        break
                    a = total[k]
                    np.bitwise_and(a, carry, out=half)
                    np.bitwise_xor(a, carry, out=a)
                    carry, half = half, carry
        return total, offset

    def top(self, total: np.ndarray, k: int, barred: np.ndarray) -> np.ndarray:
        """For each query a bitmap of the rows of the k highest scores, and of all that tie with the last of them; ``barred`` rows (a bitmap for each) take no part."""
        sure, tied = np.zeros_like(barred), self.ones & ~barred
        for s in total[::-1]:
            more = tied & s
            n = np.bitwise_count(sure).sum(1, dtype=np.int64) + np.bitwise_count(more).sum(1, dtype=np.int64)
            over = (n > k)[:, None]
            sure = np.where(over, sure, sure | more)
            tied = np.where(over, more, np.where((n == k)[:, None], np.uint64(0), tied & ~s))
        return sure | tied

    def bitmaps(self, flags: np.ndarray) -> np.ndarray:
        return np.stack([self._bits(f) for f in flags])


def block_top(ids: np.ndarray, block: SlicedBlock, query_ids: list[int], queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best rows of a block; ties go to smaller ids, rows of the query's own id don't count."""
    total, offset = block.scores(queries)
    picked = block.top(total, k, block.bitmaps(ids[None] == np.array(query_ids)[:, None]))
    out = []
    for i, q in enumerate(query_ids):
        rows = np.flatnonzero(np.unpackbits(picked[i].view(np.uint8), bitorder="little")[: block.n])
        bits = ((total[:, i][:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).tolist()
        scores = [sum(b[r] << j for j, b in enumerate(bits)) + offset[i] for r in range(len(rows))]
        best = sorted(zip((-s for s in scores), ids[rows].tolist(), strict=True))[:k]
        if any(not -(2**63) <= s < 2**63 for s, _ in best):
            raise ValueError("a score leaves 64 bits")
        out += [(q, vec, -s) for s, vec in best]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest integer inner products over all of ``vectors``.

    Both have vec_id and embedding. Vectors that are null or hold null or non-finite components take no part, nor do
    rows without an id; vectors meet those of their own length only. Values and sums are exact; what leaves 64 bits is an error. Empty vectors have no product.
    Of queries with one id one counts; candidates with the query's id are its own row. Rows that repeat are candidates each.
    Without vectors or queries there are no rows. Blocks of rows and packs of queries meet by an equi-join on the
    block's number: the queries are a stated share of the rows, a block's bytes don't grow with the table, and what is
    copied to every block are the packs, not the index."""

    def usable(df: DataFrame) -> DataFrame:
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))

    rows, asked = usable(vectors), usable(queries)
    blocks = max(1, -(-rows.count() // block_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids and quantised vectors of one length of a block, packed into one row; a partition's blocks have its number."""
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(w: int) -> pa.RecordBatch:
            own, values = (np.concatenate(x) for x in zip(*held.pop(w), strict=True))
            kind = next(t for t in ("int16", "int32", "int64") if np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max)
            place = [pa.array([x], pa.int32()) for x in (TaskContext.get().partitionId(), w)]
            cells = [pa.array([x], pa.binary()) for x in (own.tobytes(), values.astype(kind).tobytes())]
            return pa.RecordBatch.from_arrays([*place, pa.array([kind]), *cells], names=["block", "width", "kind", "ids", "values"])

        for b in batches:
            ids, size, lists = b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy(), b.column(1)
            for w in np.unique(size).tolist():
                at = np.flatnonzero(size == w)
                own, values = ids[at], quantise(lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, w))
                for lo in range(0, len(at), block_rows):
                    held.setdefault(w, []).append((own[lo : lo + block_rows], values[lo : lo + block_rows]))
                    if sum(len(p[0]) for p in held[w]) >= block_rows:
                        yield packed(w)
        for w in list(held):
            yield packed(w)

    index = rows.where(F.size("embedding") > 0).repartition(blocks).mapInArrow(lean(build), "block int, width int, kind string, ids binary, values binary")
    one = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    groups = max(1, -(-one.count() // query_rows))
    packs = one.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).groupBy("g", F.size("embedding").alias("w"))
    packs = packs.agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("q")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    meet = index.repartition(blocks, "block").join(packs.repartition(blocks, "b"), (F.col("block") == F.col("b")) & (F.col("width") == F.col("w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None
        for b in batches:
            for i in range(b.num_rows):
                key = tuple(b.column(c)[i].as_py() for c in range(3))
                if key != kept:  # rows of a block come one after the other
                    kept = key
                    ids = np.frombuffer(key[1], np.int64)
                    block = SlicedBlock(np.frombuffer(key[2], key[0]).reshape(len(ids), -1).astype(np.int64))
                asked = b.column(3)[i].as_py()
                if out := block_top(ids, block, [q["vec_id"] for q in asked], quantise(np.array([q["embedding"] for q in asked])), k):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    best = meet.select("kind", "ids", "values", "q").mapInArrow(lean(run), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda k: a.q[k] * b.q[k]))::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
