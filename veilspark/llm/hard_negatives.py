"""Hard negatives by distributed radix selection.

For each anchor and positive there is a window of scores. The kth best row of a window is found without sorting or
moving rows: each block of vectors counts its scores in the window by their leading binary digits, the blocks' histograms
are added up, the bucket that holds the kth row becomes the next range, and the next digits are counted in it alone.
Rows that tie at the last score are told apart by the digits of their ids in the same way. In the end each window has a
bound, and only rows within it are gathered. Positives are selected likewise, from a window of all scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import lean, stage, unstage

SCALE = 256
BLOCK = 16384  # rows of a block of vectors
BLOCK_CELLS = 1 << 22  # components of a block, at most
BATCH = 2048  # rows that a task sends together
ANCHORS = 64  # anchors that go to a block together
DIGITS = 16  # binary digits that a round counts
LEAST, MOST = -(2**63), 2**63 - 1

#: A window: ranks ``need`` more rows of its label (or of another) from ``hi`` down; all from ``top`` down to ``hi`` are in.
STATE = "anchor long, positive long, positive_score long, same boolean, top long, lo long, hi long, by_id boolean, id_lo long, id_hi long, need long, settled boolean"
FIELDS = [f.split()[0] for f in STATE.split(", ")]


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as whole numbers, held as doubles."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(vectors * SCALE))


def scores(anchors: np.ndarray, rows: np.ndarray, most_in_rows: float) -> np.ndarray:
    """Exact inner products of whole numbers (held as doubles); what leaves 64 bits is the nearest that doesn't."""
    most = float(np.abs(anchors).max(initial=0)) * most_in_rows * max(1, rows.shape[1])
    if most < 2**52:
        return (anchors @ rows.T).astype(np.int64)
    if most < 2**62:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(anchors) @ whole(rows).T, LEAST, MOST).astype(np.int64)


def shift_of(lo: int, hi: int, digits: int) -> int:
    """How many low digits a round leaves out so that lo to hi make 2**digits buckets at most."""
    return max(0, (hi - lo).bit_length() - digits)


def histogram(values: np.ndarray, lo: int, hi: int, need: int, digits: int, upwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Buckets from the best one on, and their counts, of the values from lo to hi; the best value is hi, or lo if ``upwards``.

    Buckets behind the one in which the block's own count reaches ``need`` can't hold the row that is looked for and are left out."""
    inside = values[(values >= lo) & (values <= hi)]
    from_best = inside.view(np.uint64) - np.uint64(lo % 2**64) if upwards else np.uint64(hi % 2**64) - inside.view(np.uint64)
    found, counts = np.unique((from_best >> np.uint64(shift_of(lo, hi, digits))).astype(np.int64), return_counts=True)
    enough = int(np.searchsorted(np.cumsum(counts), need)) + 1
    return found[:enough], counts[:enough]


def foremost(ordered: np.ndarray, lo: int, hi: int, need: int, digits: int) -> np.ndarray:
    """Of scores in rising order those in the window whose buckets histogram() doesn't leave out."""
    first, last = np.searchsorted(ordered, lo, "left"), np.searchsorted(ordered, hi, "right")
    if last - first > need:
        size = 1 << shift_of(lo, hi, digits)
        bucket = (hi - int(ordered[last - need])) // size  # of the row that ranks ``need``
        first = np.searchsorted(ordered, max(lo, hi - (bucket + 1) * size + 1), "left")
    return ordered[first:last]


def located(state: dict, buckets: list[tuple[int, int]], digits: int, ids: tuple[int, int]) -> dict:
    """The window after a round, from the sums over all blocks."""
    lo, hi, need = (state["id_lo"], state["id_hi"], state["need"]) if state["by_id"] else (state["lo"], state["hi"], state["need"])
    size = 1 << shift_of(lo, hi, digits)
    for bucket, n in sorted(buckets):
        if n >= need:
            break
        need -= n
    else:  # the range holds too few rows: all of it is in
        return state | {"settled": True}
    if state["by_id"]:
        first = lo + bucket * size
        last = min(hi, first + size - 1)
        return state | {"id_lo": first, "id_hi": last, "need": need, "settled": n == need or first == last}
    last = hi - bucket * size
    first = max(lo, last - size + 1)
    out = state | {"lo": first, "hi": last, "need": need, "settled": n == need}
    if n > need and first == last:  # ties of one score: go on by id
        out |= {"by_id": True, "id_lo": ids[0], "id_hi": ids[1], "settled": ids[0] == ids[1]}
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part, once the labels of ids divisible by 7 have moved on by one."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite & (F.size("embedding") > 0))
    label, vec = F.col("label").cast("long"), F.col("vec_id").cast("long")
    return rows.select(vec.alias("vec_id"), F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def _kind(values: np.ndarray) -> str:
    """The narrowest form that holds the whole numbers."""
    return next((t for t in ("int16", "int32") if np.abs(values).max() <= np.iinfo(t).max), "float64")


#: Whole numbers of a window as it travels with its pack: the anchor's place in the pack, whether there is a positive, and its state.
WINDOW = ["place", "paired", *[f for f in FIELDS if f not in ("anchor", "settled")]]
SAME, TOP, LO, HI, BY_ID, ID_LO, ID_HI, NEED = (WINDOW.index(f) for f in ("same", "top", "lo", "hi", "by_id", "id_lo", "id_hi", "need"))


class VectorBlocks:
    """All rows as staged blocks of quantised vectors, ready to meet packs of anchors."""

    FORM = "block int, width int, pack int, kind string, ids binary, labels binary, values binary, windows binary"

    def __init__(self, rows: DataFrame, block_rows: int):
        n, low, high, width = rows.agg(F.count("*"), F.min("vec_id"), F.max("vec_id"), F.max(F.size("embedding"))).first()
        self.rows, self.ids, self.blocks = n, (low or 0, high or 0), max(1, -(-n // min(block_rows, max(1, BLOCK_CELLS // (width or 1)))))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
            for b in batches:
                ids, labels, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
                size = lists.value_lengths().to_numpy()
                for w in np.unique(size).tolist():
                    at = np.flatnonzero(size == w)
                    held.setdefault(w, []).append((ids[at], labels[at], quantised(lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, w))))
            part = TaskContext.get().partitionId()
            for w in list(held):
                ids, labels, values = (np.concatenate(x) for x in zip(*held.pop(w), strict=True))
                yield _row(part, w, -1, ids, labels, values, None)

        self.index = stage(rows.repartition(self.blocks).mapInArrow(lean(build), self.FORM), "vector-blocks")

    def met(self, anchors: DataFrame, windows: DataFrame, per_pack: int) -> DataFrame:
        """FORM: in each partition a block's vectors, a row for each width, which are followed by all packs of anchors with their windows.

        So a round sends each vector once, to the JVM's workers too, and the anchors once for each block."""
        packs = max(1, -(-windows.select("anchor").distinct().count() // per_pack))
        by_anchor = windows.groupBy("anchor").agg(F.collect_list(F.struct(*[c for c in FIELDS if c != "anchor"])).alias("windows"))  # at most as many as it has positives
        both = by_anchor.join(anchors, by_anchor.anchor == anchors.vec_id).withColumn("pack", F.pmod(F.xxhash64("anchor"), F.lit(packs)))
        packed = both.groupBy("pack", F.size("embedding").alias("w")).agg(F.collect_list(F.struct("anchor", "label", "embedding", "windows")).alias("asked"))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    pack, width, asked = (b.column(c)[i].as_py() for c in range(3))
                    cells = [[at, w["positive"] is not None, *[w[f] or 0 for f in WINDOW[2:]]] for at, a in enumerate(asked) for w in a["windows"]]
                    ids, labels = (np.array([a[f] for a in asked], np.int64) for f in ("anchor", "label"))
                    yield _row(0, width, pack, ids, labels, quantised(np.array([a["embedding"] for a in asked])), np.array(cells, np.int64))

        copies = packed.select("pack", "w", "asked").mapInArrow(lean(encode), self.FORM).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        return self.index.unionByName(copies).repartitionById(self.blocks, F.col("block")).sortWithinPartitions("block", "width", "pack")


def _row(block: int, width: int, pack: int, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, windows: np.ndarray | None) -> pa.RecordBatch:
    kind, cell = _kind(values), lambda x: pa.array([None if x is None else x.tobytes()], pa.binary())
    numbers = [pa.array([x], pa.int32()) for x in (block, width, pack)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array([kind]), cell(ids), cell(labels), cell(values.astype(kind)), cell(windows)], names=[f.split()[0] for f in VectorBlocks.FORM.split(", ")])


def _cells(batches: Iterator[pa.RecordBatch], upper: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each anchor and its windows of a kind (WINDOW), with the ids and scores of the block's rows that may be in one, up to its ``upper``."""
    kept = ids = labels = block = None
    for b in batches:
        for i in range(b.num_rows):
            number, width, pack, kind, own, marks, values = (b.column(c)[i].as_py() for c in range(7))
            read = lambda: np.frombuffer(values, kind).reshape(-1, width).astype(np.float64)  # noqa: B023, E731
            if pack < 0:
                kept, ids, labels, block = (number, width), np.frombuffer(own, np.int64), np.frombuffer(marks, np.int64), read()
                most = float(np.abs(block).max(initial=0))
            elif kept == (number, width):
                found = scores(read(), block, most)
                windows = np.frombuffer(b.column(7)[i].as_py(), np.int64).reshape(-1, len(WINDOW))
                begins = np.searchsorted(windows[:, 0], np.arange(len(found) + 1))
                for k, (a, mark) in enumerate(zip(np.frombuffer(own, np.int64).tolist(), np.frombuffer(marks, np.int64).tolist(), strict=True)):
                    mine, s = windows[begins[k] : begins[k + 1]], found[k]
                    for same in np.unique(mine[:, SAME]).tolist():
                        w = mine[mine[:, SAME] == same]
                        inside = (s >= w[:, LO].min()) & (s <= w[:, upper].max())
                        inside &= (labels == mark) & (ids != a) if same else labels != mark
                        yield a, w, ids[inside], s[inside]


class _Out:
    """Rows that are held until there is a batch of them."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def batch(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
            self.rows = []


def select(blocks: VectorBlocks, anchors: DataFrame, windows: DataFrame, k: int, per_pack: int = ANCHORS, digits: int = DIGITS) -> DataFrame:
    """anchor, positive, positive_score, rank, vec_id and score of the first k rows of every window (STATE)."""
    state, id_range = stage(windows, "windows"), blocks.ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(pa.schema([("a", pa.int64()), ("p", pa.int64()), ("bucket", pa.binary()), ("n", pa.binary())]))
        for a, windows, ids, s in _cells(batches, HI):
            ordered = np.sort(s)
            for w in windows.tolist():
                if w[BY_ID]:
                    found, n = histogram(ids[s == w[HI]], w[ID_LO], w[ID_HI], w[NEED], digits, True)
                else:
                    found, n = histogram(foremost(ordered, w[LO], w[HI], w[NEED], digits), w[LO], w[HI], w[NEED], digits, False)
                if len(found):
                    out.rows.append((a, w[2] if w[1] else None, found.astype(np.int64).tobytes(), n.astype(np.int64).tobytes()))
            yield from out.batch(BATCH)
        yield from out.batch()

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                bucket, n = (np.frombuffer(b"".join(x[f] for x in r["buckets"] or []), np.int64) for f in ("bucket", "n"))
                bucket, of = np.unique(bucket, return_inverse=True)
                sums = np.zeros(len(bucket), np.int64)
                np.add.at(sums, of, n)
                out.append(located({f: r[f] for f in FIELDS}, list(zip(bucket.tolist(), sums.tolist(), strict=True)), digits, id_range))
            yield pa.RecordBatch.from_pylist(out, schema=b.schema.remove(b.schema.get_field_index("buckets")))

    while not state.where("NOT settled").isEmpty():
        open_ = state.where("NOT settled")
        counts = blocks.met(anchors, open_, per_pack).mapInArrow(lean(count), "a long, p long, bucket binary, n binary")
        sums = counts.groupBy("a", "p").agg(F.collect_list(F.struct("bucket", "n")).alias("buckets"))  # one a block, of k counts at most
        moved = open_.join(sums, (F.col("a") == F.col("anchor")) & F.col("p").eqNullSafe(F.col("positive")), "left").select(*FIELDS, "buckets").mapInArrow(lean(advance), STATE)
        old, state = state, stage(state.where("settled").unionByName(moved), "windows")
        unstage(old)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(pa.schema([(f, pa.int64()) for f in ("anchor", "positive", "positive_score", "vec_id", "score")]))
        for a, windows, ids, s in _cells(batches, TOP):
            for w in windows.tolist():
                within = (s >= w[LO]) & (s <= w[TOP])
                if w[BY_ID]:
                    within &= (s > w[LO]) | (ids <= w[ID_HI])
                key = (a, w[2], w[3]) if w[1] else (a, None, None)
                out.rows += [(*key, *x) for x in zip(ids[within].tolist(), s[within].tolist(), strict=True)]
                yield from out.batch(BATCH)
        yield from out.batch()

    found = blocks.met(anchors, state, per_pack).mapInArrow(lean(gather), "anchor long, positive long, positive_score long, vec_id long, score long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id")
    out = stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "selected")  # rows that share the last id are one too many
    unstage(state)
    return out


def hard_negatives(vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", positives: int = 5, k: int = 10, low: int = 30, high: int = 90, block_rows: int = BLOCK, per_pack: int = ANCHORS, digits: int = DIGITS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: each anchor's first ``positives`` rows of
    its label, and for each of these the first ``k`` rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.

    ``vectors``: vec_id, embedding, label; other columns don't matter. Rows with a null among these, or with a component
    that is null or not finite, take no part, nor do empty vectors. Vectors meet those of their own length only. Higher
    scores come first, ties by smaller ids. Rows with the anchor's id aren't its positives; of anchors with one id one
    counts (the least label and vector); rows that repeat are selected each. Scores are exact; one beyond 64 bits counts
    as the nearest within. An empty table gives no rows. The result is a staged table of ``k`` rows a window at most.

    Anchors meet all rows in blocks: a round sends each block's vectors once and the anchors once for each block. What it sends back is at most k counts
    a block and window, whatever a window or a tie holds, so that a vector which a third of the rows share costs no more."""
    rows = usable(vectors)
    anchors = stage(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("a")).select("vec_id", "a.label", "a.embedding"), "anchors")
    blocks = VectorBlocks(rows, block_rows)

    def window(same: bool, need: int, **values) -> list:
        base = {"positive": None, "positive_score": None, "same": same, "by_id": False, "id_lo": None, "id_hi": None, "need": need, "settled": False} | values
        kinds = dict(f.split() for f in STATE.split(", "))
        return [F.col("anchor") if f == "anchor" else (base[f] if not isinstance(base[f], (int, bool, type(None))) else F.lit(base[f])).cast(kinds[f]).alias(f) for f in FIELDS]

    bound = _reach(anchors, rows)
    first = anchors.withColumn("anchor", F.col("vec_id")).select(*window(True, positives, top=bound, lo=-bound, hi=bound))
    chosen = select(blocks, anchors, first, positives, per_pack, digits)
    score = F.col("score").cast("decimal(20,0)")
    lo, hi = F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")
    windows = chosen.groupBy("anchor", "vec_id").agg(F.max("score").alias("score")).where(lo <= hi)  # an id that repeats among the positives has one window
    windows = windows.select(*window(False, k, positive=F.col("vec_id"), positive_score=F.col("score"), top=hi, lo=lo, hi=hi))
    found = select(blocks, anchors, windows, k, per_pack, digits)
    unstage(chosen, anchors, blocks.index)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _reach(anchors: DataFrame, rows: DataFrame) -> int:
    """A bound of all scores' sizes."""
    most = lambda df: df.agg(F.max(F.array_max(F.transform("embedding", F.abs))), F.max(F.size("embedding"))).first()
    (a, _), (x, n) = most(anchors), most(rows)
    if a is None or x is None:
        return 0
    return min(MOST, int(min(a, 1e300) * SCALE + 1) * int(min(x, 1e300) * SCALE + 1) * n)


ORACLE_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.q) + 1), lambda k: a.q[k] * b.q[k]))::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.p, p.ps, s.b, s.score, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.b)::INTEGER AS rank FROM p JOIN s ON p.a = s.a AND NOT s.same WHERE 30 * ps <= 100 * score AND 100 * score <= 90 * ps)
SELECT a AS anchor_id, p AS positive_id, rank, b AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= 10
"""
