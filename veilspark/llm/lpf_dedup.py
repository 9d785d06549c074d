"""Exact removal of repeated byte strings by longest-previous-factor arrays.

A suffix array over all texts fits no machine, but two equal strings of ``length`` bytes choose the same anchor: the
least k-gram hash in them, at the same place. So window starts are dealt out by their anchor. Starts whose anchor occurs once
can't be repeated and stay where they are. The others travel with their bytes to their anchor's task, which sorts them
into suffix order (prefix doubling), finds for each start the previous and the next smaller position in suffix order,
and takes the longer of the two matches: its longest previous factor. Starts with one of ``length`` or more are later
copies; the mirror image (positions that are larger) finds those that are copied later.

Starts that follow each other and have the same anchor hash are one run, wherever that anchor stands: a periodic text
is a few runs, not one for each start. Anchors whose runs hold very many bytes don't go to one task. Their segments are
collapsed by content first, and the windows of the distinct ones are grouped by hash (128 bits) instead of by suffix
rank; the first window of a group is the only one without an earlier one, which is what its previous factor would say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import holds, lean, rows_by_bytes, stage, unstage, whole_groups

LENGTH = 200
GRAM = 40
SLICE_BYTES = 1 << 19
CHUNK_BYTES = 1 << 20
PIECE = 1 << 20  # places that are hashed at once; under 1 << _PLACE_BITS
MOST = 4096  # starts of a run; a longer run is cut
HOT = 1 << 20  # bytes of an anchor's runs from which its segments are collapsed first
_RUN = 1 << 14  # a run is one number: first start x _RUN + 2 x starts, and 1 if it has several anchors
_PLACE_BITS = 24
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
holds(__name__, _powers.clear)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams: differences of a running polynomial, shifted back to the same power."""
    size = 1 << max(16, int(len(data)).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _powers[size] = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x)]) for x in (_BASE, inverse))
    up, down = _powers[size]
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=run[1:])
    return _mix((run[k:] - run[:-k]) * down[: len(data) - k + 1])


def anchors(data: np.ndarray, lengths: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first start, number of starts, anchor hash and number of anchors of each run of window starts whose anchors have one hash, for texts laid end to end."""
    begin = np.cumsum(lengths) - lengths
    out = []
    step = PIECE  # a long text is looked at piece by piece
    w = length - k + 1
    for lo in range(0, max(len(data) - length + 1, 0), step):
        part = data[lo : lo + step + length - 1]
        h = _gram_hashes(part, k)
        v = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals
        rows = -(-len(v) // w)
        block = np.full(rows * w, ~np.uint64(0))
        block[: len(v)] = v
        block = block.reshape(rows, w)
        ahead = np.minimum.accumulate(block, 1).ravel()
        back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
        n = len(part) - length + 1
        least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
        del v, block, ahead, back
        text = np.searchsorted(begin, np.arange(lo, lo + n), side="right") - 1
        ok = np.arange(lo, lo + n) - begin[text] + length <= lengths[text]
        value = h[(least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)]
        other = np.r_[True, text[1:] != text[:-1]]
        first = np.flatnonzero((other | np.r_[True, value[1:] != value[:-1]]) & ok)
        places = (other | np.r_[True, least[1:] != least[:-1]]) & ok
        count, many = (np.add.reduceat(x, first) if len(first) else first for x in (ok, places))
        out.append((text[first], lo + first - begin[text[first]], count, value[first], many))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Ranks:
    """Ranks of all positions of a text by their first 8, 16, 32, ... bytes, up to ``depth``: prefix doubling, kept by level."""

    def __init__(self, data: np.ndarray, depth: int):
        n = len(data)
        padded = np.r_[data.astype(np.uint64), np.zeros(8, np.uint64)]
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | padded[i : i + n]
        self.levels, width = [], 8
        self.levels.append((width, self._rank(key)))
        while width < depth:
            rank, step = self.levels[-1][1], min(width, depth - width)
            key = rank.astype(np.uint64) << np.uint64(32)
            key[: n - step] |= rank[step:].astype(np.uint64) + np.uint64(1)
            self.levels.append((width + step, self._rank(key)))
            width += step

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        s = key[order]
        out = np.empty(len(key), np.uint32)
        out[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]]) if len(s) else 0
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j, up to the depth: from the longest level down. Counts whole levels, and
        is exact at the depth; below it, it is a lower bound by steps of 8."""
        depth = self.levels[-1][0]
        full = self.levels[-1][1]
        out = np.where(full[i] == full[j], depth, 0)
        for width, rank in reversed(self.levels[:-1]):
            for _ in range(2 if width == self.levels[-2][0] else 1):
                a, b = np.minimum(i + out, len(rank) - 1), np.minimum(j + out, len(rank) - 1)
                same = (out + width <= depth) & (i + out < len(rank)) & (j + out < len(rank)) & (rank[a] == rank[b])
                out = out + np.where(same, width, 0)
        return out


def smaller_before(x: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1; all places at once, by jumping along earlier answers."""
    p = np.arange(len(x)) - 1
    at = np.arange(len(x))
    while len(at := at[(p[at] >= 0) & (x[p[at]] > x[at])]):
        p[at] = p[p[at]]
    return p


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending ``starts``: the longest match with an earlier start, and with a later one (0 unless ``both``), up to ``length``.

    The suffix array of the starts is their order by rank; among equals the position decides. In that order the
    longest match with an earlier position is that with the nearest smaller position before or after it."""
    ranks = Ranks(data, length)
    by = ranks.levels[-1][1][starts]
    sa = np.lexsort((starts, by))
    position = starts[sa]

    def factor(x: np.ndarray) -> np.ndarray:
        before = smaller_before(x)
        after = len(x) - 1 - smaller_before(x[::-1])[::-1]
        best = np.zeros(len(x), np.int64)
        for other, there in ((before, before >= 0), (after, after < len(x))):
            at = np.flatnonzero(there)
            best[at] = np.maximum(best[at], ranks.common(position[at], position[other[at]]))
        return best

    earlier, later = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    earlier[sa] = factor(position)
    if both:
        later[sa] = factor(-position)
    return earlier, later


def _runs(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the bytes that windows at the ascending places ``at`` cover."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > length)
    return at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + length


# --- the distributed part ---------------------------------------------------------------------------------------------


def _texts(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """id_, text, c1, c2 (128 bits that stand for the text), and the ``carried`` columns as a struct, rest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [F.struct(*carried).alias("rest")] if carried else []
    return docs.select(F.col("doc_id").alias("id_"), text.alias("text"), *rest).withColumns({"c1": F.xxhash64("text"), "c2": F.xxhash64(F.lit(LENGTH), F.col("text"))})


def _anchor_rows(texts: DataFrame, length: int, counted: bool) -> DataFrame:
    """Anchors of every text: h, c1, c2 and run (as by _RUN); for counting h, c1, whether the text has it twice, and the bytes of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_by_bytes(batches, "text", SLICE_BYTES):
            coded = b.column(2).cast(pa.binary()).to_pylist()
            lens = np.fromiter(map(len, coded), np.int64, len(coded))
            c1, c2 = (b.column(k).to_numpy() for k in (0, 1))
            text, first, n, h, many = anchors(np.frombuffer(b"".join(coded), np.uint8), lens, length, GRAM)
            h = h.view(np.int64)
            if not counted:
                cuts = -(-n // MOST)
                text, h = np.repeat(text, cuts), np.repeat(h, cuts)
                skip = (np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * MOST
                first, n, inner = np.repeat(first, cuts) + skip, np.minimum(np.repeat(n, cuts) - skip, MOST), np.repeat(many > 1, cuts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c1[text], c2[text], first * _RUN + 2 * n + inner)], names=["h", "c1", "c2", "run"])
                continue
            order = np.lexsort((h, text))
            text, h, size, many = text[order], h[order], (n + (length - 1) * -(-n // MOST))[order], many[order]
            begin = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
            size, many = (np.add.reduceat(x, begin) if len(begin) else begin for x in (size, many))
            yield pa.RecordBatch.from_arrays([pa.array(h[begin]), pa.array(c1[text[begin]]), pa.array(many > 1), pa.array(size)], names=["h", "c1", "twice", "size"])

    return texts.select("c1", "c2", "text").mapInArrow(lean(run), "h long, c1 long, twice boolean, size long" if counted else "h long, c1 long, c2 long, run long")


def _packed(texts: DataFrame) -> DataFrame:
    """``texts`` (and what follows their first four columns) with compressed text: it's about to be shuffled."""
    names = ["id_", "c1", "c2", *[c for c in texts.columns if c not in ("id_", "c1", "c2", "text")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in rows_by_bytes(batches, "text", SLICE_BYTES):
            packed = pa.array([press.compress(t) for t in b.column(0).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], packed], names=[*names, "packed"])

    return texts.select("text", *names).mapInArrow(lean(run), texts.select(*names).withColumn("packed", F.lit(b"")).schema)


def _segments(candidates: DataFrame, length: int) -> DataFrame:
    """The bytes of each candidate run (h, c1, c2, first, start, starts, inner, hot, bytes), from rows of a text and its list of runs; inner: it may hold a window twice."""
    names = ["h", "c1", "c2", "first", "start", "starts", "inner", "hot", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in (p for b in batches for p in rows_by_bytes([b], "packed", CHUNK_BYTES // 4)):
            kinds = [pa.int64()] * 3 + [b.schema.field(0).type, pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
            packed = lambda out, kinds=kinds: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)
            out: list[list] = [[] for _ in names]
            held = 0
            for i in range(b.num_rows):
                first, c1, c2 = (b.column(k)[i].as_py() for k in range(3))
                text, runs = unpack.decompress(b.column(3)[i].as_py()), b.column(4).slice(i, 1).flatten()
                for h, place, hot in zip(*(runs.field(k).to_pylist() for k in ("h", "run", "hot")), strict=True):
                    at, n, inner = place // _RUN, place % _RUN // 2, bool(place & 1)
                    piece = text[at : at + n + length - 1]
                    held += len(piece)
                    for k, x in enumerate((h, c1, c2, first, at, n, inner, hot, piece)):
                        out[k].append(x)
                    if held > CHUNK_BYTES:
                        yield packed(out)
                        out, held = [[] for _ in names], 0
            if out[0]:
                yield packed(out)

    kind = dict(candidates.dtypes)["first"]
    return candidates.select("first", "c1", "c2", "packed", "runs").mapInArrow(lean(run), f"h long, c1 long, c2 long, first {kind}, start long, starts int, inner boolean, hot boolean, bytes binary")


def _spans_of(c1: np.ndarray, c2: np.ndarray, start: np.ndarray, starts: np.ndarray, hit: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans (c1, c2, begin, end) that the hit starts cover; hit has a flag for each start of each segment, segments in order."""
    owner = np.repeat(np.arange(len(starts)), starts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts) + start[owner]
    owner, place = owner[hit], place[hit]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (np.diff(place) > length)]) if len(owner) else owner
    last = np.r_[new[1:] - 1, len(owner) - 1] if len(owner) else owner
    o = owner[new]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (c1[o], c2[o], place[new], place[last] + length)], names=["c1", "c2", "begin", "end"])


SPANS = "c1 long, c2 long, begin long, end long"


def _usual_spans(segments: DataFrame, length: int, keep_first: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (part for b in batches for part in rows_by_bytes([b], "bytes", CHUNK_BYTES // 2))
        for t in whole_groups(small, ["h"], 1500, CHUNK_BYTES // 2):
            t = t.sort_by([("first", "ascending"), ("c1", "ascending"), ("c2", "ascending"), ("start", "ascending")])
            c1, c2, start, starts = (t.column(k).to_numpy() for k in ("c1", "c2", "start", "starts"))
            again = np.r_[False, (np.diff(c1) == 0) & (np.diff(c2) == 0) & (np.diff(start) == 0)]  # of rows that repeat
            pieces, h, inner = t.column("bytes").to_pylist(), t.column("h").to_numpy(), t.column("inner").to_numpy()
            if again.any():
                keep = np.flatnonzero(~again)
                h, c1, c2, start, starts, inner, pieces = h[keep], c1[keep], c2[keep], start[keep], starts[keep], inner[keep], [pieces[k] for k in keep]
            starts = starts.astype(np.int64)
            # Segments that are equal as a whole need no sorting: the first stands for them. Nor does an anchor's only kind, unless it may repeat in itself.
            seen: dict[bytes, int] = {}
            rep = np.array([seen.setdefault(p, i) for i, p in enumerate(pieces)])
            kinds = np.flatnonzero(rep == np.arange(len(rep)))
            _, of, many = np.unique(h[kinds], return_inverse=True, return_counts=True)
            rest = kinds[(many[of] > 1) | inner[kinds]]
            copied = rep != np.arange(len(rep)) if keep_first else np.bincount(rep, minlength=len(rep))[rep] > 1
            hit = np.repeat(copied, starts)
            if len(rest):
                data = np.frombuffer(b"".join([pieces[i] for i in rest]), np.uint8)
                n, sizes = starts[rest], starts[rest] + length - 1
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                earlier, later = previous_factors(data, np.repeat(np.cumsum(sizes) - sizes, n) + within, length, not keep_first)
                hit[np.repeat((np.cumsum(starts) - starts)[rest], n) + within] |= (earlier >= length) | (later >= length)
            yield _spans_of(c1, c2, start, starts, hit, length)

    return segments.where("NOT hot").drop("hot").repartition("h").sortWithinPartitions("h").mapInArrow(lean(run), SPANS)


def _hot_spans(segments: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for anchors with very many occurrences, whatever their number: segments are collapsed, windows of the distinct ones counted."""
    order = F.struct(F.col("first").isNull().alias("none"), "first", "c1", "c2", "start")
    hot = segments.where("hot").withColumn("s", F.sha2("bytes", 256)).select("s", "starts", "bytes", order.alias("o")).distinct()
    kinds = hot.groupBy("s", "starts", "bytes").agg(F.count("*").alias("n"), F.min("o").alias("o"))  # all with one s are alike

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, starts, pieces, n, o = (b.column(k) for k in range(5))
            for i, (count, piece) in enumerate(zip(starts.to_pylist(), pieces.to_pylist(), strict=True)):
                names = [xxhash.xxh3_128_hexdigest(piece[k : k + length]) for k in range(count)]
                at = pa.array(np.full(count, i))
                yield pa.RecordBatch.from_arrays([pa.array(names), s.take(at), pa.array(np.arange(count), pa.int32()), n.take(at), o.take(at)], names=["w", "s", "k", "n", "o"])

    o_type = dict(hot.dtypes)["o"]
    each = kinds.mapInArrow(lean(windows), f"w string, s string, k int, n long, o {o_type}")
    at = F.struct("o.none", "o.first", "o.c1", "o.c2", (F.col("o.start") + F.col("k")).alias("start"))
    # written first, so that the join can split a window that stands in very many segments
    total = each.groupBy(F.col("w").alias("w_")).agg(F.sum("n").alias("total"), F.min(at).alias("least")).where("total > 1")
    each = each.join(stage(total, "totals"), F.col("w") == F.col("w_"))
    # of the first occurrence of a segment: its windows that are repeated
    masks = (each.where(~F.col("least").eqNullSafe(at)) if keep_first else each).groupBy(F.col("s").alias("s_")).agg(F.sort_array(F.collect_list("k")).alias("ks"))
    places = kinds.select("s", "n", F.col("o").alias("least")).join(masks, F.col("s") == F.col("s_"), "left").drop("s_").withColumnRenamed("s", "t")
    places = stage(places, "places")  # so that the join can split a segment that stands in very many places
    every = hot.drop("bytes").join(places, F.col("s") == F.col("t"))
    copied = (F.col("n") > 1) & ~F.col("o").eqNullSafe(F.col("least")) if keep_first else F.col("n") > 1
    hit = F.when(copied, F.sequence(F.lit(0), F.col("starts") - 1)).otherwise(F.coalesce("ks", F.array().cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c1, c2, start, starts = (b.column(k).to_numpy().astype(np.int64) for k in range(4))
            hits = b.column(4)
            flags = np.zeros(starts.sum(), bool)
            of = np.repeat(np.arange(len(hits)), _list_lengths(hits))
            flags[(np.cumsum(starts) - starts)[of] + hits.flatten().to_numpy()] = True
            yield _spans_of(c1, c2, start, starts, flags, length)

    return every.select("o.c1", "o.c2", "o.start", "starts", hit.alias("hit")).mapInArrow(lean(run), SPANS)


def _list_lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, hot: int = HOT) -> DataFrame:
    """For each text of ``docs`` by k1 and k2 (c1 and c2 of _texts()): first id, copies (rows) and removed spans.

    Spans are for one row of the text; of equal texts of ``length`` bytes or more all other rows go whole."""
    texts = _texts(docs)
    counts = _anchor_rows(texts, length, True).groupBy("h").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi"), F.max("twice").alias("twice"), F.sum("size").alias("size"))
    # written first: a join of two plain shuffles is one whose hot keys can be split
    counts = stage(counts.where("twice OR lo <> hi").select(F.col("h").alias("h_"), (F.col("size") > hot).alias("hot")), "anchors")
    runs = _anchor_rows(texts, length, False)
    runs = runs.join(counts, runs.h == counts.h_).groupBy("c1", "c2").agg(F.collect_set(F.struct("h", "run", "hot")).alias("runs"))
    classes = texts.groupBy("c1", "c2").agg(F.min("id_").alias("first"), F.count("*").alias("copies"))
    packed = _packed(texts)
    picked = classes.join(runs, ["c1", "c2"]).select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "first", "runs")
    picked = packed.join(picked, (packed.c1 == F.col("k1")) & (packed.c2 == F.col("k2")) & packed.id_.eqNullSafe(F.col("first")))
    segments = stage(_segments(picked, length), "segments")
    found = _usual_spans(segments, length, keep_first).union(_hot_spans(segments, length, keep_first))
    found = found.groupBy("c1", "c2").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    out = stage(classes.join(found, ["c1", "c2"], "left").select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "first", "copies", "spans"), "spans")
    unstage(counts, segments)
    return out


def _mask(n: int, found: list[dict] | None) -> np.ndarray:
    """Flags of the n bytes that are in a span."""
    delta = np.zeros(n + 1, np.int64)
    if found:
        np.add.at(delta, [s["begin"] for s in found], 1)
        np.add.at(delta, [s["end"] for s in found], -1)
    return np.cumsum(delta)[:n] > 0


def repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) for every row of ``docs``.

    A byte is removed if a string of ``length`` bytes that covers it occurs earlier (by doc_id, then place;
    ``keep_first``) or anywhere else (otherwise). Texts are UTF-8 bytes; a null text is empty; matches never cross
    texts; texts shorter than ``length`` stay whole. Null ids come last. With ``keep_first``, rows that repeat
    with the first id and text of their class are all taken for the first one. Other columns don't matter."""
    rows = _marked(docs, [], length, keep_first, hot)
    kind = dict(rows.dtypes)["id_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small(batches):
            out = []
            for text, mask in _masked(part, length):
                n_spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if n_spans else text
                out.append((len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(3), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("packed", "spans", "gone", "id_").mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _marked(docs: DataFrame, carried: list[str], length: int, keep_first: bool, hot: int) -> DataFrame:
    """id_, packed, spans, gone (the whole text goes, if it is long enough) and rest (a struct of the ``carried`` columns) of every row."""
    known = spans(docs, length, keep_first, hot)
    texts = _texts(docs, carried)
    packed = _packed(texts)
    whole = F.col("copies") > 1
    if keep_first:
        whole = whole & ~F.col("id_").eqNullSafe(F.col("first"))
    rows = packed.join(known, (packed.c1 == known.k1) & (packed.c2 == known.k2))
    return rows.withColumn("gone", whole)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (p for b in batches for p in rows_by_bytes([b], "packed", SLICE_BYTES // 4))


def _masked(part: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Text and flags of the removed bytes, from columns packed, spans and gone."""
    unpack = zstandard.ZstdDecompressor()
    for packed, found, gone in zip(*(part.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
        text = unpack.decompress(packed)
        yield text, np.ones(len(text), bool) if gone and len(text) >= length else _mask(len(text), found)


def whole_letters(text: bytes, mask: np.ndarray) -> np.ndarray:
    """``mask`` without letters of which only some bytes are removed."""
    if text.isascii() or not mask.any():
        return mask
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.logical_and.reduceat(mask, np.flatnonzero(first))[np.cumsum(first) - 1]


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs`` with later copies of repeated strings cut out of the texts; all columns and rows stay.

    As repeats(), but letters go whole or not at all, so that texts stay UTF-8. A null text comes back empty; a text
    that is all copies too. A column n_chars is set to the new length."""
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = _marked(docs, carried, length, True, hot)
    out = rows.select(F.col("id_").alias("doc_id"), F.lit("").alias("text"), *(["rest"] if carried else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small(batches):
            texts = [np.frombuffer(text, np.uint8)[~whole_letters(text, mask)].tobytes() if mask.any() else text for text, mask in _masked(part, length)]
            yield pa.RecordBatch.from_arrays([part.column(3), pa.array(texts, pa.binary()).cast(pa.string()), *part.columns[4:]], names=["doc_id", "text", *(["rest"] if carried else [])])

    cut = rows.select("packed", "spans", "gone", "id_", *(["rest"] if carried else [])).mapInArrow(lean(run), out)
    columns = [F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns]
    cut = cut.select(*columns)
    return cut.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cut
