"""N-gram Jaccard self-join by MinHash banding.

Texts are sets of word five-grams. Equal texts form a class and are sketched as one. Each class is dealt out on the hashes of its
MinHash bands; within a bucket, classes whose sketches agree well enough with that of the bucket's representative are
linked to it, and only the others are compared with the whole bucket, in blocks. The components of these links are
then verified: every pair inside one is compared on its full sets, and each class gets the number of rows it is linked
to and a spanning forest of the true links. A component is cut into blocks of a bounded number of texts and bytes; a
task compares two blocks, part by part. Texts travel only if a filter says that they may be in such a component,
compressed, once for each block of their component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import KeyFilter, fresh, group_starts, lean, rows_by_bytes, stage, unstage, whole_groups
from veilspark.llm.components import components

WIDTH = 5
THRESHOLD = (4, 5)  # of 0.8, as a fraction: sets are compared in whole numbers
RECALL = 0.9995
MOST_HASHES = 64
BLOCK = 512  # sketches of a block in a bucket, and texts that are compared at once
WIDE = 2048  # texts of a block of a component, about; a cell of the grid compares two blocks
WIDE_BYTES = 16 << 20  # of its texts, about; a longer text is more
SLICE_BYTES = 2 << 20
CACHE_WORDS = 150_000
_M = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows with which a pair at the threshold shares a band with probability ``recall``, in ``most`` hashes."""
    for rows in range(most, 0, -1):
        p = threshold**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach that recall")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """64-bit hashes of word n-grams of many texts at once."""

    def __init__(self, width: int = WIDTH):
        self.width, self.cache = width, {}

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams, text after text, and how many each text has.

        Words are what stands between ASCII white space, A-Z in lower case. A text of fewer words than the width has
        one n-gram, of all its words; without words it has none."""
        words = [(t or b"").lower().split() for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for w in set(flat).difference(self.cache):
            self.cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.cache.__getitem__, flat), np.uint64, len(flat))
        count = np.where(n >= self.width, n - self.width + 1, np.minimum(n, 1))
        begin = np.cumsum(n) - n
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        end = np.repeat(begin + n, count)
        out = np.zeros(len(at), np.uint64)
        for k in range(self.width):  # places beyond a short text's end count as no word
            i = at + k
            word = np.where(i < end, h[np.minimum(i, max(len(h) - 1, 0))] if len(h) else out, np.uint64(k))
            out = out * _M + word
        return _mix(out), count


def _sets(shingler: Shingler, texts: list[bytes | None]) -> list[np.ndarray]:
    h, n = shingler(texts)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])] if len(n) else []


def _sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """class, keys (hashes of the bands) and sketch (a byte of each MinHash) of every row whose text has words."""
    multipliers = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in rows_by_bytes(batches, "text", SLICE_BYTES):
            h, n = shingle(b.column(1).cast(pa.binary()).to_pylist())
            some = np.flatnonzero(n)
            if not len(some):
                continue
            starts = (np.cumsum(n) - n)[some]
            least = np.stack([np.minimum.reduceat(h * m, starts) for m in multipliers], 1)
            keys = np.zeros((len(some), bands), np.uint64)
            for k in range(rows):
                keys = _mix(keys * _M + least[:, k::rows])
            sketch = (_mix(least) >> np.uint64(56)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), lists, pa.array([r.tobytes() for r in sketch], pa.binary())], names=["class", "keys", "sketch"])

    return docs.select("class", "text").mapInArrow(lean(run), "class binary, keys array<long>, sketch binary")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def _bytes_of(sketches: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(sketches), -1)


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _likely(table: pa.Table, least: int) -> pa.RecordBatch:
    """Edges of a spanning forest over the pairs of a cell whose sketches agree in ``least`` bytes: of each ``far`` row with all rows that are not."""
    names, far = table.column("class").to_pylist(), np.array(table.column("far").to_pylist())
    s = _bytes_of(table.column("sketch"))
    starts = group_starts(table, ["bucket", "i", "j"])
    out: list[tuple[bytes, bytes]] = []
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        rest, block = np.flatnonzero(far[lo:hi]) + lo, np.flatnonzero(~far[lo:hi]) + lo
        if not len(rest) or not len(block):
            continue
        number: dict[bytes, int] = {}  # a class may stand on both sides
        of = np.array([number.setdefault(names[k], len(number)) for k in range(lo, hi)])
        a, b = [], []
        for x in rest:
            y = block[(s[block] == s[x]).sum(1) >= least]
            a.append(np.full(len(y), of[x - lo])), b.append(of[y - lo])
        words = list(number)
        root = _forest(len(words), np.concatenate(a), np.concatenate(b))
        out += [(words[k], words[root[k]]) for k in np.flatnonzero(root != np.arange(len(words)))]
    return _edges(out)


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _likely_edges(sketches: DataFrame, least: int) -> DataFrame:
    """Edges a and b of a forest over the classes that share a bucket and agree in ``least`` bytes of their sketches."""
    buckets = sketches.select("class", "sketch", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "class", "sketch")
    shared = stage(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    rows = KeyFilter(shared, "bucket").hits(buckets, "bucket")  # buckets of one class, nearly all, go no further
    heads = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct("class", "sketch")).alias("head")).where("members > 1")
    # written first: a join of two plain shuffles is one whose hot keys can be split
    heads = stage(heads.select(F.col("bucket").alias("b_"), "members", "head"), "heads")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_bytes_of(b.column(3)) == _bytes_of(b.column(5))).sum(1) >= least
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(near)], names=["bucket", "members", "class", "sketch", "head", "near"])

    form = "bucket long, members long, class binary, sketch binary, head binary, near boolean"
    compared = rows.join(heads, rows.bucket == heads.b_).select("bucket", "members", "class", "sketch", F.col("head.class").alias("head"), F.col("head.sketch").alias("head_sketch"))
    compared = stage(compared.mapInArrow(lean(compare), form), "compared")
    # A class that isn't near the head may be near any other of its bucket. There are few such, or few rows in the bucket.
    far = compared.where("NOT near AND members > 2")
    some = stage(far.groupBy(F.col("bucket").alias("b_")).agg(F.count("*").alias("n_far")), "far")
    wide, high = _blocks(F.col("members")), _blocks(F.col("n_far"))
    columns = ["bucket", "i", "j", "far", "class", "sketch"]
    number = lambda n: F.pmod(F.xxhash64("class", n), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = far.join(some, far.bucket == some.b_).withColumns({"j": number(high), "far": F.lit(True)}).withColumn("i", every(wide)).select(*columns)
    right = compared.join(some, compared.bucket == some.b_).withColumns({"i": number(wide), "far": F.lit(False)}).withColumn("j", every(high)).select(*columns)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket", "i", "j"]):
            yield _likely(t, least)

    cells = left.union(right).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    out = stage(compared.where("near").select(F.col("class").alias("a"), F.col("head").alias("b")).where("a <> b").union(cells.mapInArrow(lean(likely), "a binary, b binary")), "likely")
    unstage(shared, heads, compared, some)
    return out


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the intersections of ``left``'s sets with ``right``'s."""
    out = np.zeros((len(left), len(right)), np.int64)
    flat, owner = (np.concatenate(x) for x in (left + right, [np.full(len(x), k) for k, x in enumerate(left + right)]))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]][: len(flat)]
    column, on_right = np.cumsum(new) - 1, owner >= len(left)
    seen = [np.bincount(column[on_right == side], minlength=new.sum()) > 0 for side in (False, True)]
    both = seen[0] & seen[1]  # what only one side has is in no intersection
    pick = both[column]
    column, owner, on_right = (np.cumsum(both) - 1)[column[pick]], owner[pick], on_right[pick]
    width = 4096
    for lo in range(0, int(both.sum()), width):
        at = slice(*np.searchsorted(column, (lo, lo + width)))
        sides = []
        for side, rows in ((False, len(left)), (True, len(right))):
            mine = on_right[at] == side
            m = np.zeros((rows, width), np.float32)
            m[owner[at][mine] - len(left) * side, column[at][mine] - lo] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _verified(sets: list[np.ndarray], own: np.ndarray, weights: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For the classes of a cell: rows linked to each, and the least class (by place) of its component.

    Of a cell of one block, all pairs; of a cell of two, those that cross: others belong to each block's own cell. Parts of BLOCK
    classes are compared at a time, so that memory follows the parts."""
    size = np.array([len(x) for x in sets])
    links, a, b = np.zeros(len(sets), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    blocks = [np.flatnonzero(own == k) for k in np.unique(own)]
    parts = [[x[k : k + BLOCK] for k in range(0, len(x), BLOCK)] for x in (blocks[0], blocks[-1])]
    for p, left in enumerate(parts[0]):
        for right in parts[1][p if len(blocks) == 1 else 0 :]:
            both = shared_counts([sets[k] for k in left], [sets[k] for k in right])
            near = both * threshold[1] >= (size[left][:, None] + size[right][None] - both) * threshold[0]
            same = left[0] == right[0]
            if same:
                np.fill_diagonal(near, False)
            links[left] += near @ weights[right]
            if not same:
                links[right] += weights[left] @ near
            x, y = np.nonzero(near)
            root = _forest(len(left) + len(right), x, y + len(left))
            place = np.r_[left, right]
            linked = np.flatnonzero(root != np.arange(len(root)))
            a += [place[linked]]
            b += [place[root[linked]]]
    return links, _forest(len(sets), np.concatenate(a), np.concatenate(b))


def _class(text: str) -> Column:
    """What stands for a text (null is the empty one)."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _packed(rows: DataFrame) -> DataFrame:
    """class and compressed text: it is about to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in rows_by_bytes(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(t) for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["class", "packed"])

    return rows.select("class", "text").mapInArrow(lean(run), "class binary, packed binary")


def _unpacked(shingle: Shingler, unpack: zstandard.ZstdDecompressor, packed: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of compressed texts, of which about SLICE_BYTES are held as words at a time."""
    sets, held, n = [], [], 0
    for x in packed:
        held.append(unpack.decompress(x.as_py()))
        n += len(held[-1])
        if n >= SLICE_BYTES:
            sets += _sets(shingle, held)
            held, n = [], 0
    return sets + _sets(shingle, held)


def links(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """For each class of equal texts with a partner of another text: class, links (rows linked to it) and component (least class).

    ``docs`` has id_, text and class (of _class())."""
    bands, rows = bands_for(threshold[0] / threshold[1])
    share = threshold[0] / threshold[1]
    hashes = bands * rows
    # a pair at the threshold agrees in fewer bytes once in some ten thousand cases at most, given that it shares a band
    least = math.floor(hashes * share - 4 * math.sqrt(hashes * share * (1 - share)))
    sketches = stage(_sketches(docs, bands, rows).distinct(), "sketches")
    edges = _likely_edges(sketches, least)
    maybe = components(edges)
    unstage(sketches, edges)
    known = KeyFilter(maybe, "node")
    classes = known.hits(docs.select("class", "id_", F.octet_length("text").alias("bytes")), "class").groupBy(F.col("class").alias("c_")).agg(F.min("id_").alias("first"), F.count("*").alias("size"), F.max("bytes").alias("bytes"))
    members = stage(maybe.join(classes, F.col("node") == F.col("c_")).select(F.col("node").alias("class"), "component", "first", "size", "bytes"), "members")
    # One text of each class travels, whatever the number of its rows.
    texts = KeyFilter(members, "class", "first").hits(docs.select("class", "id_", "text"), "class", "id_")
    texts = _packed(texts.dropDuplicates(["class"])).withColumnRenamed("class", "c_")
    blocks = F.ceil(F.greatest(F.count("*") / WIDE, F.sum("bytes") / WIDE_BYTES, F.lit(1))).cast("int")
    blocks = stage(members.groupBy(F.col("component").alias("k_")).agg(blocks.alias("blocks")), "blocks")
    grid = members.join(blocks, F.col("component") == F.col("k_")).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    found = grid.join(texts, F.col("class") == F.col("c_")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = found.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "size", "packed")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, unpack = Shingler(), zstandard.ZstdDecompressor()
        keys = ["component", "i", "j"]
        for t in whole_groups(batches, keys, 256, WIDE_BYTES):
            names, own, sizes = (t.column(c).to_pylist() for c in ("class", "own", "size"))
            packed, i, j = t.column("packed"), t.column("i").to_pylist(), t.column("j").to_pylist()
            starts = group_starts(t, keys)
            out: list[tuple[bytes, int, bytes]] = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo < 2:
                    continue
                if i[lo] != j[lo] and len(set(own[lo:hi])) < 2:  # the other block is empty
                    continue
                n, root = _verified(_unpacked(shingle, unpack, packed[lo:hi]), np.array(own[lo:hi]), np.array(sizes[lo:hi]), threshold)
                out += [(names[k], int(x), names[lo + r]) for k, x, r in zip(range(lo, hi), n, root.tolist(), strict=True) if x]
            if out:
                kinds = (pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["class", "links", "root"])

    true = found.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "class")
    true = stage(true.mapInArrow(lean(verify), "class binary, links long, root binary"), "true")
    unstage(maybe, members, blocks)
    groups = components(true.select(F.col("class").alias("a"), F.col("root").alias("b")))
    counts = true.groupBy("class").agg(F.sum("links").alias("links"))
    out = stage(counts.join(groups, F.col("class") == F.col("node")).select("class", "links", "component"), "linked")
    unstage(true, groups)
    return out


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: its id, class_id, n_copies and n_links.

    class_id: least id of all rows that are connected by links (equal texts, or a similarity of the threshold or more);
    n_copies: rows with an equal text, itself included; n_links: other rows that it is linked to. A null text counts as
    the empty one; texts without words are linked to equal texts only. Ids of any type that has an order; ids that are
    null or repeat are kept as they are. Equal texts are one class from the start; near copies are compared in blocks,
    and no pair becomes a row."""
    rows = docs.select(F.col(id).alias("id_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), _class(text).alias("class"))
    linked = links(rows, threshold)
    sizes = rows.groupBy("class").agg(F.min("id_").alias("least"), F.count("*").alias("n_copies"))
    known = sizes.join(linked.withColumnRenamed("class", "l_"), F.col("class") == F.col("l_"), "left").withColumn("component", F.coalesce("component", "class"))
    known = stage(known.select("class", "component", "least", "n_copies", (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    unstage(linked)
    tops = known.groupBy("component").agg(F.min("least").alias("class_id"))
    known = known.join(tops, "component").select(F.col("class").alias("k_"), "class_id", "n_copies", "n_links")
    ids = rows.select("id_", "class")
    return ids.join(known, ids["class"] == known.k_).select(F.col("id_").alias(id), "class_id", "n_copies", "n_links")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each group the row with the least doc_id stays, all its columns as they are.

    Of rows that repeat with the same doc_id and text one stays. What goes is decided on ids and classes alone; rows
    whose key a filter rules out stay where they are, and only the others are joined."""
    mark, doubt, c, i, stays = fresh(docs, "class_of_text", "in_doubt", "class_key", "id_key", "stays")
    rows = docs.withColumn(mark, _class("text"))
    linked = links(rows.select(F.col("doc_id").alias("id_"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(mark).alias("class")))
    keys = rows.select(F.col("doc_id").alias("id_"), F.col(mark).alias("class")).groupBy("class", "id_").agg(F.count("*").alias("n"))
    tops = keys.groupBy("class").agg(F.min("id_").alias("least")).join(linked.withColumnRenamed("class", "l_"), F.col("class") == F.col("l_"), "left")
    first = F.min(F.struct(F.col("least").isNull().alias("n"), F.col("least").alias("l"), F.col("class").alias("c")))
    tops = tops.groupBy(F.coalesce("component", "class").alias("component")).agg(first.alias("top")).select(F.col("top.c").alias("c_"), F.col("top.l").alias("l_"), F.lit(True).alias("stays"))
    keys = keys.join(tops, (F.col("class") == F.col("c_")) & F.col("id_").eqNullSafe(F.col("l_")), "left").where("stays IS NULL OR n > 1")
    keys = stage(keys.select("class", "id_", F.coalesce("stays", F.lit(False)).alias("stays")), "removed")
    unstage(linked)
    rows = KeyFilter(keys, "class", "id_").flagged(rows, doubt, mark, "doc_id")
    unsure = rows.where(F.col(doubt)).dropDuplicates(["doc_id", mark])
    keys = keys.select(F.col("class").alias(c), F.col("id_").alias(i), F.col("stays").alias(stays))
    unsure = unsure.join(keys, (F.col(mark) == F.col(c)) & F.col("doc_id").eqNullSafe(F.col(i)), "left").where(F.coalesce(stays, F.lit(True)))
    return rows.where(~F.col(doubt)).select(*docs.columns).union(unsure.select(*docs.columns))


#: Every pair of texts compared on its shingles: what the join must find, for tables that are small enough.
ORACLE_SQL = r"""
WITH RECURSIVE rows_ AS (SELECT doc_id, md5(coalesce(text, '')) AS class, coalesce(text, '') AS text FROM documents),
sizes AS (SELECT class, min(doc_id) AS least, count(*) AS size, any_value(text) AS text FROM rows_ GROUP BY class),
words AS (SELECT class, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM sizes),
shingles AS (SELECT DISTINCT class, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
n AS (SELECT class, count(*) AS n FROM shingles GROUP BY class),
pairs AS (SELECT a.class AS a, b.class AS b, count(*) AS common_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.class <> b.class GROUP BY ALL),
near AS (SELECT a, b FROM pairs JOIN n x ON x.class = a JOIN n y ON y.class = b WHERE 5 * common_ >= 4 * (x.n + y.n - common_)),
links AS (SELECT a, sum(size) AS links FROM near JOIN sizes ON class = b GROUP BY a),
reach AS (SELECT class AS a, class AS b FROM sizes UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
tops AS (SELECT a, min(least) AS class_id FROM reach JOIN sizes ON class = b GROUP BY a)
SELECT doc_id, class_id, size AS n_copies, (size - 1 + coalesce(links, 0))::BIGINT AS n_links
FROM rows_ JOIN sizes USING (class) JOIN tops ON tops.a = class LEFT JOIN links ON links.a = class
"""
