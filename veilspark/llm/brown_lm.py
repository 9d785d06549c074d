"""Language-model scores from Brown classes.

Exchange clustering puts words into classes so that the likelihood of a class bigram model is highest. A token's
probability is that of its class after the previous token's class, times that of the word in its class; both are
smoothed. Every word of the training documents has the class that its own contexts speak for:

1. The SEEDS most frequent words are exchanged one by one until none moves.
2. All words of the broadcast list (FREQUENT at most) take part in a distributed exchange: their neighbours are gathered
   once, and each round counts the classes of these, moves words, and is taken back where the likelihood falls.
3. Each rarer word, however many there are, goes to the class that its neighbours' classes make likeliest; rare
   neighbours are a class of their own in that step. Words travel there with their places, to which their classes return.

Counts come from all training documents. What is small by construction (the frequent words, the class matrix) is
broadcast; the counts and classes of all other words, whose number grows with the corpus, are joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import lean, rows_by_bytes, stage, unstage

SEEDS = 1024  # words whose exchange is done one by one, on the driver; the classes of all others follow from there
CLASSES = 64
GAIN = 1e-4  # nats a token: the exchange of all frequent words ends when a round brings less
FREQUENT = 131_072  # words whose counts are broadcast and that take part in the exchange, at most
FLUSH = 400_000  # distinct words that a task holds while it counts; rare words of texts that it holds until they are packed
NAME_BYTES = 32 << 20  # of words that it holds, about
SLICE_BYTES = 4 << 20
GROUPS = 2048  # of frequent words that travel together while their neighbours are counted
HELD = 2_000_000  # neighbours of a group that are held before they are added up
ROWS = 2048  # words whose counts of classes are held at once
PACK = 200_000  # rare tokens of training texts that one part of the words holds, about
FEWEST = 1024  # parts of the rare words, and of the texts, at least
NONE = 255  # the class of a word without one, in a byte
ADD = 0.1
END = b""  # the end of a text, as a word


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end."""
    return [*(text or b"").lower().split(), END]


def split_tokens(text: pa.Array) -> pa.ListArray:
    """tokens() of each text, by Arrow; words are binary."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(text.cast(pa.string()), "")))
    text = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(text, "", " "))  # what follows the last space is the end
    return pc.ascii_split_whitespace(text).cast(pa.list_(pa.binary()))


def held_out(doc_id: Column) -> Column:
    """Documents that aren't learnt from: crc32 of the id as text, mod 10, is 0. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary) and n over all rows of ``docs`` (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        size = most = 0

        def added() -> tuple[pa.Array, np.ndarray]:
            word = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            n = np.bincount(word.indices.to_numpy(), weights=np.concatenate([h[1] for h in held]), minlength=len(word.dictionary))
            return word.dictionary, n.astype(np.int64)

        for b in rows_by_bytes(batches, "text", SLICE_BYTES):
            word = split_tokens(b.column(0)).flatten().dictionary_encode()
            held.append((word.dictionary, np.bincount(word.indices.to_numpy(), minlength=len(word.dictionary))))
            size, most = size + len(word.dictionary), most + word.dictionary.nbytes
            if size > 2 * FLUSH or most > NAME_BYTES:
                held = [added()]
                size, most = len(held[0][0]), held[0][0].nbytes
                if size > FLUSH or most > NAME_BYTES // 2:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], names=["word", "n"])
                    held, size, most = [], 0, 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, added())], names=["word", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Symbols:
    """The frequent words, by number; all others have the number after the last."""

    def __init__(self, words: list[bytes]):
        self.words = pa.array(words, pa.binary())
        self.n = len(words)
        self.end = words.index(END) if END in words else self.n

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """For all tokens of the texts: number, text number; and the tokens."""
        lists = split_tokens(texts)
        flat = lists.flatten().dictionary_encode()
        number = self.numbers(flat.dictionary)[flat.indices.to_numpy()]
        return number, np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), flat

    def numbers(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words), self.n).to_numpy().astype(np.int64)


def _previous(symbol: np.ndarray, text: np.ndarray, end: int) -> np.ndarray:
    """The symbol before each token; a text begins after an end."""
    return np.where(np.r_[True, text[1:] != text[:-1]], end, np.r_[end, symbol[:-1]])


def _binaries(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Stretches of ``values``, which begin at ``begins`` and end where the next begins, as binary cells."""
    offsets = (np.r_[begins, len(values)] * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def neighbours(docs: DataFrame, words) -> DataFrame:
    """A row for each frequent word: id, its neighbours as int32 numbers (left ones, and right ones after these) and how often each stands there, in as few bytes a number as the row's highest needs (_counts).

    On the way words travel GROUPS by GROUPS, a row for each group: word and neighbour in one int32."""
    unit = 2 * (len(words.value) + 1)
    inner = -(-len(words.value) // GROUPS) or 1
    if inner * unit >= 2**31:
        raise ValueError("too many frequent words for their groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Symbols(words.value)
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pair, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            before, now = np.divmod(pair, s.n + 1)
            left, right = np.flatnonzero(now < s.n), np.flatnonzero(before < s.n)
            if len(left) or len(right):  # words that follow each other in frequency are in different groups
                word, at = np.r_[now[left], before[right]], np.r_[before[left], now[right] + s.n + 1]
                group = (word % GROUPS).astype(np.uint16)
                order = np.argsort(group, kind="stable")
                group = group[order]
                begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                code, n = (word // GROUPS * unit + at).astype(np.int32)[order], np.r_[count[left], count[right]].astype(np.int32)[order]
                yield pa.RecordBatch.from_arrays([pa.array(group[begins].astype(np.int32)), _binaries(code, begins), _binaries(n, begins)], names=["id", "at", "n"])

        for b in rows_by_bytes(batches, "text", SLICE_BYTES):
            now, text, _ = s.read(b.column(0))
            held.append(_previous(now, text, s.end) * (s.n + 1) + now)
            if sum(map(len, held)) > HELD:
                yield from flush()
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, code, total in _merged(batches):
            key = code // unit
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ids = (key[begins] * GROUPS + group).astype(np.int32)
            for lo in range(0, len(begins), ROWS):
                part = slice(begins[lo], begins[lo + ROWS] if lo + ROWS < len(begins) else len(code))
                at = begins[lo : lo + ROWS] - part.start
                n = [x.astype(np.min_scalar_type(x.max())).tobytes() for x in np.split(total[part], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + ROWS]), _binaries((code[part] % unit).astype(np.int32), at), pa.array(n, pa.binary())], names=["id", "at", "n"])

    form = "id int, at binary, n binary"
    dealt = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), form)
    return dealt.repartition("id").sortWithinPartitions("id").mapInArrow(lean(merge), form)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From rows of a group's codes and counts, sorted by group: group, its different codes, and their sums. Rows are added up as they come."""
    group, parts, size = None, [], 0

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code = np.concatenate([p[0] for p in parts])
        order = np.argsort(code)
        code = code[order]
        begins = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return code[begins], np.add.reduceat(np.concatenate([p[1] for p in parts], dtype=np.int64)[order], begins)

    for b in rows_by_bytes(batches, "at", SLICE_BYTES):
        for g, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if g != group:
                if parts:
                    yield (group, *added(parts))
                group, parts, size = g, [], 0
            parts.append((np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)))
            size += len(parts[-1][0])
            if size > HELD and len(parts) > 1:
                parts = [added(parts)]
                size = len(parts[0][0]) // 2  # what has been added up is let grow before it is again
    if parts:
        yield (group, *added(parts))


def _counts(cell: bytes, size: int) -> np.ndarray:
    """``size`` whole numbers of equal width."""
    return np.frombuffer(cell, f"u{len(cell) // size}")


def contexts(batches: Iterator[pa.RecordBatch], of: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From rows of neighbours(): words, and how often each class stands left of them, then right of them; class k is that of words without one."""
    wide, place = 2 * (k + 1), np.r_[of, k, of + k + 1, 2 * k + 1]
    for b in (s.slice(lo, ROWS) for s in rows_by_bytes(batches, "at", SLICE_BYTES) for lo in range(0, s.num_rows, ROWS)):
        left = b.column(1).to_pylist()
        size = [len(x) // 4 for x in left]
        n = np.concatenate([_counts(c, k_) for c, k_ in zip(b.column(2).to_pylist(), size, strict=True)], dtype=np.float64)
        row = np.repeat(np.arange(b.num_rows), size)
        at = row * wide + place[np.frombuffer(b"".join(left), np.int32)]
        yield b.column(0).to_numpy(), np.bincount(at, weights=n, minlength=b.num_rows * wide).reshape(-1, wide)


def class_grid(near: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """How often each class follows each; words without a class are the last. What follows what among rare words isn't in it."""
    shared = near.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros((k + 1, k + 1))
        for ids, c in contexts(batches, shared.value, k):
            mine = shared.value[ids]
            grid[:k] += (mine == np.arange(k)[:, None]).astype(float) @ c[:, k + 1 :]
            grid[k, :k] += np.bincount(mine, weights=c[:, k], minlength=k + 1)[:k]
        some = np.flatnonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(grid.reshape(-1)[some])], names=["cell", "n"])

    out = np.zeros((k + 1) ** 2)
    for r in near.mapInArrow(lean(run), "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    shared.unpersist()
    return out.reshape(k + 1, k + 1)


def better_classes(near: DataFrame, of: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each frequent word the class with the highest affinity(), and what it gains there (without a class yet: infinity)."""
    k = len(grid) - 1
    shared = near.sparkSession.sparkContext.broadcast((of, grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, grid = shared.value
        for ids, c in contexts(batches, of, k):
            mine = of[ids]
            score = affinity(grid, c, mine)
            best = score.argmax(1)
            gain = np.where(mine == k, np.inf, score.max(1) - score[np.arange(len(ids)), np.minimum(mine, k - 1)])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best.astype(np.int32)), pa.array(gain)], names=["id", "best", "gain"])

    ids, new, more = (c.to_numpy() for c in _collected(near.mapInArrow(lean(run), "id int, best int, gain double")))
    best, gain = of.copy(), np.zeros(len(of))
    best[ids], gain[ids] = new, more
    shared.unpersist()
    return best, gain


def likelihood(grid: np.ndarray) -> float:
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(0)).sum() - _xlogx(grid.sum(1)).sum())


def affinity(grid: np.ndarray, near: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """For words (rows of contexts()) and classes: log likelihood of the word's contexts if it is in that class.

    ``of``: the words' classes; a word's own counts don't speak for the class that it is in."""
    k = len(grid) - 1
    into, out = np.log(grid.sum(0) + 1), np.log(grid.sum(1) + 1)
    g = np.log(grid + ADD) - into - out[:, None]
    left, right = near[:, : k + 1], near[:, k + 1 :]
    score = right @ g[:k].T + left @ g[:, :k]
    if of is not None:
        for c in range(k):
            w = np.flatnonzero(of == c)
            if not len(w):
                continue
            le, ri = left[w], right[w]
            row = np.log(np.maximum(grid[c] - ri, 0) + ADD) - into - np.log(np.maximum(grid[c].sum() - ri.sum(1), 0) + 1)[:, None]
            col = np.log(np.maximum(grid[:, c] - le, 0) + ADD) - out - np.log(np.maximum(grid[:, c].sum() - le.sum(1), 0) + 1)[:, None]
            score[w, c] = (ri * row).sum(1) + (le * col).sum(1)
    return score


def clustered(near: DataFrame, of: np.ndarray, k: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """The class of each frequent word, and class_grid(), from neighbours() and first classes (k: none yet).

    A part of the words that do better elsewhere move in each round, first half of them. A round that lowers the
    likelihood is taken back and tried with fewer; it ends when none moves, or with a gain under GAIN."""
    if not len(of):
        return of, np.zeros((k + 1, k + 1))
    grid = class_grid(near, of, k)
    if (of == k).any():
        best, _ = better_classes(near, of, grid)
        of = np.where(of == k, best, of)
        grid = class_grid(near, of, k)
    level, share, r = likelihood(grid), 0.5, np.random.default_rng(0)
    best, gain = better_classes(near, of, grid)
    while share > 0.01 and (gain > 1e-3).any():
        moves = np.flatnonzero(gain > 1e-3)
        moves = moves[r.random(len(moves)) < share]
        tried = of.copy()
        tried[moves] = best[moves]
        there = class_grid(near, tried, k)
        rise = likelihood(there) - level
        if rise < 0:
            share /= 4
            continue
        of, grid, level = tried, there, level + rise
        if rise < GAIN * grid.sum():
            break
        best, gain = better_classes(near, of, grid)
    return of, grid


def rare_words(docs: DataFrame, words, of: np.ndarray, grid: np.ndarray) -> DataFrame:
    """A row for each text of ``docs`` (keyed()) and each word of it that isn't frequent: x, y (a hash of doc_id), the word's places ``at``, its count n among
    training texts and its class, the one that its neighbours' classes there make likeliest (null: no training text has it). ``first`` marks one row of each word of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key, size, at, n, tag, first = _entries(b.slice(i, 1).to_pydict())
                cells = [at[hi - m : hi].tobytes() for m, hi in zip(size, np.cumsum(size), strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(key.T)), pa.array(cells, pa.binary()), pa.array(n), pa.array(tag.astype(np.int32), mask=tag == NONE), pa.array(first > 0)], names=["x", "y", "at", "n", "class", "first"])

    return packed_words(docs, words, of, grid, FEWEST).mapInArrow(lean(run), "x long, y long, at binary, n long, class int, first boolean")


def _entries(row: dict[str, list[bytes]]) -> list[np.ndarray]:
    """Of a row of packed_words(): hashes (x, y), number of places, places, count, class, and whether a word's first, of each word of each text."""
    kinds = {"key": np.int64, "size": np.int32, "at": np.int32, "n": np.int64, "class": np.uint8, "first": np.uint8}
    key, *others = (np.frombuffer(row[c][0], kind) for c, kind in kinds.items())
    return [key.reshape(-1, 2), *others]


def _packs(of: np.ndarray, size: np.ndarray, columns: list[np.ndarray], long: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """Entries by their packs ``of``: the packs that there are, and a binary cell for each of them, of the columns (a value an entry) and then of the long ones (``size`` values an entry)."""
    order = np.argsort(of, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
    ends = np.cumsum(size)
    sized = size[order]
    at = np.arange(sized.sum()) + np.repeat(ends[order] - np.cumsum(sized), sized)
    starts = np.r_[0, np.cumsum(sized)][begins]
    cells = [_binaries(c[order].reshape(-1), begins * (c.size // len(c))) for c in columns]
    return of[order][begins], cells + [_binaries(c[at].reshape(-1), starts * (c.size // max(len(c), 1))) for c in long]


def packed_words(docs: DataFrame, words, of: np.ndarray, grid: np.ndarray, packs: int) -> DataFrame:
    """rare_words() in few rows: those of a part of the texts (``pack``, x modulo ``packs``) that one task has found, as binary columns that _entries() reads.

    On the way words travel once, with their neighbours' classes and their places, in a row for each FLUSH of them that a task has read and part of the words.
    A part's training words are held by one task; those of other texts, which nothing is counted of, go by."""
    k = len(grid) - 1
    shared = docs.sparkSession.sparkContext.broadcast((np.r_[of, k], grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, classes = Symbols(words.value), shared.value[0]
        out: list[tuple] = []  # of a slice: its rare words; of each of their entries: word, held, hashes, number of places; of each place: place, classes

        def flush() -> pa.RecordBatch:
            sizes = [len(o[1]) for o in out]
            base = np.repeat(np.cumsum([0, *(len(o[0]) for o in out[:-1])]), sizes)
            names = pa.concat_arrays([o[0] for o in out]).dictionary_encode()
            word, held, hashes, size, at, both = (np.concatenate([o[i] for o in out]) for i in range(1, 7))
            out.clear()
            word, names = names.indices.to_numpy()[base + word], names.dictionary
            part = np.fromiter(map(zlib.crc32, names.to_numpy(zero_copy_only=False)), np.int64, len(names)) % packs
            pack = part[word] * 2 + held
            # a pack's words once, and the place of each entry's word among them
            known, of_word = np.unique(pack * len(names) + word, return_inverse=True)
            begins = np.flatnonzero(np.r_[True, np.diff(known // len(names)) != 0])
            place = np.arange(len(known)) - np.repeat(begins, np.diff(np.r_[begins, len(known)]))
            packed, cells = _packs(pack, size, [place[of_word].astype(np.int32), hashes, size], [at, both])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(known)].astype(np.int32)), names.take(pa.array(known % len(names))))
            return pa.RecordBatch.from_arrays([pa.array((packed // 2).astype(np.int32)), pa.array(packed % 2 == 1), pc.binary_join(lists, b"\n"), *cells], names=["part", "held", "words", "word", "key", "size", "at", "c"])

        for b in rows_by_bytes(batches, "text", SLICE_BYTES):
            now, text, flat = s.read(b.column(2))
            at = np.flatnonzero(now == s.n)
            if not len(at):
                continue
            before, after = classes[_previous(now, text, s.end)], classes[np.r_[now[1:], s.end]]
            begins = np.searchsorted(text, np.arange(b.num_rows))
            used, word = np.unique(flat.indices.to_numpy()[at], return_inverse=True)
            key = text[at] * len(used) + word
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[new, len(key)]).astype(np.int32)
            word, row = key[new] % len(used), key[new] // len(used)
            held = b.column(1).to_numpy(zero_copy_only=False)[row]
            hashes = np.stack([b.column(0).to_numpy()[row], b.column(3).to_numpy()[row]], 1)
            both = np.stack([before[at], after[at] + k + 1], 1).astype(np.uint8)
            out.append((flat.dictionary.take(pa.array(used)), word, held, hashes, size, (at - begins[text[at]]).astype(np.int32), both))
            if sum(len(o[4]) for o in out) > FLUSH or sum(len(o[5]) for o in out) > HELD or sum(o[0].nbytes for o in out) > NAME_BYTES:
                yield flush()
        if out:
            yield flush()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value[1]
        single = _single_classes(grid)
        out: list[tuple[np.ndarray, ...]] = []
        part, index, learnt, others, n, tag = None, None, [], [], np.zeros(0, np.int64), np.zeros(0, np.uint8)
        waiting = going = 0  # places in others, entries in out

        def read(rows: list[tuple]) -> tuple[pa.Array, list[np.ndarray]]:
            """The rows' names, one after the other, and their entries, which point to these."""
            word, *others = (np.concatenate([r[i] for r in rows]) for i in range(1, len(rows[0])))
            base = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
            return pa.concat_arrays([r[0].cast(pa.large_binary()) for r in rows]), [np.repeat(base, [len(r[1]) for r in rows]) + word, *others]

        def known() -> None:
            """Counts and classes of the part's words, from its training texts, whose entries can go on then."""
            nonlocal index, n, tag, learnt, going
            if learnt:
                names, (word, key, size, at, c) = read(learnt)
                names = names.dictionary_encode()
                word, index, learnt = names.indices.to_numpy()[word], names.dictionary, []
                n, tag = _rare_classes(np.repeat(word, size), c, len(index), grid, single)
                first = np.zeros(len(word), np.uint8)
                first[np.unique(word, return_index=True)[1]] = 1
                out.append((key, size, at, n[word], tag[word], first))
                going += len(word)

        def passed() -> None:
            """Entries of the part's other texts go on with what is known of their words."""
            nonlocal others, waiting, going
            if others:
                names, (word, key, size, at) = read(others)
                found = np.full(len(names), len(n)) if index is None else pc.fill_null(pc.index_in(names, value_set=index), len(n)).to_numpy()
                word, others, waiting = found[word], [], 0
                going += len(word)
                out.append((key, size, at, np.r_[n, 0][word], np.r_[tag, np.uint8(NONE)][word], np.zeros(len(word), np.uint8)))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal going
            if out:
                going = 0
                key, size, at, n_, tag_, first = (np.concatenate([o[i] for o in out]) for i in range(6))
                out.clear()
                packed, cells = _packs(key[:, 0] % packs, size, [key, size, n_, tag_, first], [at])
                yield pa.RecordBatch.from_arrays([pa.array(packed.astype(np.int32)), *cells], names=["pack", "key", "size", "n", "class", "first", "at"])

        for b in rows_by_bytes(batches, "at", SLICE_BYTES):
            names = pc.split_pattern(b.column(2), b"\n")
            bounds, names = names.offsets.to_numpy(), names.values
            for i, (g, held, *cells) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6)), b.column(7), strict=True)):
                if g != part:
                    known()
                    passed()
                    part, index, n, tag = g, None, np.zeros(0, np.int64), np.zeros(0, np.uint8)
                word, key, size, at = (np.frombuffer(c, kind) for c, kind in zip(cells, (np.int32, np.int64, np.int32, np.int32), strict=False))
                row = names.slice(bounds[i], bounds[i + 1] - bounds[i]), word, key.reshape(-1, 2), size, at
                if held:
                    known()
                    others.append(row)
                    waiting += len(at)
                    if waiting > FLUSH:
                        passed()
                else:
                    learnt.append((*row, np.frombuffer(cells[4].as_buffer(), np.uint8).reshape(-1, 2)))
                if going > FLUSH or len(out) > ROWS:
                    yield from flush()
        known()
        passed()
        yield from flush()

    form = "part int, held boolean, words binary, word binary, key binary, size binary, at binary, c binary"
    dealt = docs.select("x", "held", "text", F.xxhash64("doc_id").alias("y")).mapInArrow(lean(run), form)
    return dealt.repartition("part").sortWithinPartitions("part", "held").mapInArrow(lean(assign), "pack int, key binary, size binary, n binary, class binary, first binary, at binary")


def _single_classes(grid: np.ndarray) -> np.ndarray:
    """The class of a word that stands in one place, by the classes left and right of it there."""
    k = len(grid)
    near = np.zeros((k, 2 * k))
    near[:, k:] = np.eye(k)
    out = np.zeros((k, k), np.uint8)
    for c in range(k):
        near[:, :k] = np.arange(k) == c
        out[c] = affinity(grid, near).argmax(1)
    return out


def _rare_classes(word: np.ndarray, c: np.ndarray, n_words: int, grid: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each of the words stands, and its class, from a row of neighbours' classes (left, right) for each place. ``single``: from _single_classes()."""
    wide = 2 * len(grid)
    n = np.bincount(word, minlength=n_words)
    tag_of = np.zeros(n_words, np.uint8)
    once = n[word] == 1
    tag_of[word[once]] = single[c[once, 0], c[once, 1] - len(grid)]
    more = np.flatnonzero(n > 1)
    place = np.zeros(n_words, np.int64)
    place[more] = np.arange(len(more))
    word, c, n_words = place[word[~once]], c[~once], len(more)
    order = np.argsort(word, kind="stable")
    word, c = word[order], c[order]
    tag = np.zeros(n_words, np.uint8)
    for lo in range(0, n_words, ROWS):
        hi = min(lo + ROWS, n_words)
        mine = slice(*np.searchsorted(word, (lo, hi)))
        near = np.bincount(((word[mine, None] - lo) * wide + c[mine]).reshape(-1), minlength=(hi - lo) * wide).reshape(-1, wide)
        tag[lo:hi] = affinity(grid, near.astype(float)).argmax(1)
    tag_of[more] = tag
    return n, tag_of


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int | None = None) -> np.ndarray:
    """The class of each symbol: symbols are moved, one at a time, to the class where the class bigrams' likelihood is highest, until none moves (or for so many sweeps)."""
    n = len(pairs)
    k = max(1, min(classes, n))
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % k
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    p = pairs.astype(float)
    grid = member.T @ p @ member
    after, before = p @ member, member.T @ p  # by symbol and class
    for _ in repeat(0) if sweeps is None else range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            old, same = of[w], p[w, w]
            row, col = after[w].copy(), before[:, w].copy()
            row[old] -= same
            col[old] -= same
            grid[old] -= row
            grid[:, old] -= col
            grid[old, old] -= same
            out, into = grid.sum(1) + col, grid.sum(0) + row  # these hold wherever the word goes
            f = _xlogx(grid)
            rows, cols = _xlogx(grid + row) - f, _xlogx(grid + col[:, None]) - f
            d = np.arange(k)
            gain = rows.sum(1) - rows[d, d] + cols.sum(0) - cols[d, d] + _xlogx(grid[d, d] + row + col + same) - f[d, d]
            gain -= _xlogx(out + row.sum() + same) - _xlogx(out) + _xlogx(into + col.sum() + same) - _xlogx(into)
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            grid[new] += row
            grid[:, new] += col
            grid[new, new] += same
            if new != old:
                of[w] = new
                after[:, old] -= p[:, w]
                after[:, new] += p[:, w]
                before[old] -= p[w]
                before[new] += p[w]
                moved += 1
        if not moved:
            break
    return of


class Model:
    """log10 probabilities: steps[a, b] of symbol b after a; where symbols are classes, a word also has log10(n + 0.1), and its class's sum, ``inner``, is in the step."""

    def __init__(self, pairs: np.ndarray, of: np.ndarray, inner: np.ndarray):
        k = int(of.max()) + 1
        member = np.zeros((len(of), k))
        member[np.arange(len(of)), of] = 1
        grid = member.T @ pairs @ member
        share = (grid.sum(0) + 1) / (grid.sum() + k)
        move = (grid + share) / (grid.sum(1, keepdims=True) + 1)
        count = pairs.sum(0) + ADD
        emit = count / (member.T @ count)[of]
        self.steps = np.log10(move)[of][:, of] + np.log10(emit) - inner


def _collected(df: DataFrame) -> list[np.ndarray]:
    t = df.toArrow()
    return [t.column(c) for c in t.column_names]


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    A null text is empty: one token, its end. Without training documents every count is 0. Rows that repeat are scored
    each, and learnt from each. Other columns don't matter. To the driver go the words of the broadcast list (131,072 at
    most, by a count that fewer words have), a class and a gain for each of them in each round,
    the bigrams of the first 1,024 and the classes'. A word that no training document has belongs to the class with the
    most rare words."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    train = docs.where(~held_out(F.col("doc_id")))
    counts = stage(word_counts(train), "words")
    total = counts.agg(F.sum("n"), F.count("*")).first()
    n_train, n_words = total[0] or 0, total[1]
    # the least count that no more than FREQUENT words have, from a histogram of some hundred steps
    steps = sorted(counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("s")).agg(F.count("*").alias("k")).collect(), reverse=True)
    least, held = 1 << 62, 0
    for s, k in steps:
        held += k
        if held > FREQUENT:
            break
        least = 2 ** (s / 16)
    frequent = F.floor(F.log2("n") * 16) >= F.lit(round(16 * np.log2(least)))
    words, n = _collected(counts.where(frequent | (F.col("word") == F.lit(END))))
    words, n = words.to_pylist(), n.to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], np.array([n[i] for i in order], np.int64)
    shared = spark.sparkContext.broadcast(words)
    near = stage(neighbours(train, shared), "neighbours")
    # the first words among themselves, and all others as one more
    k, first = CLASSES, min(SEEDS, len(words))
    of = np.full(len(words), k)
    if first:
        of[:first] = exchange(_first_pairs(near.where(F.col("id") < first), len(words), first), k)[:first]
    of, grid = clustered(near, of, k)
    texts = keyed(docs)
    packs = min(max(int(n_train - n.sum()) // PACK, FEWEST), 1 << 16)
    rare = stage(packed_words(texts, shared, of, grid, packs), "rare")
    # tokens and words of each class
    mass, kinds = np.bincount(of, weights=n, minlength=k), np.bincount(of, minlength=k).astype(float)
    few = np.zeros(k)
    for r in rare.select("n", "class", "first").mapInArrow(lean(lambda it: _class_sums(it, k)), "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        mass[r["class"]] += r.n
        few[r["class"]] = r.v
    unseen = int(few.argmax())
    kinds += few
    kinds[unseen] += 1
    inner = np.log10(mass + ADD * np.maximum(kinds, 1))
    known = spark.sparkContext.broadcast((of, np.log10(n + ADD)))
    tagged = stage(_tagged(texts, shared, known, rare, unseen, packs), "classes")
    unstage(counts, near, rare)
    end = int(of[words.index(END)]) if END in words else unseen
    pairs = np.zeros((k, k))
    learnt = tagged.where(~held_out(F.col("doc_id"))).select("classes").mapInArrow(lean(lambda it: _class_pairs(it, end, k)), "a int, b int, n long")
    for r in learnt.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        pairs[r.a, r.b] = r.n
    model = spark.sparkContext.broadcast(Model(pairs, np.arange(k), inner).steps)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c, text = _sequences(b.column(b.schema.get_field_index("classes")))
            step = np.bincount(text, weights=model.value[_previous(c, text, end), c], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(step)], names=["doc_id", "n_tokens", "n_known", "base_", "step_"])

    unit = float(np.log10(n_train + ADD * (n_words + 1)))
    out = tagged.select("doc_id", "n_tokens", "n_known", "base_", "classes").mapInArrow(lean(score), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_known long, base_ double, step_ double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("base_") + F.col("step_")).alias("score"),
    )


def _first_pairs(near: DataFrame, n_words: int, first: int) -> np.ndarray:
    """Bigrams of the first words, from neighbours(); all others are one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = np.frombuffer(b.column(1)[i].as_py(), np.int32)
                n = _counts(b.column(2)[i].as_py(), len(at))
                right = at > n_words
                row, col = (np.bincount(np.minimum(x, first), weights=m, minlength=first + 1).astype(np.float32) for x, m in ((at[right] - n_words - 1, n[right]), (at[~right], n[~right])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([row.tobytes()], pa.binary()), pa.array([float(col[first])])], names=["id", "row", "other"])

    out = np.zeros((first + 1, first + 1))
    for r in near.mapInArrow(lean(run), "id int, row binary, other double").collect():
        out[r.id] = np.frombuffer(r.row, np.float32)
        out[first, r.id] = r.other
    return out


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.uint8).astype(np.int64), np.repeat(np.arange(len(cells)), [len(x) for x in cells])


def _class_pairs(batches: Iterator[pa.RecordBatch], end: int, k: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(k * k, np.int64)
    for b in batches:
        if b.num_rows:
            c, text = _sequences(b.column(0))
            total += np.bincount(_previous(c, text, end) * k + c, minlength=k * k)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array((some // k).astype(np.int32)), pa.array((some % k).astype(np.int32)), pa.array(total[some])], names=["a", "b", "n"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, x (a hash of the text), held (whether it isn't learnt from) and text of every row of ``docs``."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("x"), held_out(F.col("doc_id")).alias("held"), text.alias("text"))


def _class_sums(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Tokens and words of each class, from rows of packed_words()."""
    total = np.zeros((2, k), np.int64)
    for b in batches:
        n, tag, first = (np.frombuffer(b"".join(c.to_pylist()), kind) for c, kind in zip(b.columns, (np.int64, np.uint8, np.uint8), strict=True))
        total[0] += np.bincount(tag[first > 0], weights=n[first > 0], minlength=k).astype(np.int64)
        total[1] += np.bincount(tag[first > 0], minlength=k)
    some = np.flatnonzero(total[1])
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *map(pa.array, np.ascontiguousarray(total[:, some]))], names=["class", "n", "v"])


def _tagged(texts: DataFrame, words, known, rare: DataFrame, unseen: int, packs: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_ (sum of log10(n + 0.1)) and the class of each token, a byte each, of every row of ``texts`` (keyed())."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, (of, log_count) = Symbols(words.value), known.value
        classes, log_count = np.r_[of, NONE].astype(np.uint8), np.r_[log_count, 0.0]
        for b in rows_by_bytes(batches, "text", SLICE_BYTES):
            now, text, _ = s.read(b.column(4))
            begins = np.searchsorted(text, np.arange(b.num_rows))
            total = lambda v: np.bincount(text, weights=v, minlength=b.num_rows)  # noqa: B023, E731
            columns = [*b.columns[:4], pa.array(np.bincount(text, minlength=b.num_rows)), pa.array(total(now < s.n).astype(np.int64)), pa.array(total(log_count[now])), _binaries(classes[now], begins)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "pack", "x", "y", "n_tokens", "n_known", "base_", "classes"])

    def apart(parts: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        """Places in order, by text; what rows alike bring more than once is held once."""
        x, y, at, n, tag = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((at, y, x))
        new = np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0) | (np.diff(at[order]) != 0)]
        return [[c[order[new]] for c in (x, y, at, n, tag)]]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Puts in the rare words, which come ahead of the texts of their pack."""
        pack, parts, size, place = None, [], 0, None
        for b in rows_by_bytes(rows_by_bytes(batches, "classes", SLICE_BYTES // 8), "key", SLICE_BYTES):
            out: list[tuple[int, int, float, bytes]] = []
            for i, row in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                if row[0] != pack:
                    pack, parts, size, place = row[0], [], 0, None
                if row[6] is None:
                    key, m, at, n, tag, _ = _entries({c: [x] for c, x in zip(("key", "size", "n", "class", "first", "at"), row[7:], strict=True)})
                    parts.append([*(np.repeat(c, m) for c in (key[:, 0], key[:, 1])), at, np.repeat(n, m), np.repeat(tag, m)])
                    size += len(at)
                    if size > HELD and len(parts) > 1:
                        parts = apart(parts)
                        size = len(parts[0][0]) // 2
                    continue
                if place is None:
                    place = {}
                    if parts:
                        x, y, at, n, tag = apart(parts)[0]
                        bounds = np.r_[np.flatnonzero(np.r_[True, (np.diff(x) != 0) | (np.diff(y) != 0)]), len(x)]
                        place = dict(zip(zip(x[bounds[:-1]].tolist(), y[bounds[:-1]].tolist(), strict=True), zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), strict=True))
                        tag, log, parts = np.where(tag == NONE, np.uint8(unseen), tag), np.log10(n + ADD), []
                _, x_, y_, _, n_known, base, cell = row[:7]
                if span := place.get((x_, y_)):
                    mine = slice(*span)
                    tags = np.frombuffer(cell, np.uint8).copy()
                    tags[at[mine]] = tag[mine]
                    out.append((i, n_known + int((n[mine] > 0).sum()), base + float(log[mine].sum()), tags.tobytes()))
                else:
                    out.append((i, n_known, base, cell))
            if out:
                rows, n_known, base, cells = zip(*out, strict=True)
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(4).take(rows), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(cells, pa.binary())], names=["doc_id", "n_tokens", "n_known", "base_", "classes"])

    kind = dict(texts.dtypes)["doc_id"]
    rows = texts.select("doc_id", F.pmod("x", F.lit(packs)).cast("int").alias("pack"), "x", F.xxhash64("doc_id").alias("y"), "text")
    near = rows.mapInArrow(lean(run), f"doc_id {kind}, pack int, x long, y long, n_tokens long, n_known long, base_ double, classes binary")
    both = near.unionByName(rare.select("pack", "key", "size", "n", "class", "first", "at"), allowMissingColumns=True)
    dealt = both.repartition("pack").sortWithinPartitions("pack", F.col("classes").isNotNull())
    return dealt.mapInArrow(lean(fill), f"doc_id {kind}, n_tokens long, n_known long, base_ double, classes binary")


def perplexity(df: DataFrame) -> DataFrame:
    """scores() with the perplexity of each text under the model."""
    return df.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
