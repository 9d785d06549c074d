"""Byte-pair merging of many short sequences at once, on flat numpy arrays.

All sequences lie one after the other in one array. A round finds each sequence's lowest pair rank, applies that pair
wherever it stands in its sequence (from the left, without overlap), and compacts the array. Sequences without a
mergeable pair leave the array, so that a round costs what is still at work.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
LONG = 8192  # symbols from which a sequence is merged by itself: its rounds look at the places of one rank, not at all of it


class MergeTable:
    """Pairs of symbol ids, the rank at which each merges (lower first) and the id that it becomes.

    ``wary`` is derived: results that form, with some neighbour, a pair of no higher rank than their own. Where such a
    result is due and does form such a pair, that pair may go before the next places of the sequence: the order is that
    of a priority queue by (rank, position). What grows out of the place is a symbol of ``reach`` first symbols at
    most: of places that follow each other within twice that, those up to the first such place merge in this round, the
    others wait. With all other results the order of the places can't matter.

    ``sizes``: how many first symbols each symbol stands for, for tables with wary results."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, n_symbols: int, sizes: np.ndarray | None = None):
        key = left.astype(np.int64) * n_symbols + right
        order = np.lexsort((rank, key))
        key = key[order]
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        self.key, self.rank, self.made = key[first], rank[order][first].astype(np.int32), made[order][first].astype(np.int32)
        self.n = n_symbols
        born = np.full(n_symbols, -1, np.int64)  # the highest rank at which a symbol may come to be
        np.maximum.at(born, self.made, self.rank)
        self.wary = np.zeros(n_symbols, bool)
        for part in (self.key // n_symbols, self.key % n_symbols):
            self.wary[part[(born[part] >= 0) & (self.rank <= born[part])]] = True
        self.reach = int(sizes[self.made].max()) if sizes is not None and len(self.made) else None

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without a pair) and row of the table for pairs of ids; an id below 0 pairs with nothing."""
        if not len(self.key) or not len(left):
            return np.full(len(left), NONE), np.zeros(len(left), np.int64)
        key = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        hit = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NONE), at


def merge(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence until none of its pairs is in the table; returns symbols and lengths, sequences in order."""
    n_seq = len(lengths)
    if n_seq and lengths.max() > LONG:
        ends, parts = np.cumsum(lengths), []
        alone = np.flatnonzero(lengths > LONG)
        for lo, hi in zip([0, *(alone + 1)], [*alone, n_seq], strict=True):  # those between two long ones, then the long one
            parts.append(merge(symbols[ends[lo] - lengths[lo] : ends[hi - 1]], lengths[lo:hi], table) if hi > lo else (np.zeros(0, np.int32), np.zeros(0, np.int64)))
            if hi < n_seq:
                one = _merged_alone(symbols[ends[hi] - lengths[hi] : ends[hi]], table)
                parts.append((one, np.array([len(one)])))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    out_len = np.zeros(n_seq, np.int64)
    done_sym, done_seq = [], []
    live = lengths > 0
    seq_ids = np.flatnonzero(live)
    lens = lengths[live].astype(np.int64)
    sym = symbols.astype(np.int32)
    seq = np.repeat(np.arange(len(seq_ids)), lens)
    rank, row = _pairs(sym, seq, table)
    while len(sym):
        starts = np.r_[0, np.cumsum(lens)[:-1]]
        low = np.minimum.reduceat(rank, starts)
        still = low != NONE
        if not still.all():  # sequences that are done leave
            at = still[seq]
            done_sym.append(sym[~at])
            done_seq.append(seq_ids[seq[~at]])
            sym, rank, row = sym[at], rank[at], row[at]
            new = np.cumsum(still) - 1
            seq = new[seq[at]]
            seq_ids, lens, low = seq_ids[still], lens[still], low[still]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == low[seq])
        # places that overlap (aaa): every other one of a run counts, from its left end
        run = np.r_[True, (hit[1:] != hit[:-1] + 1)]
        begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
        made = table.made[row[hit]]
        if table.wary[made].any():
            go = _in_turn(sym, seq, low, hit, made, table)
            hit, made = hit[go], made[go]
        sym[hit] = made
        lens -= np.bincount(seq[hit], minlength=len(lens))
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        place = np.cumsum(keep) - 1
        sym, seq, rank, row = sym[keep], seq[keep], rank[keep], row[keep]
        at = place[hit]
        touched = np.zeros(len(sym), bool)
        touched[at] = True
        touched[at[at > 0] - 1] = True
        touch = np.flatnonzero(touched)
        rank[touch], row[touch] = _pairs(sym, seq, table, touch)
    if done_sym:
        s, q = np.concatenate(done_sym), np.concatenate(done_seq)
        out_len += np.bincount(q, minlength=n_seq)
        return s[np.argsort(q, kind="stable")], out_len
    return np.zeros(0, np.int32), out_len


def _merged_alone(symbols: np.ndarray, table: MergeTable) -> np.ndarray:
    """merge() of one long sequence: places are kept by rank, and neighbours are linked, so that a round costs what it changes."""
    n = len(symbols)
    sym = np.append(symbols.astype(np.int32), -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)  # place n stands for the end
    rank, row = np.full(n + 1, NONE), np.zeros(n + 1, np.int64)
    alive = np.ones(n, bool)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(at: np.ndarray) -> None:
        rank[at], row[at] = table.find(sym[at], sym[after[at]])
        at = at[rank[at] != NONE]
        if not len(at):
            return
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for part in np.split(at, cuts):
            r = int(rank[part[0]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(heap, r)
            waiting[r].append(part)

    put(np.arange(n))
    while heap:
        low = heapq.heappop(heap)
        hit = np.unique(np.concatenate(waiting.pop(low)))
        hit = hit[rank[hit] == low]  # the others have changed since
        if not len(hit):
            continue
        run = np.r_[True, after[hit[:-1]] != hit[1:]]  # places that overlap, as in merge()
        begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        odd = (np.arange(len(hit)) - begin) % 2 == 1
        rest, hit = hit[odd], hit[~odd]
        made = table.made[row[hit]]
        if table.wary[made].any():
            left, right = sym[before[hit]], sym[after[after[hit]]]
            left = np.where(before[hit] >= 0, left, -1)
            new = np.minimum(table.find(left, made)[0], table.find(made, right)[0])
            close = np.r_[after[after[hit[:-1]]] == hit[1:], False]
            active = np.flatnonzero(table.wary[made] & ((new <= low) | close | np.r_[False, close[:-1]]))
            go = _first_of_each(hit, np.zeros(n + 1, np.int64), active, table.reach, n)
            rest, hit, made = np.r_[rest, hit[~go]], hit[go], made[go]
        gone = after[hit]
        sym[hit] = made
        rank[gone] = NONE
        after[hit] = after[gone]
        before[after[hit]] = hit
        alive[gone] = False
        touched = np.r_[hit, before[hit]]
        put(np.unique(touched[touched >= 0]))
        rest = rest[rank[rest] == low]  # those that wait; put() may have put some of them already
        if len(rest):
            if low not in waiting:
                waiting[low] = []
                heapq.heappush(heap, low)
            waiting[low].append(rest)
    return sym[:n][alive]


def _first_of_each(hit: np.ndarray, seq: np.ndarray, active: np.ndarray, reach: int | None, size: int) -> np.ndarray:
    """Which places may merge in this round: of those within twice ``reach`` of the next one, all up to the first ``active`` one."""
    far = 2 * reach if reach is not None else size
    group = np.cumsum(np.r_[True, (hit[1:] - hit[:-1] >= far) | (seq[hit[1:]] != seq[hit[:-1]])]) - 1
    first = np.full(group[-1] + 1, len(hit))
    np.minimum.at(first, group[active], active)
    return np.arange(len(hit)) <= first[group]


def _in_turn(sym: np.ndarray, seq: np.ndarray, low: np.ndarray, hit: np.ndarray, made: np.ndarray, table: MergeTable) -> np.ndarray:
    """Which of the places ``hit`` may merge in this round: all but those that a new pair of no higher rank, formed by a place before, might reach first."""
    before, after = np.where(hit > 0, hit - 1, 0), np.minimum(hit + 2, len(sym) - 1)
    has = lambda at, ok: np.where(ok & (seq[at] == seq[hit]), sym[at], -1)
    careful = np.flatnonzero(table.wary[made])
    left, right = has(before, hit > 0)[careful], has(after, hit + 2 < len(sym))[careful]
    new = np.minimum(table.find(left, made[careful])[0], table.find(made[careful], right)[0])
    # the places on either side may merge in this very round: what the neighbours become counts too
    touching = np.zeros(len(hit), bool)
    touching[1:] |= hit[1:] - hit[:-1] == 2
    touching[:-1] |= touching[1:]
    active = careful[(new <= low[seq[hit[careful]]]) | touching[careful]]
    return _first_of_each(hit, seq, active, table.reach, len(sym))


def _pairs(sym: np.ndarray, seq: np.ndarray, table: MergeTable, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(sym)) if at is None else at
    rank, row = np.full(len(at), NONE), np.zeros(len(at), np.int64)
    ok = at + 1 < len(sym)
    ok[ok] = seq[at[ok]] == seq[at[ok] + 1]
    i = at[ok]
    rank[ok], row[ok] = table.find(sym[i], sym[i + 1])
    return rank, row


class WordCache:
    """Values of words in two generations: of the older, what is asked for again moves on; the rest goes. Holds 2 x ``most`` at most."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, words: set) -> list:
        """Words whose value isn't known. After put() of these, ``young`` has all of ``words``."""
        new = words.difference(self.young)
        if len(self.young) + len(new) > self.most:
            self.old, self.young, new = self.young, {}, words
        known = new.intersection(self.old)
        self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
        return list(new.difference(known))


def spell(ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For sequences of ids the concatenated byte strings that stand for them; string i is flat[begins[i] : begins[i] + sizes[i]]."""
    n = sizes[ids]
    total = np.cumsum(n)
    source = np.repeat(begins[ids] - (total - n), n) + np.arange(total[-1] if len(total) else 0)
    joined = flat[source].tobytes()
    ends = np.r_[0, total][np.cumsum(lengths)].tolist()
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def strings(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``values`` as spell() takes them."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes, sizes
