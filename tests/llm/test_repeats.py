"""Exact repeated strings, near duplicates and leaks against brute force."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from veilspark.llm import decontaminate as dec
from veilspark.llm import jaccard_join as jac
from veilspark.llm import lpf_dedup as lpf
from veilspark.llm.components import components


def brute(rows, length, keep_first):
    at = defaultdict(list)
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        t = (rows[k][1] or "").encode()
        for p in range(len(t) - length + 1):
            at[t[p : p + length]].append((k, p))
    masks = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for places in at.values():
        if len(places) > 1:
            for k, p in places[1:] if keep_first else places:
                masks[k][p : p + length] = True
    out = []
    for (i, t), m in zip(rows, masks, strict=True):
        b = np.frombuffer((t or "").encode(), np.uint8)
        out.append((i, len(b), int(m.sum()), int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()), hashlib.sha256(b[~m].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = "the of and erst ing thé ónde zu".split()
    passages = [" ".join(r.choice(words) + r.choice("abc") for _ in range(90)) for _ in range(5)]
    out = [(None, passages[0]), (1, None), (2, "")]
    for i in range(3, 60):
        t = ""
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            a = r.randint(0, len(p))
            t += p[a : a + r.randint(0, 500)] + " ".join(r.choice(words) for _ in range(r.randint(0, 30)))
        out.append((i, t))
    return [*out, (200, "ab" * 400), (201, "x" * 1000), (202, passages[0]), (203, passages[0]), (204, "x" * 199), (205, "x" * 200)]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [1 << 20, 300])
def test_spans_are_exact(spark, rows, keep_first, hot):
    df = spark.createDataFrame([(*r, "c", 5) for r in rows], "doc_id long, text string, spans string, n_bytes int")
    got = sorted([tuple(r) for r in lpf.repeats(df, 200, keep_first, hot).drop("kept").collect()], key=repr)
    assert got == brute(rows, 200, keep_first)


def test_repeated_rows_and_empty(spark):
    text = "".join(f"word{i} " for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r.n_removed for r in lpf.repeats(df, keep_first=False).collect()] == [len(text)] * 2
    assert lpf.repeats(df.limit(0)).count() == 0


def test_previous_factors():
    r = random.Random(1)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(400)).encode(), np.uint8)
    starts = np.arange(385)
    earlier, later = lpf.previous_factors(data, starts, 16)
    t = data.tobytes()
    for i in starts:
        assert (earlier[i] >= 16) == (t[i : i + 16] in {t[j : j + 16] for j in range(i)})
        assert (later[i] >= 16) == (t[i : i + 16] in {t[j : j + 16] for j in range(i + 1, 385)})
    x = np.array([r.randint(0, 9) for _ in range(200)])
    want = [max((j for j in range(i) if x[j] <= x[i]), default=-1) for i in range(200)]
    assert lpf.smaller_before(x).tolist() == want


def test_cut_texts_stay_utf8(spark):
    text = "é" + "".join(f" wört{i}" for i in range(60))
    df = spark.createDataFrame([(1, "a" + text, 9, "de"), (2, "b\u00a8" + text[1:], 9, "fr"), (3, None, 0, "x")], "doc_id long, text string, n_chars long, rest string")
    out = {r.doc_id: r for r in lpf.without_repeats(df).collect()}
    assert out[1].text == "a" + text and out[2].rest == "fr" and len(out[2].text) == out[2].n_chars < 10 and out[3].text == "" and df.columns == lpf.without_repeats(df).columns


# --- near duplicates


@pytest.fixture(scope="module")
def near(spark):
    r = random.Random(5)
    rows = [(0, "one two three four five six"), (1, "one two three four five six"), (2, ""), (3, None), (4, "short text"), (5, "Short  TEXT"), (6, " \n ")]
    n = 10
    for _ in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(40, 120))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 99)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, rows[20][1]), (n, rows[20][1]), (n + 1, "word " * 30_000), (n + 2, "word " * 29_999)]
    return spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, links int, class string").coalesce(2)


def exhaustive(df):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    return sorted(con.sql(f"SELECT doc_id, class_id, n_copies, n_links FROM ({jac.ORACLE_SQL})").fetchall(), key=repr)


@pytest.mark.parametrize("block", [512, 3])
def test_links_and_classes(spark, near, monkeypatch, block):
    monkeypatch.setattr(jac, "BLOCK", block)
    monkeypatch.setattr(jac, "WIDE", block + 2)
    assert sorted([tuple(r) for r in jac.near_duplicates(near).collect()], key=repr) == exhaustive(near)


def test_blocks_by_bytes_and_parts(monkeypatch):
    """Shared counts and links of a cell, against Python's sets, however it is cut."""
    r = np.random.default_rng(3)
    base = np.arange(1, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[r.choice(base, 55, replace=False), r.integers(100, 110, r.integers(0, 8)).astype(np.uint64)]) for _ in range(23)]
    plain = [set(x.tolist()) for x in sets]
    assert (jac.shared_counts(sets[:9], sets[9:]) == [[len(a & b) for b in plain[9:]] for a in plain[:9]]).all()
    weights, own = r.integers(1, 5, 23), r.integers(0, 2, 23)
    near = np.array([[i != j and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(plain)] for i, a in enumerate(plain)])
    assert 23 < near.sum() < 23 * 22
    for block in (2, 7, 512):
        monkeypatch.setattr(jac, "BLOCK", block)
        for cell in (own, np.zeros(23, int)):
            want = near & (cell[:, None] != cell[None]) if cell.any() else near
            links, root = jac._verified(sets, cell, weights, (4, 5))
            assert (links == want @ weights).all() and (root == jac._forest(23, *np.nonzero(want))).all()


def test_one_of_each_group_stays(spark, near):
    kept = jac.keep_first(near)
    classes = {r.class_id for r in jac.near_duplicates(near).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(classes) and kept.columns == near.columns
    assert jac.keep_first(near.limit(0)).count() == 0 and jac.near_duplicates(near.limit(0)).count() == 0


def test_bands():
    assert jac.bands_for(0.8) == (15, 4)
    b, r = jac.bands_for(0.8, 0.99, 128)
    assert 1 - (1 - 0.8**r) ** b >= 0.99


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60) if i != 30] + [("x", "x")], "a string, b string")
    got = {r.node: r.component for r in components(edges).collect()}
    assert {got[f"{i:03d}"] for i in range(31)} == {"000"} and {got[f"{i:03d}"] for i in range(31, 61)} == {"031"}


# --- leaks


def plain_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dec.MATCH if a[i - 1] == b[j - 1] else dec.MISS), h[i - 1][j] + dec.GAP, h[i][j - 1] + dec.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment():
    r = random.Random(2)
    a = [np.array([r.randint(1, 6) for _ in range(r.randint(1, 15))]) for _ in range(200)]
    b = [np.array([r.randint(0, 6) for _ in range(r.randint(1, 25))]) for _ in range(200)]
    score, begin, end = dec.align(a, b)
    assert score.tolist() == [plain_alignment(x, y) for x, y in zip(a, b, strict=True)]
    assert all(plain_alignment(x, y[lo:hi]) == s for x, y, s, lo, hi in zip(a, b, score, begin, end, strict=True))


@pytest.fixture(scope="module")
def leak_tables(spark):
    r = random.Random(7)
    word = lambda: f"w{r.randint(0, 3000)}"
    items = [[word() for _ in range(r.randint(12, 40))] for _ in range(15)] + [["tiny", "item"]]
    docs, want = [], set()
    for d in range(120):
        text = [word() for _ in range(r.randint(5, 150))]
        if d % 3 == 0:
            i = r.randrange(len(items))
            passage = list(items[i])
            if len(passage) > 5:
                for _ in range(len(passage) // 8):  # edits
                    k = r.randrange(len(passage))
                    passage[k : k + 1] = r.choice([[], [word()], [passage[k], word()]])
            text[2:2] = passage
            want.add((d, i))
        docs.append((d, " ".join(text).upper() if d % 2 else ", ".join(text), "s", 1.0))
    docs += [(500, None, "s", 1.0), (501, "", "s", 1.0), (None, " ".join(items[3]), "s", 1.0), (502, "z " * 60_000 + " ".join(items[4]), "s", 1.0), (503, " ".join(items[0]), "s", 1.0), (503, " ".join(items[0]), "s", 1.0)]
    want |= {(None, 3), (502, 4), (503, 0)}
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "?!")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string, score double"), spark.createDataFrame(bench, "item_id long, text string"), want


@pytest.mark.parametrize("most", [dec.ITEMS_BYTES, 500])
def test_leaks_are_found(spark, leak_tables, most):
    docs, bench, want = leak_tables
    rows = dec.alignments(docs, bench, items_bytes=most).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and sum(r.doc_id == 503 for r in rows) == 2


def test_leaking_documents_go(spark, leak_tables):
    docs, bench, want = leak_tables
    kept = dec.without_leaks(docs, bench)
    leaked = {d for d, _ in want}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in leaked)
    assert dec.without_leaks(docs, bench.limit(0)).count() == docs.count() and dec.alignments(docs.limit(0), bench).count() == 0


def test_frequent_passage_keeps_seeds(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(i, item + f" tail{i}") for i in range(50)], "doc_id long, text string")
    assert dec.alignments(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 50


@pytest.mark.parametrize("exact", [0, 600])
def test_edited_copies_of_frequent_passages(spark, exact):
    item = [f"q{i}" for i in range(20)]
    edited = [x for i, x in enumerate(item) if i % 5 != 4]  # four words in a row at most
    texts = [item + [f"tail{i}"] for i in range(exact)] + [edited + [f"end{i}"] for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert dec.alignments(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).count() == len(texts)
    odd = spark.createDataFrame([(0, " ".join(item[:5] + ["x"] + item[6:11] + ["x"] + item[12:17] + ["x"] + item[18:]))], "doc_id long, text string")
    assert dec.alignments(docs.union(odd), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).count() == len(texts) + 1


def test_hits_in_parts(spark, leak_tables, monkeypatch):
    docs, bench, want = leak_tables
    monkeypatch.setattr(dec, "HITS", 7)
    items = dec.Items([(r.text or "").encode() for r in bench.collect()])
    texts = [(r.text or "").encode() for r in docs.collect()]
    ids, begins = items.read(texts)
    sizes = np.diff(np.r_[begins, len(ids)]) - dec.GRAM
    few = sorted(dec._leaks(items, ids, begins, sizes, 0.5))
    monkeypatch.setattr(dec, "HITS", 1 << 20)
    assert few == sorted(dec._leaks(items, ids, begins, sizes, 0.5)) and len(few) >= len(want)


def test_leaks_in_unspaced_scripts_and_beside_typographic_signs(spark):
    items = [(1, "春眠不覚暁処処聞啼鳥"), (2, "seven brown foxes")]
    docs = [(1, "昔の人は春眠不覚暁処処聞啼鳥と歌った。"), (2, "They said\u2014\u201cseven brown foxes\u201d\u2026"), (3, "全く関係のない文章です"), (4, "caf\u00e9 foxes")]
    out = dec.alignments(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(1, 1), (2, 2)]
