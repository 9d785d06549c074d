"""Toxicity on held-out documents, class language model and top-k search against brute force, pipeline and registry."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from veilspark.llm import bitsliced, brown_lm, mil_toxicity, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(1)
    calm, bad = [f"calm{i}" for i in range(60)], ["awful", "nasty", "vilemouthed"]
    docs, labels = [], []
    for d in range(900):
        t = [r.choice(calm) for _ in range(r.randint(5, 60))]
        y = int(r.random() < 0.3)
        if y:
            t[r.randrange(len(t))] = r.choice(bad)
        docs.append((d, ". ".join(" ".join(t[k : k + 8]) for k in range(0, len(t), 8)), 0.5, "x"))
        labels.append((d, y))
    docs += [(2000, None, 0.5, "x"), (2001, "", 0.5, "x"), (None, "awful", 0.5, "x"), (2002, "calm1 " * 40_000, 0.5, "x"), (5, docs[5][1], 0.5, "x")]
    labels += [(3, None), (None, 1), (5, labels[5][1])]
    return spark.createDataFrame(docs, "doc_id long, text string, score double, held_out string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_toxicity(spark, toxic):
    docs, labels, truth = toxic
    rows = mil_toxicity.toxicity_digest(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    tested = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    assert {r.predicted for r in rows if r.doc_id in (2000, 2001, 2002)} == {0}
    model = mil_toxicity.train(docs, labels)
    for r in mil_toxicity.locate(docs, model, 0.3).collect():
        assert any(w in r.sentence for w in ("awful", "nasty", "vilemouthed"))


def test_no_labels(spark, toxic):
    docs, labels, _ = toxic
    assert {r.predicted for r in mil_toxicity.toxicity_digest(docs, labels.limit(0)).collect()} == {0}
    assert mil_toxicity.toxicity_digest(docs.limit(0), labels).count() == 0


# --- language model


@pytest.mark.parametrize("frequent", [131_072, 20])
def test_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
    r = random.Random(4)
    groups = [[f"{c}{i}" for i in range(40)] for c in ("Noun", "verb", "é")]
    rows = [(d, " ".join(r.choice(groups[k % 3]) for k in range(r.randint(3, 40)))) for d in range(300)]
    rows += [(None, "Noun1 UNSEEN"), (1000, None), (1001, ""), (1002, "dup zzz"), (1002, "dup zzz"), (1002, "other\x0bzz"), (1003, "long " * 20_000)]
    docs = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, text string, n int, score double")
    out = brown_lm.scores(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted([(i, held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 4)) for i, t in rows], key=repr)
    assert sorted([(*tuple(x)[:5], round(x.base_score, 4)) for x in out], key=repr) == want
    ours = [x for x in out if x.doc_id is not None and x.doc_id < 1000 and x.held_out]
    assert frequent == 20 or sum(x.score for x in ours) > 0.8 * sum(x.base_score for x in ours)  # classes tell what follows what


def test_probabilities_sum_to_one():
    r = np.random.default_rng(1)
    pairs = r.integers(0, 20, (12, 12)).astype(float)
    of = brown_lm.exchange(pairs, 4, 50)
    model = brown_lm.Model(pairs, of, np.zeros(12))
    assert np.allclose((10**model.steps).sum(1), 1)
    # no single move makes the classes likelier
    def likelihood(of):
        m = np.zeros((12, 4))
        m[np.arange(12), of] = 1
        g = m.T @ pairs @ m
        return brown_lm._xlogx(g).sum() - brown_lm._xlogx(g.sum(0)).sum() - brown_lm._xlogx(g.sum(1)).sum()
    assert all(likelihood(np.r_[of[:w], k, of[w + 1 :]]) <= likelihood(of) + 1e-6 for w in range(12) for k in range(4))


@pytest.mark.parametrize("frequent", [131_072, 500])
def test_classes_come_from_contexts_beyond_the_frequent_words(spark, monkeypatch, frequent):
    """Words that end alike but stand in other places, far more than are clustered one by one."""
    monkeypatch.setattr(brown_lm, "FREQUENT", frequent)
    r = random.Random(8)
    kinds = [[f"{c}{i}zz" for i in range(900)] for c in "abc"]
    docs = [(d, " ".join(kinds[k % 3][min(int(r.expovariate(0.004)), 899)] for k in range(60))) for d in range(1500)]
    out = brown_lm.scores(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").collect()
    gain = sum(x.score - x.base_score for x in out) / sum(x.n_tokens for x in out)
    assert gain > 0.35  # of log10(3) = 0.477 that the places tell


def test_no_training_documents(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    rows = brown_lm.scores(docs).collect()
    assert rows and all((r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) for r in rows)


# --- top-k


def brute_top(rows, k):
    usable = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and len(v) == 6]
    out = []
    asked = {}
    for i, v in sorted((i, v) for i, v in rows if i is not None and i % 50 == 0 and v is not None and all(x is not None and math.isfinite(x) for x in v) and len(v) == 6):
        asked.setdefault(i, v)
    for q, v in asked.items():
        qv = np.floor(256 * np.array(v, np.float64)).astype(int)
        best = sorted(((-int(qv @ x), i) for i, x in usable if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [32_768, 30])
def test_top_k(spark, block):
    r = random.Random(6)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 0.33, 2.0]) for _ in range(6)]) for i in range(400)]
    rows += [(7, rows[7][1])] * 3 + [(50, [0.1] * 6), (450, None), (451, [None] * 6), (452, [float("nan")] * 6), (500, [float("inf")] * 6), (453, [1.0]), (None, [1.0] * 6), (1000, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = sorted(tuple(x) for x in bitsliced.top_k(df, df.where("vec_id % 50 = 0"), 5, block, 3).collect())
    assert got == brute_top(rows, 5)
    assert bitsliced.top_k(df.limit(0), df, 5).count() == 0 and bitsliced.top_k(df, df.limit(0), 5).count() == 0


def test_sliced_scores():
    r = np.random.default_rng(2)
    for size in (256, 3, 2**40):
        values = r.integers(-size, size, (130, 9))
        block = bitsliced.SlicedBlock(values)
        asked = r.integers(-300, 300, (20, 9))
        asked[0], asked[1] = 0, -1
        total, offset = block.scores(asked)
        for q in range(20):
            bits = (total[:, q][:, np.arange(130) // 64] >> (np.arange(130) % 64).astype(np.uint64)) & np.uint64(1)
            got = [sum(int(b) << j for j, b in enumerate(bits[:, k])) + offset[q] for k in range(130)]
            assert got == [sum(int(x) * int(w) for x, w in zip(v, asked[q])) for v in values]


def test_large_components_and_several_lengths(spark):
    r = random.Random(8)
    rows = [(i, [r.choice([3e6, -3e6, 0.5, 2_999_999.996]) for _ in range(4 if i % 3 else 6)]) for i in range(300)]
    rows += [(300 + i, [float(i)]) for i in range(3)] + [(400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in bitsliced.top_k(df, df.where("vec_id % 50 = 0"), 5, 40, 3).collect())
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q, v in whole.items():
        if q % 50 == 0 and v:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and max(s for *_, s in got) > 2**53
    with pytest.raises(ValueError):
        bitsliced.quantise(np.array([1e300]))


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, seen, SF)
        assert out.columns == docs.columns, name
        assert out.select("doc_id").subtract(seen.select("doc_id")).count() == 0
        from veilspark.llm.common import stage

        seen = stage(out, "test")
        assert 0 < seen.count() <= docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert last.count() == seen.count() and last.where("size(ids) <> n_tokens").count() == 0


def test_registry():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(queries.oracle_sql()) <= set(names)
