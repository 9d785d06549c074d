"""Hard negatives, filter audits and licence scans against plain versions, with hot keys, ties, nulls and clashing columns."""

import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import filter_audit, hard_negatives, license_scan

VECTORS = "vec_id long, embedding array<double>, label int"


# --- hard negatives


def plain_negatives(rows, positives=5, k=10):
    ok = [(i, [math.floor(256 * x) for x in e], (lb + 1) % 10 if i % 7 == 0 else lb) for i, e, lb in rows if None not in (i, e, lb) and e and all(x is not None and math.isfinite(x) for x in e)]
    out, seen = [], set()
    for i, e, lb in sorted(ok, key=lambda r: (r[0], r[2])):
        if i % 100 or i in seen:
            continue
        seen.add(i)
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(e, f, strict=True)))), j, m) for j, f, m in ok if len(f) == len(e))
        best = [(p, -s) for s, p, m in scored if m == lb and p != i][:positives]
        for p, ps in best:
            fits = [(j, -s) for s, j, m in scored if m != lb and 30 * ps <= -100 * s <= 90 * ps][:k]
            out += [(i, p, r, j, ps, s) for r, (j, s) in enumerate(fits, 1)]
    return sorted(out)


def got_negatives(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS).withColumn("anchor", F.lit("x")).withColumn("score", F.lit(1)).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, **options).collect())


@pytest.mark.parametrize("digits", [2, 5, 16])
def test_hard_negatives_by_any_digits(spark, digits):
    rng = np.random.default_rng(digits)
    rows = [(i, rng.normal(size=6).round(3).tolist(), int(rng.integers(3))) for i in range(330)]
    assert got_negatives(spark, rows, digits=digits, block_rows=64, per_pack=2) == plain_negatives(rows)


def test_hard_negatives_with_ties_and_a_hot_vector(spark):
    rng = random.Random(5)
    hot = [0.5, 0.25, 0.0]
    rows = [(i, hot if i % 2 else [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(420)]
    want = plain_negatives(rows)
    assert len(want) > 50 and got_negatives(spark, rows, digits=3, block_rows=50, per_pack=3) == want


def test_hard_negatives_odd_rows(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 0.9], 0), (2, [0.5, 0.5], 1), (3, [0.6, None], 1), (4, [float("nan"), 1.0], 1), (5, None, 1), (6, [0.4, 0.4], None), (None, [1.0, 1.0], 1), (8, [0.5, 0.5], 1), (8, [0.5, 0.5], 1)]
    rows += [(9, [0.5], 1), (10, [], 0), (100, [-1.0, -1.0], 2), (200, [1e30, -1e30], 0), (201, [1e30, 3.0], 0), (202, [2e29, 0.0], 3)]
    assert got_negatives(spark, rows, block_rows=4) == plain_negatives(rows)
    assert got_negatives(spark, rows[:0]) == [] and got_negatives(spark, [(1, [1.0], 1)]) == [] and got_negatives(spark, [(0, [1.0], 1)]) == []


def test_histograms_leave_out_only_what_cannot_count():
    rng = np.random.default_rng(0)
    for _ in range(300):
        values = rng.integers(-50, 50, rng.integers(0, 40)).astype(np.int64)
        lo, hi, need, digits = -30, int(rng.integers(-30, 45)), int(rng.integers(1, 12)), int(rng.integers(1, 8))
        upwards = bool(rng.integers(2))
        found, n = hard_negatives.histogram(values, lo, hi, need, digits, upwards)
        shift = hard_negatives.shift_of(lo, hi, digits)
        whole = Counter((v - lo if upwards else hi - v) >> shift for v in values.tolist() if lo <= v <= hi)
        assert all(whole[b] == c for b, c in zip(found.tolist(), n.tolist(), strict=True))
        assert sum(n) >= min(need, sum(whole.values())) and all(b > max(found, default=-1) for b in set(whole) - set(found.tolist()))


def test_a_round_sends_each_vector_once(spark):
    rng = np.random.default_rng(1)
    rows = hard_negatives.usable(spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 3) for i in range(1, 401)], VECTORS))
    anchors = rows.where("vec_id % 20 = 0").select("vec_id", "label", "embedding")
    state = {"positive": "NULL", "positive_score": "NULL", "same": "true", "top": "900", "lo": "-900", "hi": "900", "by_id": "false", "id_lo": "NULL", "id_hi": "NULL", "need": "5", "settled": "false"}
    windows = anchors.selectExpr("vec_id AS anchor", *[f"CAST({v} AS {t}) AS {f}" for f, t in (x.split() for x in hard_negatives.STATE.split(", ")[1:]) for v in [state[f]]])
    blocks = hard_negatives.VectorBlocks(rows, 100)
    got = [r.asDict() for r in blocks.met(anchors, windows, 2).collect()]
    vectors, packs = [r for r in got if r["pack"] < 0], [r for r in got if r["pack"] >= 0]
    assert blocks.blocks == 4 and len(vectors) == 4 and sum(len(r["ids"]) // 8 for r in vectors) == 400
    assert sum(len(r["ids"]) // 8 for r in packs) == 4 * 20 and len(packs) > 4 * 4


def test_foremost_scores_have_the_whole_histogram():
    rng = np.random.default_rng(2)
    for _ in range(300):
        values = rng.integers(-50, 50, rng.integers(0, 60)).astype(np.int64)
        lo, hi, need, digits = -30, int(rng.integers(-30, 45)), int(rng.integers(1, 12)), int(rng.integers(1, 8))
        want = hard_negatives.histogram(values, lo, hi, need, digits, False)
        got = hard_negatives.histogram(hard_negatives.foremost(np.sort(values), lo, hi, need, digits), lo, hi, need, digits, False)
        assert [x.tolist() for x in got] == [x.tolist() for x in want]


# --- filter audit


def plain_audit(docs, labels):
    space = "\t\n\x0b\x0c\r "
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in range(2))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        words = [w for w in t.translate(str.maketrans(space, " " * 6)).split(" ") if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        parts[s or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        shapley, own = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = list(rows)
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[0]]
                failing = sum(f in r[0] for r in rows)
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(here)
                own.append((part, order, step, len(left), len(here), failing - len(here), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in own]
    return sorted(out)


def audit_case(seed):
    rng = random.Random(seed)
    texts = ["", None, "a", "A B C", "x " * 250, " ".join(f"w{i}" for i in range(210)), " ".join(f"w{i}" for i in range(210)) + " 100%", "é z " * 120, "\x0b\x0c w\x1cx", "hot text " * 30]
    docs = [(rng.choice([None, rng.randrange(60)]) if rng.random() < 0.1 else i, rng.choice(texts) if rng.random() < 0.6 else texts[-1], rng.choice([None, "", "s1", "s1", "s1", "s2"])) for i in range(160)]
    labels = [(rng.choice([None, rng.randrange(170)]) if rng.random() < 0.05 else rng.randrange(170), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    return docs, labels


@pytest.mark.parametrize("seed, held", [(1, 1 << 20), (2, 300)])
def test_filter_audit(spark, seed, held):
    docs, labels = audit_case(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("part", F.lit(1)).withColumn("mask", F.lit("m")).repartition(5)
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(2))
    assert sorted(tuple(r) for r in filter_audit.audit(df, lb, held).collect()) == plain_audit(docs, labels)


def test_filter_audit_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    lb = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(df, lb).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "x", "s")], df.schema), lb)
    assert one.count() == 600 and one.agg(F.sum("kept")).first()[0] < 600


def test_texts_that_share_a_fingerprint_stay_apart():
    held = filter_audit.Chains()
    one = Counter({("p", 0): 1})
    assert held.add(7, b"a", 5, one) is None and held.add(7, b"b", 3, one) is None and held.add(7, b"a", 5, one) is None
    assert held.add(7, b"b", 4, one) == (4, one) and held.add(7, b"a", 2, one) == (5, Counter({("p", 0): 2}))
    assert {(t, i) for _, t, i, _ in held.entries()} == {(b"a", 2), (b"b", 3)}
    out = list(filter_audit._decided(iter([(7, (b"a", 9, one)), (3, (None, 11, one)), (7, (b"a", 8, one)), (7, (b"c", 20, one))])))
    assert sorted(out) == [(8, "p", 0, 1), (9, "p", 16, 1), (11, "p", 16, 1), (20, "p", 0, 1)]


# --- licence scans

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"


def scanned(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"row": F.lit(1), "words": F.lit("w"), "label": F.lit("l"), **more})
    return {r.doc_id: r for r in license_scan.scan(df).collect()}


def test_license_scan_cases(spark):
    filler = " ".join(f"f{i}" for i in range(400))
    texts = [
        "Released under the MIT License. Under  the\nMIT-license!", "Apache License, Version 2.0; CC BY-NC 4.0, cc by nc", None, "", "undertheMIT license", "under the mit licenseé",
        f"{filler} {MIT} {filler}", MIT.replace("obtaining", "who is obtaining").replace("copy of", "copy, whole or in part, of"), MIT.replace("free of charge", "for a fee"),
        "This work is licensed under the GNU General Public License, version 3.", "version 3 of general public GNU license", f"{filler} under the mit license {filler} under the mit license", "GNU General Public License " + filler + " version 3",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. SPDX-License-Identifier: Apache-2.0",
    ]
    got = scanned(spark, texts)
    facts = lambda i: (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels)
    assert facts(0) == (9, 2, 1, 5, "mit", "mit") and facts(1) == (13, 3, 0, 10, "apache-2,cc-by-nc", "apache-2,cc-by-nc")
    assert facts(2) == facts(3) == (0, 0, None, None, "", "") and facts(4)[1:] == facts(5)[1:] == (0, None, None, "", "")
    assert facts(6)[1:] == facts(7)[1:] == (0, None, None, "", "mit") and facts(8)[-1] == "" and facts(9)[-1] == "gpl-3" and facts(10)[-1] == ""
    assert facts(11) == (808, 2, 400, 804, "mit", "mit") and facts(12)[-1] == "" and facts(13)[-1] == "apache-2,isc"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9].score > 0.9 and got[10].score == got[2].score == 0 and got[4].score == 0


def test_license_scan_equals_the_sql(spark):
    """Frequent words, repeats of a notice within a text, repeated rows and ids."""
    import duckdb

    rng = random.Random(3)
    sentences = [s for _, s, _ in license_scan.TEMPLATES] + ["under the MIT License", "apache license version 2", "CC-BY-NC"]
    vocabulary = sorted({w for s in sentences for w in license_scan.words_of(s)})
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(6)):
            words = license_scan.words_of(rng.choice(sentences))
            for _ in range(rng.randrange(4)):
                words.insert(rng.randrange(len(words)), rng.choice(vocabulary))
            parts += words + [rng.choice(["the", "of", "zzz", "Ünï"]) for _ in range(rng.randrange(40))]
        rows.append((rng.choice([i, 7, None]), None if i == 5 else " ".join(parts)))
    rows.append((99, " the license " * 3000 + MIT * 40))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    documents = df.toPandas().astype({"doc_id": "Int64"})  # noqa: F841 (the SQL reads it)
    want = duckdb.query(license_scan.ORACLE_SQL)
    names = [d[0] for d in want.description] if hasattr(want, "description") else want.columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in license_scan.scan(df).select(*names).collect()), key=key)
    assert got == sorted((tuple(None if x != x else x for x in r) for r in want.fetchall()), key=key)
    assert sum(r[names.index("labels")] != "" for r in got) > 30


def test_license_scan_stays_native_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(df).count() == 0
    plan = license_scan.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        license_scan.template_rows((("x", "one two", "three"),))
