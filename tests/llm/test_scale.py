"""Hot keys, periodic texts, recall, ids of other types and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_repeats import brute, plain_alignment
from veilspark.llm import brown_lm, common, decontaminate, jaccard_join, lpf_dedup, mil_toxicity, shuffle_shards


def test_key_filter(spark, monkeypatch):
    keys = spark.createDataFrame([(i * 7, None if i == 3 else f"k{i}") for i in range(3000)], "a long, b string")
    rows = spark.createDataFrame([(i, None if i == 21 else f"k{i // 7}", 1) for i in range(21_000)], "a long, b string, map_no int")
    known = {(r.a, r.b) for r in keys.collect()}
    for bits in (common.FILTER_BITS, 1 << 15):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        out = common.KeyFilter(keys, "a", "b").flagged(rows, "may", "a", "b")
        got = [((r.a, r.b), r.may) for r in out.collect()]
        assert out.columns == [*rows.columns, "may"] and len(got) == 21_000 and all(may for k, may in got if k in known)
        assert sum(may for k, may in got if k not in known) < (2500 if bits > 1 << 15 else 18_000)
    none = common.KeyFilter(keys.limit(0), "a", "b")
    assert none.hits(rows, "a", "b").count() == 0 and none.hits(rows.limit(0), "a", "b").count() == 0


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_folders_are_deleted(spark):
    before = common.staged()
    other = common.stage(spark.range(4), "test")
    with common.Folders() as mine:
        df = common.stage(spark.range(5), "test")
        kept = common.stage(spark.range(3), "test")
        with common.Folders() as inner:
            common.stage(spark.range(2), "test")
        assert common.staged() == before + 4 and kept.count() == 3
        mine.delete(spark, kept)
        assert common.staged() == before + 3 and kept.count() == 3
    inner.delete(spark)
    common.unstage(kept)
    assert common.staged() == before + 1 and other.count() == 4
    common.unstage(other)
    with pytest.raises(Exception):
        df.count()


def test_runs_delete_only_their_own_folders(spark):
    """Two runs at once, and a frame of the session that neither owns."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    step, bystander = Barrier(2), common.stage(spark.range(7), "test")

    def run(n):
        with common.Folders() as mine:
            docs = spark.range(n)
            for _ in range(3):
                extra = common.stage(docs, "test")
                docs = common.stage(docs.union(extra), "test")
                step.wait()
                mine.delete(spark, docs)
                step.wait()
            return docs, len(mine.paths)

    before = common.staged()
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(run, [3, 5]))
    assert [(d.count(), left) for d, left in done] == [(24, 1), (40, 1)] and bystander.count() == 7 and common.staged() == before + 2
    common.unstage(bystander, *[d for d, _ in done])


# --- repeated strings


def test_periodic_texts_make_few_segments():
    r = random.Random(1)
    for period in range(1, 51):
        unit = "".join(r.choice("abcdefgh ") for _ in range(period)).encode()
        data = np.frombuffer((unit * 6000)[:12_000], np.uint8)
        _, first, n, h, many = lpf_dedup.anchors(data, np.array([len(data)]), 200, lpf_dedup.GRAM)
        assert n.sum() == len(data) - 199 and (n + 199).sum() <= 3 * len(data) and (many > 1).any()


def test_periodic_texts_are_exact(spark):
    r = random.Random(2)
    rows = []
    for i, period in enumerate([1, 2, 3, 7, 50, 80, 199, 200, 201, 333]):
        unit = "".join(r.choice("abcdefgh ") for _ in range(period))
        rows.append((i, "start " + (unit * 900)[: r.randint(300, 900)] + " end"))
    rows += [(50, "y" * 9000), (51, "y" * 4500), (52, "ab" * 3000), (53, "line of a page\n" * 400 + "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep_first in (False, True):
        for hot in (lpf_dedup.HOT, 2000):
            got = sorted([tuple(x) for x in lpf_dedup.repeats(df, 200, keep_first, hot).drop("kept").collect()], key=repr)
            assert got == brute(rows, 200, keep_first)


# --- near duplicates


def planted(r, share=0.8, words=200):
    """Two texts whose sets of five-grams have a similarity a little over ``share``."""
    a = [f"v{r.randint(0, 10**6)}" for _ in range(words)]
    n = words - 4
    change = int(n * (1 - share) / (1 + share) / 1)  # five-grams that each side may have alone
    at = r.randint(0, words - change)
    b = a[:at] + [f"u{r.randint(0, 10**6)}" for _ in range(max(0, change - 4))] + a[at + max(0, change - 4) :]
    x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b))
    return " ".join(a), " ".join(b), len(x & y) / len(x | y)


def test_recall_at_the_threshold(spark):
    r = random.Random(9)
    rows, pairs = [], 0
    while pairs < 600:
        a, b, similar = planted(r)
        if 0.8 <= similar < 0.83:
            rows += [(2 * pairs, a), (2 * pairs + 1, b)]
            pairs += 1
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(x.class_id != x.doc_id for x in out) >= 0.99 * pairs and all(x.class_id // 2 == x.doc_id // 2 for x in out)


def test_large_mixed_bucket(spark, monkeypatch):
    """Texts that share most words fall in the same buckets without being near each other."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "WIDE", 9)
    r = random.Random(10)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = [f"o{i // 3}_{k}" for k in range(30)]
        rows.append((f"id{i:03}", " ".join(base + own + [f"x{i}"])))
    df = spark.createDataFrame(rows, "doc_id string, text string")
    out = {x.doc_id: x for x in jaccard_join.near_duplicates(df).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    for i, x in out.items():
        assert x.n_links == sum(5 * len(sets[i] & s) >= 4 * len(sets[i] | s) for j, s in sets.items() if j != i)


def test_rows_that_repeat_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [("a", text, 1, True, "k")] * 500 + [("b", text, 1, True, "k"), (None, text, 2, None, "k"), ("c", "alone", 3, None, None), (None, None, 4, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, class_of_text int, in_doubt boolean, id_key string")
    kept = jaccard_join.keep_first(df)
    assert kept.columns == df.columns and sorted((r.doc_id or "", r.class_of_text) for r in kept.collect()) == [("", 4), ("a", 1), ("c", 3)]
    bench = spark.createDataFrame([("i1", " ".join(f"w{i}" for i in range(12)))], "item_id string, text string")
    left = decontaminate.without_leaks(df.withColumnRenamed("id_key", "leak"), bench)
    assert sorted(r.class_of_text for r in left.collect()) == [3, 4] and {r.item_id for r in decontaminate.alignments(df, bench).collect()} == {"i1"}


# --- ids of another type


def test_string_ids(spark):
    r = random.Random(11)
    text = "".join(r.choice("abcdefgh ") for _ in range(600))
    rows = [(f"id{i}", text[i : i + 400] if i < 3 else " ".join(r.choice(["good", "bad", "word", f"n{i}"]) for _ in range(30))) for i in range(60)] + [(None, text)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    cut = {x.doc_id: x.n_removed for x in lpf_dedup.repeats(df).collect()}
    assert cut["id0"] == 0 and cut["id1"] > 300 and cut[None] > 300
    labels = spark.createDataFrame([(f"id{i}", i % 2) for i in range(60)], "doc_id string, toxic int")
    scored = mil_toxicity.toxicity_digest(df, labels)
    assert scored.count() == 61 and dict(scored.dtypes)["doc_id"] == "string"
    assert dict(mil_toxicity.locate(df, mil_toxicity.train(df, labels), 0.0).dtypes)["doc_id"] == "string"
    lm = brown_lm.scores(df)
    assert dict(lm.dtypes)["doc_id"] == "string" and lm.count() == 61
    assert shuffle_shards.shard_digest(df).count() == 61


# --- shards


def test_rows_alike_are_dealt_to_all_buckets(spark):
    rows = [(1, "same text", {"k": 1}, 5, 5, 5)] * 5000 + [(1, f"other {i}", None, 5, 5, 5) for i in range(300)] + [(i, None, {"k": i}, 5, 5, 5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, begin_ int, s_ int, b_ int").withColumn("nested", F.array("m"))
    out = shuffle_shards.shuffled(df, 4, bucket_bytes=4000)
    got = out.select("doc_id", "text", "begin_", "s_", "b_", "shard", "bucket", "slot").collect()
    assert out.columns == [*df.columns, "shard", "bucket", "slot"] and Counter((r.doc_id, r.text) for r in got) == Counter((x[0], x[1]) for x in rows)
    slots, alike = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        alike[r.bucket] += r.text == "same text"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(alike) > 10 and max(alike.values()) < 1.1 * 5000 / len([n for n in alike.values() if n > 0]) + 2
    again = shuffle_shards.shuffled(df.repartition(7), 4, bucket_bytes=4000)
    assert Counter(map(repr, again.select("doc_id", "text", "shard", "slot").collect())) == Counter(map(repr, out.select("doc_id", "text", "shard", "slot").collect()))


def test_nulls_hash_as_values(spark):
    df = spark.createDataFrame([(1, "x", None)] * 400 + [(1, None, "x")] * 400, "doc_id long, text string, lang string")
    got = Counter((r.text, r.lang) for r in shuffle_shards.shuffled(df, 2, bucket_bytes=500).collect())
    assert got == {("x", None): 400, (None, "x"): 400}


# --- leaks


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.2])
def test_recall_against_exhaustive_alignment(spark, rate):
    r = random.Random(int(rate * 100))
    word = lambda: f"w{min(int(r.expovariate(0.004)), 2500)}"
    items = [[word() for _ in range(r.randint(15, 45))] for _ in range(12)]
    docs = []
    for _ in range(90):
        i = r.randrange(len(items))
        passage = []
        for w in items[i]:
            x = r.random()
            passage += [] if x < rate / 3 else [word()] if x < 2 * rate / 3 else [w, word()] if x < rate else [w]
        head = [word() for _ in range(r.randint(0, 30))]
        docs.append(head + passage + [word() for _ in range(r.randint(0, 30))])
    frames = (spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], schema) for rows, schema in ((docs, "doc_id long, text string"), (items, "item_id long, text string")))
    found = {(x.doc_id, x.item_id): x.score for x in dec_alignments(*frames)}
    score = {(d, i): plain_alignment(item, doc) / (2 * len(item)) for d, doc in enumerate(docs) for i, item in enumerate(items)}
    want = {k for k, s in score.items() if s >= 0.5}
    assert len(want) >= 80 and set(found) <= want and len(want & set(found)) >= 0.98 * len(want)
    assert all(abs(found[k] - score[k]) < 1e-9 for k in found)


def dec_alignments(docs, bench):
    return decontaminate.alignments(docs, bench).collect()


# --- toxicity


def test_scores_are_noisy_or_of_sentences():
    model = mil_toxicity.Model({"awful": 3.0, "aw": 0.0, "nasty": 2.5, "nast*": 0.5}, -2.0)
    plain = lambda t: 1 - np.prod([1 - p for p in (1 / (1 + np.exp(-z)) for z in t)])
    assert abs(model.score("An awful day! Nasty, nasty words.\nNothing.") - plain([1.0, 1.0, -2.0])) < 1e-12
    assert model.score(None) == model.score("") == model.score("123 . 45") == 0.0
    assert np.allclose(model.sentence_scores("awful. fine"), [1 / (1 + np.exp(-1)), 1 / (1 + np.exp(2))])


def test_fit_makes_the_labels_likelier(monkeypatch):
    """Steps go down the likelihood's own slope: no small move of a weight is better where the steps have ended."""
    monkeypatch.setattr(mil_toxicity, "STEPS", 3000)
    monkeypatch.setattr(mil_toxicity, "RATE", 0.02)
    monkeypatch.setattr(mil_toxicity, "MIN_DF", 1)
    r = random.Random(3)
    texts, labels = [], []
    for _ in range(80):
        y = r.random() < 0.4
        texts.append(". ".join(" ".join(r.choice(["ab", "cd", "ef"] + ["zz"] * (y and k == 0)) for _ in range(3)) for k in range(3)))
        labels.append(int(y))
    model = mil_toxicity.fit(texts, labels)

    def loss(weights, bias):
        m, out = mil_toxicity.Model(weights, bias), 0.0
        for t, y in zip(texts, labels, strict=True):
            q = mil_toxicity.FLIPPED + (1 - 2 * mil_toxicity.FLIPPED) * m.score(t)
            out -= np.log(q if y else 1 - q) / len(texts)
        return out + mil_toxicity.RIDGE / 2 * sum(w * w for w in weights.values())

    at = loss(model.weights, model.bias)
    for name in model.weights:
        slope = (loss(model.weights | {name: model.weights[name] + 1e-4}, model.bias) - loss(model.weights | {name: model.weights[name] - 1e-4}, model.bias)) / 2e-4
        assert abs(slope) < 5e-3
    assert at < loss(dict.fromkeys(model.weights, 0.0), model.bias)


# --- language model


def test_score_from_counts(spark, monkeypatch):
    """The model's score, word by word, from plain counts and the classes that the clustering gave."""
    seen = {}
    whole = brown_lm.clustered

    def caught(near, of, k=brown_lm.CLASSES):
        seen["of"], grid = whole(near, of, k)
        return seen["of"], grid

    monkeypatch.setattr(brown_lm, "clustered", caught)
    r = random.Random(5)
    vocabulary = [f"t{i}" for i in range(150)]
    rows = [(d, " ".join(vocabulary[min(int(r.expovariate(0.03)), 149)] for _ in range(r.randint(0, 50)))) for d in range(200)] + [(777, None), (778, "never seen words t1")]
    out = {x.doc_id: x.score for x in brown_lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import zlib

    train = [brown_lm.tokens((t or "").encode()) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in t)
    order = sorted(count, key=lambda w: (-count[w], w))
    k = brown_lm.CLASSES
    of = dict(zip(order, seen["of"].tolist(), strict=True))
    unseen = 0  # no rare words: the first class
    members, mass = Counter(of.values()), Counter()
    for w, n in count.items():
        mass[of[w]] += n
    members[unseen] += 1
    pair, before, into = Counter(), Counter(), Counter()
    for t in train:
        last = of[brown_lm.END]
        for w in t:
            pair[last, of[w]] += 1
            before[last] += 1
            into[of[w]] += 1
            last = of[w]
    total = sum(into.values())
    for i, t in rows:
        log, last = 0.0, of[brown_lm.END]
        for w in brown_lm.tokens((t or "").encode()):
            c = of.get(w, unseen)
            share = (into[c] + 1) / (total + k)
            move = (pair[last, c] + share) / (before[last] + 1)
            emit = (count[w] + brown_lm.ADD) / (mass[c] + brown_lm.ADD * max(members[c], 1))
            inner = (into[c] + brown_lm.ADD) / (into[c] + brown_lm.ADD)  # one symbol a class
            log += np.log10(move * emit * inner)
            last = c
        assert abs(out[i] - log) < 1e-6 * max(1, abs(log)), i


def test_exchange_never_lowers_the_likelihood():
    r = np.random.default_rng(7)
    pairs = r.poisson(r.random((40, 40)) * 3).astype(float)

    def likelihood(of):
        m = np.zeros((40, 6))
        m[np.arange(40), of] = 1
        return brown_lm.likelihood(m.T @ pairs @ m)

    levels = [likelihood(brown_lm.exchange(pairs, 6, n)) for n in range(8)]
    assert all(b >= a - 1e-9 for a, b in zip(levels, levels[1:], strict=False)) and levels[-1] > levels[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert brown_lm.scores(none).count() == 0 and shuffle_shards.shard_digest(none).count() == 0
    assert pa.Table.from_batches(list(common.whole_groups(iter([]), ["a"])) or [], pa.schema([])).num_rows == 0


# --- pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on a small corpus against the plainest code for it, on that stage's own input."""
    import duckdb
    import sentencepiece

    import corpus_pipeline
    from veilspark.llm.queries import PIECE_MODEL

    r = random.Random(13)
    word = lambda: f"word{r.randint(0, 800)}"
    passage = " ".join(f"Passage{i}" for i in range(60))
    item = [word() for _ in range(24)]
    docs, labels = [], []
    for d in range(260):
        t = [word() for _ in range(r.randint(20, 90))]
        if d % 5 == 0:
            t[r.randrange(len(t))] = "awful"
        labels.append((d, 1, int(d % 5 == 0)))
        if d % 17 == 3:
            t[5:5] = passage.split()
        if d % 23 == 4:
            t[7:7] = item[:10] + ["odd"] + item[11:]
        docs.append((d, ". ".join(" ".join(t[k : k + 9]) for k in range(0, len(t), 9)), "en", "web", 0))
    near = [(1000 + d, docs[d][1] + " one more", "en", "web", 0) for d in range(1, 40, 6)] + [(2000 + d, docs[d][1], "en", "web", 0) for d in range(2, 40, 6)]
    docs += [*near, (3000, None, "en", "web", 0), (3001, "", None, None, None), (2, docs[2][1], "en", "web", 0)]
    docs = [(i, t, a, b, len(t or "")) for i, t, a, b, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def toxicity(rows):
        model = mil_toxicity.train(frame(rows), spark.read.parquet(f"{tmp_path}/labels.parquet"))
        return [x for x in rows if model.score(x[1]) < 0.3]

    def near_duplicates(rows):
        con = duckdb.connect()
        con.register("documents", frame(rows).select("doc_id", "text").toPandas())
        first = {i for i, c in con.sql(f"SELECT doc_id, class_id FROM ({jaccard_join.ORACLE_SQL})").fetchall() if i == c}
        return sorted({x for x in rows if x[0] in first}, key=repr)

    def repeated_passages(rows):
        cut = {x[0]: x[4] for x in brute([(x[0], x[1]) for x in rows], 200, True)}
        return [(x[0], cut[x[0]], *x[2:4]) for x in rows]

    def benchmark_passages(rows):
        a = [w.encode().lower() for w in item]
        return [x for x in rows if plain_alignment(a, decontaminate.words((x[1] or "").encode())) < len(a)]

    def frame(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    import hashlib

    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, apply), plain in zip(corpus_pipeline.STAGES[:-1], (toxicity, near_duplicates, repeated_passages, benchmark_passages), strict=True):
        rows = [tuple(x) for x in seen.collect()]
        seen = common.stage(apply(spark, seen, str(tmp_path)), "test")
        got = [tuple(x) for x in seen.collect()]
        if plain is repeated_passages:
            assert all(x[4] == len(x[1]) for x in got)
            got = [(x[0], hashlib.sha256(x[1].encode()).hexdigest(), *x[2:4]) for x in got]
        assert 0 < len(got) and sorted(got, key=repr) == sorted(plain(rows), key=repr), name
        assert name == "repeated passages" or len(got) < len(rows)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(x.doc_id, tuple(x.ids), x.decoded) for x in out} == {(x.doc_id, tuple(lib.encode(x.text or "", add_eos=True)), x.text or "") for x in seen.collect()}
    (tmp_path / "none").mkdir()
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_groups_are_cut_only_between_free_rows():
    words = [f"w{i // 40:02d}" for i in range(400)]
    batches = pa.RecordBatch.from_pydict({"word": words, "held": [i % 40 >= 5 for i in range(400)]})
    out = list(common.whole_groups((batches.slice(k, 7) for k in range(0, 400, 7)), ["word"], 10, free="held"))
    assert [w for t in out for w in t.column("word").to_pylist()] == words and max(t.num_rows for t in out) < 40
    for a, b in zip(out, out[1:], strict=False):
        assert b.column("held")[0].as_py() or a.column("word")[-1].as_py() != b.column("word")[0].as_py()


def test_rare_words_of_texts_that_nobody_learns_from_have_the_count_of_the_others(spark, monkeypatch):
    """A word's rows are cut in many tables; its count and class go on."""
    import zlib

    monkeypatch.setattr(brown_lm, "ROWS", 1)
    rows = [(i, f"a b rare{i % 4} c" if zlib.crc32(str(i).encode()) % 10 else f"a rare{i % 4} new b") for i in range(300)]
    words = spark.sparkContext.broadcast([b"", b"a", b"b", b"c"])
    texts = brown_lm.keyed(spark.createDataFrame(rows, "doc_id long, text string")).repartition(1)
    got = brown_lm.rare_words(texts, words, np.zeros(4, np.int64), np.ones((2, 2))).collect()
    learnt = Counter(i % 4 for i, t in rows if "new" not in t)
    assert len(got) == sum(2 if "new" in t else 1 for _, t in rows) and sum(r["first"] for r in got) == 4
    assert sorted(r["n"] for r in got) == sorted([learnt[i % 4] for i, _ in rows] + [0 for _, t in rows if "new" in t])
    assert all((r["class"] is None) == (r["n"] == 0) for r in got)


def test_rows_alike_get_the_rare_words_of_each_other(spark, monkeypatch):
    """Copies in id and text meet their words in one task, in slices of a row."""
    monkeypatch.setattr(brown_lm, "FREQUENT", 3)
    rows = [(7, "a b r1 r2 a") for _ in range(40)] + [(8, "a b r1 r2 a"), (None, "a b r1 r2 a"), (None, "b r2"), (0, "b r2"), (None, None)] + [(20 + i, "a b a b") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted(map(repr, brown_lm.scores(df).drop("score").collect()))
    monkeypatch.setattr(brown_lm, "SLICE_BYTES", 8)
    assert sorted(map(repr, brown_lm.scores(df).drop("score").collect())) == whole and len(whole) == len(rows)
    assert all(r.n_known == r.n_tokens for r in brown_lm.scores(df).collect())


def test_rare_words_travel_in_packs(spark, monkeypatch):
    """Rows that travel are as many as slices and packs, not as words and texts; what is in them is the same, however they are cut."""
    rows = [(i, " ".join(f"r{(i * j) % 97}" for j in range(20)) + " a") for i in range(400)]
    words = spark.sparkContext.broadcast([b"", b"a"])
    texts = brown_lm.keyed(spark.createDataFrame(rows, "doc_id long, text string")).repartition(2)
    packed = brown_lm.packed_words(texts, words, np.zeros(2, np.int64), np.ones((2, 2)), 3)
    whole = sorted(map(repr, brown_lm.rare_words(texts, words, np.zeros(2, np.int64), np.ones((2, 2))).drop("first").collect()))
    assert packed.count() <= 3 * 4 < len(whole) == sum(len({(i * j) % 97 for j in range(20)}) for i, _ in rows)
    monkeypatch.setattr(brown_lm, "FLUSH", 5)
    monkeypatch.setattr(brown_lm, "SLICE_BYTES", 100)
    cut = brown_lm.rare_words(texts, words, np.zeros(2, np.int64), np.ones((2, 2)))
    assert sorted(map(repr, cut.drop("first").collect())) == whole and cut.where("first").count() == len({w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split()[:-1]})


def test_slices_of_a_task_share_rows_of_packs(spark, monkeypatch):
    """A task sends a row for each part of what it has read, not of each slice; long words are sent on by their bytes."""
    made = []
    monkeypatch.setattr(brown_lm, "lean", lambda run: made.append(run) or run)
    monkeypatch.setattr(brown_lm, "SLICE_BYTES", 100)
    words = spark.sparkContext.broadcast([b"", b"a", b"b"])
    texts = [" ".join(f"r{(i * j) % 97}" for j in range(20)) + " a b" for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"x": list(range(400)), "held": [i % 10 == 0 for i in range(400)], "text": texts, "y": list(range(400))})
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    brown_lm.neighbours(df, words)
    assert sum(b.num_rows for b in made.pop(0)(iter([batch.select(["text"])]))) == 3  # a row for each word's group
    made.clear()
    brown_lm.packed_words(brown_lm.keyed(df), words, np.zeros(3, np.int64), np.ones((2, 2)), 3)
    assert sum(b.num_rows for b in made[0](iter([batch]))) == 2 * 3  # parts, learnt from and held out
    monkeypatch.setattr(brown_lm, "NAME_BYTES", 1000)
    cut = [b for b in made[0](iter([batch]))]
    assert len(cut) > 10 and sum(len(s) for b in cut for s in b.column("size").to_pylist()) // 4 == sum(len({*t.split()} - {"a", "b"}) for t in texts)


def test_words_are_split_by_arrow_as_by_python():
    texts = [chr(i).join(["A", "B", "", ""]) for i in range(0x180)] + [None, "", " ", "\t\r\n", " a", "a ", "a  \x0b\x0cB\u3000C\x85d \x1c e"]
    want = [brown_lm.tokens(None if t is None else t.encode()) for t in texts]
    assert brown_lm.split_tokens(pa.array(texts)).to_pylist() == want
    assert brown_lm.split_tokens(pa.array(texts).slice(100, 280)).to_pylist() == want[100:380]
    number, text, flat = brown_lm.Symbols([b"b", b"", b"a"]).read(pa.array(texts))
    assert flat.to_pylist() == [w for ws in want for w in ws] and text.tolist() == [i for i, ws in enumerate(want) for _ in ws]
    assert number.tolist() == [{b"b": 0, b"": 1, b"a": 2}.get(w, 3) for ws in want for w in ws]


def test_words_of_one_place_get_the_class_that_the_counts_give():
    r = np.random.default_rng(3)
    k = 6
    grid = r.integers(1, 400, (k + 1, k + 1)).astype(float)
    word = np.r_[np.arange(60), r.integers(30, 60, 90)]
    c = np.stack([r.integers(0, k + 1, 150), r.integers(0, k + 1, 150) + k + 1], 1).astype(np.uint8)
    near = np.zeros((60, 2 * (k + 1)))
    np.add.at(near, (word, c[:, 0]), 1)
    np.add.at(near, (word, c[:, 1]), 1)
    n, tag = brown_lm._rare_classes(word, c, 60, grid, brown_lm._single_classes(grid))
    assert (n == np.bincount(word)).all() and (n == 1).sum() >= 30 and (tag == brown_lm.affinity(grid, near).argmax(1)).all()
