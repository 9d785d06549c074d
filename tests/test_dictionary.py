"""Dictionaries against a plain version, in both forms; rows without ids; columns of the caller's with any names."""

import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import classify, detect, dictionary
from veilspark.sources import sinks

BOTH = pytest.mark.parametrize("most", [1 << 20, 0])


def plain_scrub(t, values):
    for v in sorted({v for v in values if v and t and v in t}, key=lambda v: (-len(v), v)):
        t = t.replace(v, "<REDACTED>")
    return t


def case(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé日") for _ in range(rng.randrange(1, 12)))
    values = [(rng.choice("xyz"), word()) for _ in range(60)] + [("x", None), ("x", ""), ("y", "a"), ("z", "a")]
    texts = [(rng.choice([None, 1, 2, i]), rng.choice([None, "", " ".join(word() for _ in range(rng.randrange(30)))])) for i in range(80)]
    return texts + texts[:10], values


@BOTH
@pytest.mark.parametrize("seed", [1, 2])
def test_dictionary(spark, most, seed):
    texts, values = case(seed)
    df = spark.createDataFrame(texts, "id long, text string")
    vf = spark.createDataFrame(values, "source string, value string").repartition(3)
    got = sorted(((r.id, r.source, r.value) for r in dictionary.matches(df, vf, most=most).collect()), key=str)
    assert got == sorted(((i, s, v) for i, t in texts if t for s, v in set(values) if v and v in t), key=str)
    out = [(r.id, r.scrubbed_text) for r in dictionary.scrub(df, vf, most=most).collect()]
    assert sorted(out, key=str) == sorted([(i, plain_scrub(t, [v for _, v in values])) for i, t in texts], key=str)


@BOTH
def test_no_row_stays_unscrubbed(spark, most):
    """Without an id, with a repeated one, or where the caller has columns of all names."""
    rows = [(None, "pay Alice now"), (None, "pay Alice now"), (7, "Alice"), (7, "Bob"), (8, None)]
    names = ("i_", "v_", "key", "found", "body", "value", "source", "scrubbed_text", "Key")
    df = spark.createDataFrame(rows, "id long, text string")
    for n in names[:-1]:
        df = df.withColumn(n, F.lit(n))
    vf = spark.createDataFrame([("x", "Alice"), ("x", "Bob")], "source string, value string")
    out = dictionary.scrub(df, vf, most=most)
    assert sorted(out.columns) == sorted(df.columns)
    got = [r.asDict() for r in out.collect()]
    assert sorted((str(r["id"]), r["scrubbed_text"]) for r in got if r["text"]) == [("7", "<REDACTED>"), ("7", "<REDACTED>"), ("None", "pay <REDACTED> now"), ("None", "pay <REDACTED> now")]
    assert len(got) == 5 and all(r[n] == n for r in got for n in names[:-2])
    assert dictionary.scrub(df.limit(0), vf, most=most).count() == 0
    assert [r.scrubbed_text for r in dictionary.scrub(df.limit(1), vf.limit(0), most=most).collect()] == ["pay Alice now"]
    assert dictionary.matches(df, vf.limit(0), most=most).count() == 0


@BOTH
def test_a_hot_value_and_a_long_text(spark, most):
    text = "x" * 300_000 + "needle in the stack" + "y" * 10
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "all of us here").when(F.col("id") == 1, text).otherwise("none").alias("text"))
    vf = spark.createDataFrame([("a", "all of us"), ("a", "needle in the stack"), ("b", "needles")], "source string, value string")
    got = dictionary.matches(df, vf, most=most).groupBy("value").count()
    assert {r.value: r["count"] for r in got.collect()} == {"all of us": 100, "needle in the stack": 1}


def test_the_index_asks_for_the_rarest_gram(spark):
    values = spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(200)] + [("abc",), ("é",)], "value string")
    index = dictionary.posted(values)
    assert index.count() == 202 and index.groupBy("gram").count().agg(F.max("count")).first()[0] <= 3
    bits = 1 << 15
    bitmap, lengths = dictionary.gram_filter(spark, index, bits)
    posted = np.array([r.gram for r in index.collect()])
    at = dictionary.slot(posted, bits)
    assert lengths == {2, 3, 6} and ((bitmap[at >> 3] >> (at & 7)) & 1).all() and np.unpackbits(bitmap).sum() <= 202
    assert dictionary.grams(np.frombuffer(b"abcd", np.uint8), 6).tolist() == [] and len(dictionary.grams(np.frombuffer(b"abcd", np.uint8), 2)) == 3


def test_texts_of_one_key_share_candidates_only(spark, monkeypatch):
    """Texts go by a number of 64 bits; those whose numbers are equal have what stands in each of them, no more."""
    vf = spark.createDataFrame([("x", "Alice"), ("x", "Bob")], "source string, value string")
    df = spark.createDataFrame([(1, "pay Alice"), (2, "pay Bob"), (3, "pay"), (4, None)], "id long, text string")
    assert dict(dictionary.indexed(df.select("text"), vf.select("value")).dtypes)["key"] == "bigint"
    monkeypatch.setattr(dictionary, "_key", lambda text: F.length(text).cast("long") * 0)
    assert sorted((r.id, r.value) for r in dictionary.matches(df, vf, most=0).collect()) == [(1, "Alice"), (2, "Bob")]
    assert sorted((r.id, r.scrubbed_text) for r in dictionary.scrub(df, vf, most=0).collect()) == [(1, "pay <REDACTED>"), (2, "pay <REDACTED>"), (3, "pay"), (4, None)]


def test_the_automata_of_an_executor_fit():
    """Four workers with the largest dictionary that is sent to them stay well under 4,000 MB; measured in a process of its own."""
    code = """
from veilspark.operators import dictionary
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
before, sources = rss(), {}
for i in range(400_000):
    sources.setdefault(f"Customer#{i:09d}", []).append("customers")
words = dictionary._automaton(list(sources))
print(4 * (rss() - before) / (400_000 * 18) * dictionary.BROADCAST_BYTES)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert float(said) < 1_500_000_000


def test_columns_of_the_callers_stay(spark):
    names = ("page_", "ext_", "text_", "ext", "body", "page", "veil_low_", "veil_counts_", "low", "found", "veil_text_", "policy")
    df = spark.createDataFrame([("a.html", "mail a@b.co", "C4")], "filename string, text string, level string")
    for n in names:
        df = df.withColumn(n, F.lit(n))
    for out in (sinks.rendered(df), classify.with_rule_features(df, "text", "features"), detect.redact(df, level="level"), detect.redact(df.withColumn("n", F.lit(5)), text="n")):
        r = out.first().asDict()
        assert all(r[n] == n for n in names) and set(df.columns) <= set(out.columns)
