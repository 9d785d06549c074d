"""Redaction against a separate model of its rules, hand cases, and the native form against the Arrow form."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect
from veilspark.operators.patterns import LEVELS, PATTERNS, compiled
from veilspark.plans import queries as plans

HAND = {
    "pay BE71096123456769 now please ok": "pay [IBAN]ase ok",
    "acct 12345678901 x": "[ACCOUNT_NUMBER]",
    "call +32 11 222 333 or a.b@example.com": "call [PHONE]or [EMAIL]",
    "irises iris FaceID": "irises [BIOMETRIC_DATA] [BIOMETRIC_DATA]",
    "": "",
    "nothing here": "nothing here",
}
ODD = [
    "é2024-01-02 and 2024-01-02", "EUR 12 000.50 or €1,000.25", "phone 012 345 678 9 0", "🙂 a@b.co 🙂 2024-05-06", "[EMAIL] a@b.co", "ID ABC123XYZ identity ID:QQQQQQ",
    "account 123 Acct9999 USD 5", "123456-7890 and 123456 78", "ıris İRIS iris", "x" * 5000 + " a@b.co", "a@b.co \ue000 c@d.co", "acct 123 é acct 456 \ue000",
]


def model(text, types=None):
    names = [p.type for p in PATTERNS] if types is None else types
    spans = []
    for k, name in enumerate(names):
        p = next(p for p in PATTERNS if p.type == name)
        spans += [(-m.start(), k, m.end(), p, m.group()) for m in re.compile(p.regex, re.I).finditer(text)]
    spans.sort(key=lambda s: s[:2])
    for start, _, end, p, _ in spans:
        text = text[:-start] + p.placeholder + text[end:]
    return text, [(p.type, m, p.placeholder) for _, _, _, p, m in reversed(spans)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*HAND, *ODD])] + [(99, None)], "id long, text string")


def test_hand_cases_and_model(spark, texts):
    for r in detect.redact(texts).collect():
        if r.text is None:
            assert (r.redacted_text, r.detections, r.total_redacted) == (None, [], 0)
            continue
        want, found = model(r.text)
        assert r.redacted_text == want == HAND.get(r.text, want)
        assert [tuple(d) for d in r.detections] == found and r.total_redacted == len(found)


def test_native_agrees(spark, texts):
    plain = texts.where("text NOT LIKE '%ris%İ%'")
    spans = plain.withColumn("s", detect.native_spans(F.col("text"))).withColumn("r", detect.native_redacted(F.col("text"), F.col("s")))
    for r in spans.collect():
        if r.text is not None:
            assert r.r == model(r.text)[0], r.text


def test_without_detections(spark, texts):
    whole = {r.id: (r.redacted_text, r.total_redacted) for r in detect.redact(texts).collect()}
    short = detect.redact(texts.withColumn("detections", F.lit(3)), detections=False)
    assert short.columns == ["id", "text", "redacted_text", "total_redacted"]
    assert {r.id: (r.redacted_text, r.total_redacted) for r in short.collect()} == whole
    kept = detect.redact(texts.select(F.col("id").alias("text"), F.col("text").alias("body")), "body", level="body", detections=False)
    assert kept.where("text = 99").first().redacted_text is None


def test_levels_nest_and_c1_is_identity(spark, texts):
    rows = texts.where("text IS NOT NULL").crossJoin(spark.createDataFrame([(x,) for x in [*LEVELS, None]], "level string"))
    got = {(r.id, r.level): r for r in detect.redact(rows, level="level").collect()}
    for (i, level), r in got.items():
        assert (r.redacted_text, [tuple(d) for d in r.detections]) == model(r.text, LEVELS[level or "C4"])
        if level == "C1":
            assert r.redacted_text == r.text and not r.detections
        if level == "C2":
            assert {tuple(d) for d in r.detections} <= {tuple(d) for d in got[i, "C3"].detections} <= {tuple(d) for d in got[i, "C4"].detections}


def test_unknown_types_and_clashing_columns(spark):
    df = spark.createDataFrame([("a@b.co", 1, "x")], "text string, total_redacted int, redacted_text string")
    r = detect.redact(df, types=["NOPE", "EMAIL"]).first()
    assert (r.text, r.redacted_text, r.total_redacted) == ("a@b.co", "[EMAIL]", 1)


def test_resolve_overlaps(spark):
    df = spark.createDataFrame([("pay BE71096123456769 now please ok",)], "text string")
    assert detect.redact(df, resolve_overlaps=True).first().redacted_text == "pay [IBAN] now please ok"


def test_restore(spark):
    df = detect.redact(spark.createDataFrame([("mail a@b.co on 2024-01-02",), ("a@b.co c@d.co",)], "text string"))
    out = [r.r for r in df.select(detect.restored(F.col("redacted_text"), F.col("detections")).alias("r")).collect()]
    assert [tuple(r) for r in out] == [("mail a@b.co on 2024-01-02", 2), ("a@b.co a@b.co", 1)]


def test_summary_and_reduction(spark, texts):
    red = detect.redact(texts)
    total = {r.id: r.total_redacted for r in red.collect()}
    sums = {r.id: r.n for r in detect.detection_summary(red, "id").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    assert all(sums.get(i, 0) == n for i, n in total.items())
    r = red.where("text = ''").select(*detect.reduction(F.col("text"), F.col("redacted_text"))).first()
    assert tuple(r) == (0, 0, 0.0)


def test_empty_table(spark):
    assert detect.redact(spark.createDataFrame([], "text string")).count() == 0


def test_quick_forms_match_in_the_same_places():
    """On texts in ASCII, made of what the patterns are sensitive to, and of cut-off and joined matches."""
    rng = random.Random(5)
    bits = ["a", "Z", "_", " ", "-", ".", ",", "+", "@", "%", "\t", "\n", "\x1c", "$", ":", "1", "22", "333", "4444", "666666", "999999999", "ID", "id", "iD:", "acc", "Account", "acct ", "EUR", "usd ", "GBP", "FaceID", "iris", "Fingerprint", "biometric", "BE12",
            "a@b.co", "@c.d", "@e.ff", "x@", "1998-02-06", "12-", "-12-", "-34", "+32 ", "123456-10", "BE00000000003686", ".co", " 000.50", ",123"]
    for _ in range(30_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        for p, regex, quick in compiled():
            assert [m.span() for m in regex.finditer(t)] == p.spans(t.lower(), quick), (p.type, t)


def test_overlaps_are_counted_within_rows(spark):
    rows = ["pay EUR 100 to account 123456789", "id ID123456789 a@b.co", None, "", "été 1998-02-06 FaceID +32 123456789", "call +32 123456789012 ssn 123456-10"]
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    want = Counter()
    for r in rows:
        ms = [(m.start(), m.end(), p.ord, p.type) for p, regex, _ in compiled() for m in regex.finditer(r or "")]
        want.update((a[3], b[3]) for a in ms for b in ms if a[0] <= b[0] < a[1] and a[2] != b[2] and (a[0], a[2]) < (b[0], b[2]))
    got = {(r.first_type, r.second_type): r.n for r in detect.overlaps(df).collect()}
    assert got == want and got


def test_a_large_scan_makes_more_tasks(spark, tmp_path, monkeypatch):
    """A task makes prompts of ROWS rows at most, so that the longest task doesn't grow with the table."""
    spark.range(1000, numPartitions=1).write.parquet(str(tmp_path / "orders.parquet"))
    t = plans.Tables(spark, str(tmp_path))
    assert t.spread(t.orders).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(plans.Tables, "ROWS", 90)
    assert t.spread(t.orders).rdd.getNumPartitions() == 12 and t.spread(t.orders).count() == 1000


def test_counts_of_texts_that_lack_what_a_pattern_needs(spark):
    """A text is kept from a pattern only where that can't match, whatever the case and script of its signs."""
    texts = [None, "", "no sign", "a@b.co", "ID ABCDEF", "ıd:abcdef", "İD-abcdef", "id", "IRİS", "ırıſ", "BİOMETRIC", "fİngerprint", "ﬁngerprint", "FACEID", "faceıd", "+٣٤ ١٢٣٤٥٦٧٨٩", "DE89370400440532013000", "2020-01-02", "EUR 1", "ü account 123", "account ١٢٣", "123456-12"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = [F.regexp_count("text", F.lit(p.java)).cast("long").alias(f"n_{p.type.lower()}") for p in PATTERNS]
    assert df.select("text", *detect.counts(F.col("text"))).collect() == df.select("text", *plain).collect()
    plan = df.select(detect.count(F.col("text"), PATTERNS[1]))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.upper()
    assert all(detect.found(t, compiled()) == [sum(1 for _ in r.finditer(t)) for _, r, _ in compiled()] for t in texts if t)
