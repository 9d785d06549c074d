"""Sessions on a stream, splits by hash, and the loop of fitting, saving, judging and reading the figures."""

import random
from datetime import datetime, timedelta

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from veilspark.operators import audit, classify, metrics
from veilspark.sources import docx, files
from veilspark.streaming import live

EVENTS = "session_id string, status string, ts timestamp"


def run_stream(spark, path, batches, **options):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{path}/in")
        live.newest_states(live.session_updates(stream, **options), f"{path}/out", f"{path}/check").awaitTermination()
    return {r.session_id: r for r in live.current_states(spark.read.parquet(f"{path}/out")).collect()}


def test_sessions_on_a_stream_equal_the_batch(spark, tmp_path):
    """Events out of order, within what counts as late; no timer is due."""
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(f"s{rng.randrange(8)}", rng.choice(["active", "closed"]), start + timedelta(seconds=7 * i)) for i in range(240)]
    moved = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.randrange(40))]
    got = run_stream(spark, str(tmp_path), [moved[:80], [], moved[80:170], moved[170:] + [(None, "active", start), ("s1", "active", None)]], idle="2 days", late="1 hour")
    want = audit.session_states(spark.createDataFrame(rows, EVENTS)).collect()
    assert {k: (r.status, r.closed_at) for k, r in got.items()} == {r.session_id: (r.status, r.closed_at) for r in want}
    assert sum(r.operations for r in got.values()) == 240 and {k: r.last_activity for k, r in got.items()} == {s: max(t for x, _, t in rows if x == s) for s in got}


def test_idle_sessions_close_and_late_events_go(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [
        [("a", "active", t(0)), ("b", "active", t(1)), ("c", "closed", t(2))],
        [("b", "active", t(55)), ("d", "active", t(60))],
        [("a", "active", t(10)), ("d", "active", t(96))],  # a's event is too late to count
        [("b", "active", t(200)), ("e", "active", t(100))],
    ]
    got = run_stream(spark, str(tmp_path), batches, idle="30 minutes", late="10 minutes")
    assert {k: (r.status, r.last_activity, r.operations) for k, r in got.items()} == {"a": ("idle", t(0), 1), "b": ("active", t(200), 3), "c": ("closed", t(2), 1), "d": ("idle", t(96), 2), "e": ("idle", t(100), 1)}
    seen = spark.read.parquet(f"{tmp_path}/out").where("session_id = 'b'").orderBy("batch").collect()
    assert [r.status for r in seen] == ["active", "active", "idle", "active"]


def test_a_split_follows_from_the_rows(spark):
    rng = random.Random(3)
    rows = [(i if i % 50 else None, f"t{i}", rng.choice(["C1"] * 8 + ["C2", None])) for i in range(1500)] + [(7, "again", "C1")] * 3
    df = spark.createDataFrame(rows, "id long, text string, label string").withColumn("place", F.lit("x")).withColumn("bin", F.lit(1))
    for bins in (16, 2):
        classify.BIN_DIGITS = bins
        a, b = (sorted((str(r.id), str(r.label), r.test) for r in classify.with_split(x, "id").collect()) for x in (df, df.repartition(7, "text")))
        assert a == b and classify.with_split(df, "id").columns == [*df.columns, "test"]
        for lb in ("C1", "C2", "None"):
            own = [t for _, x, t in a if x == lb]
            assert abs(sum(own) - round(0.2 * len(own))) <= 33  # rows without an id have one key
    classify.BIN_DIGITS = 16
    assert classify.with_split(df, "id", seed=1).where("test").count() > 0 and classify.with_split(df.limit(0), "id").count() == 0
    plain = classify.with_split(spark.range(1000).withColumn("label", F.col("id") % 3), "id").groupBy("label").agg(F.count_if("test").alias("n")).collect()
    assert {r.label: r.n for r in plain} == {0: 67, 1: 67, 2: 67}


def test_fit_save_load_and_figures(spark, tmp_path):
    """The figures in the file are those of the predictions, and the loaded model makes the same ones under another partitioning."""
    rows = [(f"the account {i} has a balance", "C4") for i in range(60)] + [(f"weather report number {i}", "C1") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, label string")
    model, predicted = classify.train(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = classify.classified(classify.with_split(df.repartition(5), "text").where("test"), classify.load(str(tmp_path / "model")))
    cells = lambda m: sorted((r.actual, r.predicted, r.n) for r in metrics.confusion_matrix(m).collect())
    assert cells(predicted) == cells(again.select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))) and sum(n for *_, n in cells(predicted)) == 24
    labels = ["C1", "C4"]
    matrix = F.array(*[F.array(*[F.count_if((F.col("actual") == a) & (F.col("predicted") == p)) for p in labels]) for a in labels])
    predicted.agg(F.lit("accuracy 1.0 24").alias("report"), matrix.alias("confusion_matrix")).coalesce(1).write.json(str(tmp_path / "metrics"))
    read = files.read_metrics(spark, str(tmp_path / "metrics")).first()
    assert [(a, p, n) for a, row in zip(labels, read.confusion_matrix) for p, n in zip(labels, row) if n] == cells(predicted)


def test_reasons_of_failures(spark):
    made = [("a.txt", b" x "), ("b.txt", b"\xff"), ("c.docx", b"broken"), ("d.docx", docx.write("t")), ("e.pdf", b"%PDF"), ("f.zip", b""), ("g.txt", b"  "), ("h.html", None)]
    out = files.extract(spark.createDataFrame(made, "path string, content binary"))
    assert {r.path: r.reason for r in out.collect()} == {"a.txt": None, "b.txt": "UnicodeDecodeError", "c.docx": "BadZipFile", "d.docx": None, "e.pdf": "no extractor for pdf", "f.zip": "unknown kind", "g.txt": "no text", "h.html": "no content"}
    assert tuple(files.batch_report(out).first()) == (8, 2) and files.failures(out).agg(F.sum("files")).first()[0] == 6


def test_a_session_step_reads_its_rows_as_columns(spark):
    """No frame is cut or looked up for each session and batch: that was most of a batch's time."""
    from types import SimpleNamespace

    import numpy as np

    class Columns(dict):
        def __len__(self):
            return len(rows)

    class Caught:
        def __getattr__(self, _):
            return lambda *_: self

        def applyInPandasWithState(self, step, *_):  # noqa: N802
            return step

    kept = []
    state = SimpleNamespace(exists=False, hasTimedOut=False, get=None, update=kept.append, setTimeoutTimestamp=lambda _: None, getCurrentWatermarkMs=lambda: 0)
    rows = [("active", "2024-01-01T00:00:05"), ("closed", "2024-01-01T00:00:07"), ("closed", "NaT"), ("active", "2024-01-01T00:00:07")]
    part = Columns(status=SimpleNamespace(to_numpy=lambda: np.array([r[0] for r in rows], object)), ts=SimpleNamespace(to_numpy=lambda: np.array([r[1] for r in rows], "datetime64[ns]")))
    (out,) = live.session_updates(Caught())(("s",), iter([part]), state)
    at = int(np.datetime64("2024-01-01T00:00:07", "us").astype(int))
    assert kept == [("closed", at, at, 3)] and out.to_dict("records")[0]["operations"] == 3


def test_training_reads_its_texts_once(spark, tmp_path):
    """Tokens, rules and hashes are made once for each labelled text, and the model is that of the whole pipeline on the same split."""
    rows = [(i, f"the account {i} has a balance of EUR {i},00", "C4") for i in range(60)] + [(i, f"weather report number {i}", "C1") for i in range(60, 120)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    model, predicted = classify.train(df.withColumn("text", F.udf(seen).asNondeterministic()("text")), key="id")
    assert predicted.count() == 24 and read.value == 120
    data = classify.with_rule_features(classify.with_split(df, "id"), "text", "rules").withColumn("features_rules", array_to_vector("rules"))
    whole = classify.training_pipeline().fit(data.where("NOT test"))
    assert [type(s) for s in whole.stages] == [type(s) for s in model.stages]
    cells = lambda p: sorted((r.actual, r.predicted, round(r.confidence, 6)) for r in p.collect())
    assert cells(predicted) == cells(classify.predictions(data.where("test"), whole))


def test_packs_of_sessions_are_as_sessions_alone(spark, tmp_path):
    """Rows in any order, in batches that reach a part of each pack; sessions become idle and open again, late events don't count."""
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    batches = [[(rng.choice(["a", "b", "cé", "", None]) if rng.random() < 0.3 else f"s{rng.randrange(9)}", rng.choice(["active", "closed", None]), start + timedelta(minutes=50 * k, microseconds=rng.randrange(-(10**9), 10**9))) for _ in range(n)] for k, n in enumerate((60, 0, 25, 4, 12))]
    batches[2] += [("s1", "active", start - timedelta(days=1)), ("new", "active", start - timedelta(days=1)), ("s2", "active", None)]
    options = {"idle": "30 minutes", "late": "20 minutes"}
    seen = lambda p: sorted(map(str, spark.read.parquet(f"{p}/out").select("batch", *live.SESSION.replace(",", "").split()[::2]).collect()))
    alone = run_stream(spark, str(tmp_path / "alone"), batches, **options)
    packed = run_stream(spark, str(tmp_path / "packed"), batches, packs=3, **options)
    assert packed == alone and {r.status for r in packed.values()} >= {"idle", "closed"} and "new" not in packed
    assert seen(tmp_path / "packed") == seen(tmp_path / "alone")


def test_a_step_sums_up_a_whole_pack(monkeypatch):
    """One call for all sessions of a pack, however its rows are cut; what came later counts of equal times."""
    import pandas as pd

    monkeypatch.setattr(live, "PACK_ROWS", 5)
    rng = random.Random(6)
    kept, wait, now, want = [], [], 10_000, {}
    step = live._pack_step(1000)

    class State:
        exists = property(lambda self: bool(kept))
        get = property(lambda self: kept[-1])
        update = staticmethod(kept.append)
        setTimeoutTimestamp = staticmethod(wait.append)  # noqa: N815
        getCurrentWatermarkMs = staticmethod(lambda: now)  # noqa: N815

    for at in range(3):
        rows = [(f"s{rng.randrange(40)}", rng.choice(["active", "closed"]), 20_000_000 + rng.randrange(10**6)) for _ in range(300)] + [("tie", ["active", "closed", "active"][at], 7)]
        for s, status, us in rows:
            was = want.get(s, (None, -1, None, 0))
            want[s] = (status if us > was[1] or s == "tie" else was[0], max(us, was[1]), max(us, was[2] or 0) if status == "closed" else was[2], was[3] + 1)
        cuts = [0, 1, 2, 10, 11, 90, 301]
        parts = [pd.DataFrame(rows[a:b], columns=["session_id", "status", "us"]) for a, b in zip(cuts, cuts[1:])]
        (out,) = step((0,), iter(parts), State())
        got = {r.session_id: (r.status, r.newest, None if r.closed == live.NEVER else r.closed, r.n) for r in out.itertuples()}
        assert got == {s: want[s] for s in {r[0] for r in rows}} and wait[-1] > now
    now = 10**9
    (out,) = step((0,), iter([pd.DataFrame()]), State())
    assert set(out["session_id"]) == {s for s, w in want.items() if w[0] == "active"} and set(out["status"]) == {"idle"}
    assert list(step((0,), iter([]), State())) == []


def test_the_streamed_log_is_taken_in_packs_and_files(spark, tmp_path, monkeypatch):
    """Many files to a batch, three batches, and steps for packs: one for each session made the time grow with the sessions."""
    from veilspark.plans import queries

    spark.range(240).selectExpr("id AS event_id", "id % 5 AS user_id", "timestamp_micros(1000000000000 + id * 1000003) AS ts", "'view' AS event_type", "CAST(id % 11 AS DOUBLE) AS value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries, "FILE_EVENTS", 30)
    calls = []
    updates = live.session_updates
    monkeypatch.setattr(live, "session_updates", lambda *a: calls.append(a[3]) or updates(*a))
    made = []
    paths = queries.scratch
    monkeypatch.setattr(queries, "scratch", lambda *a: made.append(paths(*a)) or made[-1])
    got = {r.session_id: tuple(r)[1:] for r in queries.session_stream(spark, str(tmp_path)).collect()}
    want = {}
    for i in range(240):
        n, closed = want.get(f"s{i % 5}-{i % 7}", (0, 0, 0, None))[1::2]
        us = 10**12 + i * 1000003
        want[f"s{i % 5}-{i % 7}"] = ("closed" if i % 11 > 5 else "active", n + 1, us, us if i % 11 > 5 else closed)
    assert got == want and calls == [64] and len(spark.read.parquet(made[0]).inputFiles()) == 9 and spark.read.parquet(made[1]).select("batch").distinct().count() == 3
