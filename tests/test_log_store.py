"""Indexed log, keyed tables, seek paging and the streaming append: results, what is read, what is rewritten, replays."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark.sources import log_store
from veilspark.sources.log_store import AuditLog, KeyedTable
from veilspark.streaming import live

LOG = "session_id string, user_id string, action string, timestamp timestamp, n int"


def interactions(n, seed=1, sessions=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = 0 if rng.random() < 0.33 else rng.randrange(sessions)  # a hot session
        rows.append((f"s{s}", f"u{s % 11}", rng.choice(["text_redacted", "text_de_scrubbed", "login"]), datetime(2024, 1, 1) + timedelta(minutes=i * 7), i))
    return rows


def scanned(df):
    """Rows and files that the scans of a collected frame have read."""
    def leaves(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return leaves(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return leaves(p.plan())
        kids = p.children()
        return [p] if not kids.size() else [x for i in range(kids.size()) for x in leaves(kids.apply(i))]

    value = lambda p, m: p.metrics().apply(m).value() if p.metrics().contains(m) else 0
    found = leaves(df._jdf.queryExecution().executedPlan())
    return tuple(sum(value(p, m) for p in found) for m in ("numOutputRows", "numFiles"))


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    out = AuditLog(spark, str(tmp_path_factory.mktemp("log")), buckets=8)
    rows = interactions(3000)
    out.append(spark.createDataFrame(rows[:2000], LOG).repartition(4))
    out.append(spark.createDataFrame(rows[2000:], LOG).repartition(3))
    return out


def test_lookups(spark, log):
    rows = interactions(3000)
    one = log.session("s7").collect()
    assert [r.n for r in one] == [r[4] for r in rows if r[0] == "s7"]
    assert log.record("s7").first().n == next(r[4] for r in rows if r[0] == "s7" and r[2] == "text_redacted")
    assert log.session("nobody").count() == 0 and log.record("s7", "nothing").count() == 0
    newest = [r[4] for r in reversed(rows) if r[2] == "text_redacted"]
    assert [r.n for r in log.redactions(limit=20).collect()] == newest[:20] and [r.n for r in log.redactions(limit=1000).collect()] == newest[:100]
    mine = [r[4] for r in reversed(rows) if r[2] == "text_redacted" and r[1] == "u3"]
    assert [r.n for r in log.redactions("u3", 60).collect()] == mine[:60] and [r.n for r in log.redactions("u3", 0).collect()] == mine
    assert len(log.days()) == len({r[3].date() for r in rows}) and log.days()[0] == rows[-1][3].date()


def test_lookups_read_little(spark, log):
    n_files = len(log.read().inputFiles())
    df = log.session("s7")
    df.collect()
    assert scanned(df)[1] < n_files / 4
    df = log.redactions(limit=20)
    df.collect()
    assert scanned(df)[1] <= 2 * 8 * 2


def test_row_groups_are_skipped(spark, tmp_path):
    """A file of many row groups: a session is told by their ranges, an absent user by their Bloom filters."""
    big = AuditLog(spark, str(tmp_path), buckets=1, row_group=64 << 10, ids=1000)
    df = spark.range(60_000).select(F.concat(F.lit("s"), F.lpad((F.col("id") % 3000).cast("string"), 5, "0")).alias("session_id"), F.sha2(F.concat(F.lit("u"), F.col("id") % 2000), 256).alias("user_id"), F.lit("text_redacted").alias("action"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    big.append(df)
    asked = big.session("s01234")
    assert len(asked.collect()) == 20 and scanned(asked)[0] < 60_000 / 3
    absent = F.sha2(F.lit("u2001"), 256)
    asked = big.read().where(F.col("user_id") == absent)
    assert asked.collect() == [] and scanned(asked)[0] < 60_000 / 8
    assert big.read().where(F.col("user_id") == F.sha2(F.lit("u7"), 256)).count() == 30


def test_batches_of_requests(spark, log):
    rows = interactions(3000)
    asked = spark.createDataFrame([("s7", 1), ("s7", 2), ("nobody", 3), (None, 4), ("s0", 5)], "session_id string, record int").withColumn("session", F.lit("x"))
    got = sorted(((str(r.session_id), r.session, r.record and r.record.n) for r in log.records(asked).collect()), key=str)
    first = {s: next(r[4] for r in rows if r[0] == s and r[2] == "text_redacted") for s in ("s0", "s7")}
    assert got == sorted([("s7", "x", first["s7"])] * 2 + [("nobody", "x", None), ("None", "x", None), ("s0", "x", first["s0"])], key=str)


def test_truncate(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"), buckets=2)
    log.append(spark.createDataFrame(interactions(20), LOG))
    log.truncate()
    assert log.read().count() == 0 and set(LOG.replace(",", "").split()[::2]) <= set(log.read().columns) and log.redactions().count() == 0
    log.append(spark.createDataFrame(interactions(20), LOG))
    assert log.read().count() == 20


# --- keyed tables


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "user_id string, total long, created_at int, note string"
    table = KeyedTable(spark, str(tmp_path / "t"), "user_id", buckets=16)
    table.create(spark.createDataFrame([(f"u{i}", i, i, None if i % 2 else "n") for i in range(400)] + [(None, 9, 9, "x")], schema))
    want = {f"u{i}": (i, i, None if i % 2 else "n") for i in range(400)} | {None: (9, 9, "x")}
    before = files_of(table.path)
    new = spark.createDataFrame([("u5", 500, 77), ("u6", 600, 78), ("new", 1, 2), (None, 0, 0)], "user_id string, total long, created_at int")
    touched = table.merge(new)
    want |= {"u5": (500, 5, None), "u6": (600, 6, "n"), "new": (1, 2, None)}
    read = lambda: {r.user_id: (r.total, r.created_at, r.note) for r in table.read().collect()}
    assert read() == want and 1 <= len(touched) <= 3
    now = files_of(table.path)
    bucket = lambda f: int(f.split("key_bucket=")[1].split("/")[0])
    assert all(now.get(f) == t for f, t in before.items() if bucket(f) not in touched) and len(set(before) & set(now)) >= 13 - 3
    assert table.merge(new) == touched and read() == want
    assert table.merge(new.where("user_id = 'nobody'")) == []
    table.merge(spark.createDataFrame([("u7", 3), ("u8", 800), ("ghost", 1)], "user_id string, total long"), greatest=("total",), insert=False)
    assert read() == want | {"u8": (800, 8, "n")}
    asked = table.get("u8")
    assert asked.first().total == 800 and table.get("ghost").count() == 0


# --- paging


def test_seek_pages(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(6)]), rng.choice([None, "a", "b", "c"]), f"e{i}") for i in range(200)]
    order = [("created_at", True), ("user_id", False), ("email", False)]
    df = spark.createDataFrame(rows, "created_at int, user_id string, email string").repartition(3)
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2])
    log_store.write_sorted(df, str(tmp_path / "users"), order, 4)
    for source in (df, spark.read.parquet(str(tmp_path / "users"))):
        pages = list(log_store.seek_pages(source, order, 37))
        assert [len(p) for p in pages] == [37] * 5 + [15] and [tuple(r) for p in pages for r in p] == sorted(rows, key=key)
    assert list(log_store.seek_pages(df.limit(0), order)) == []


# --- streams


def stream_case(spark, path, n):
    rows = interactions(n, seed=9, sessions=12)
    for k in range(3):
        spark.createDataFrame(rows[k::3], LOG).coalesce(1).write.mode("append").parquet(f"{path}/in")
    sessions = [(f"s{i}", datetime(2024, 1, 1), None if i % 2 else datetime(2030, 1, 1)) for i in range(10)]
    table = KeyedTable(spark, f"{path}/sessions", "session_id", 4).create(spark.createDataFrame(sessions, "session_id string, created_at timestamp, last_activity timestamp"))
    last = {s: max([r[3] for r in rows if r[0] == s] + ([a] if a else []), default=None) for s, _, a in sessions}
    return rows, table, last


def test_streaming_append_counts_each_row_once(spark, tmp_path):
    rows, table, last = stream_case(spark, str(tmp_path), 300)
    log, check = AuditLog(spark, str(tmp_path / "log"), buckets=4), str(tmp_path / "check")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.append_audit(stream, log, check, table).awaitTermination()
    read = lambda: sorted(r.n for r in log.read().collect())
    activity = lambda: {r.session_id: r.last_activity for r in table.read().collect()}
    assert read() == list(range(300)) and activity() == last and len({r.batch for r in log.read().select("batch").distinct().collect()}) == 3
    done = sorted(glob.glob(f"{check}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    for f in [done[-1], *glob.glob(f"{check}/commits/.{os.path.basename(done[-1])}.crc")]:
        os.remove(f)  # as if it had failed between the append and its commit: the batch comes again
    live.append_audit(stream, log, check, table).awaitTermination()
    assert os.path.exists(done[-1]) and read() == list(range(300)) and activity() == last
    put = live.audit_sink(log, table, "other")
    batch = spark.createDataFrame([("s1", "u", "login", datetime(2031, 1, 1), 900), ("ghost", "u", "login", datetime(2031, 1, 1), 901)], LOG)
    put(batch, 0)
    put(batch, 0)
    assert read() == [*range(300), 900, 901] and activity() == last | {"s1": datetime(2031, 1, 1)}
