"""The engine on streams: an extension, the batch operators are what counts.

Redaction is stateless and runs on a stream as it is (operators.detect.redact). Here are the windowed counts for the
dashboard, with late events dropped after the watermark, and a sink that appends redacted rows once for each batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.operators.classify import needs_approval
from veilspark.operators.detect import redact
from veilspark.sources.log_store import AuditLog, KeyedTable


def action_counts(interactions: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Operations and those that need approval, by window and action; tumbling, or sliding with ``slide``."""
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    need = F.sum(needs_approval(F.col("action"), F.col("level")).cast("long"))
    counts = interactions.withWatermark("timestamp", late).groupBy(w.alias("w"), "action").agg(F.count("*").alias("operations"), need.alias("need_approval"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "action", "operations", "need_approval")


def session_activity(interactions: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of activity of each user: a session window ends after ``gap`` without an event."""
    w = F.session_window("timestamp", gap)
    out = interactions.withWatermark("timestamp", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("operations"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "user_id", "operations")


def redact_to(stream: DataFrame, path: str, checkpoint: str, text: str = "text", level: str | None = None) -> StreamingQuery:
    """Redact a stream and write it as Parquet; the checkpoint makes each row count once."""
    return redact(stream, text, level).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_sink(log: AuditLog, sessions: KeyedTable | None = None, name: str = "stream") -> Callable[[DataFrame, int], None]:
    """What writes a micro-batch of interactions: rows go to the log as a batch of their own, and their sessions' last_activity moves on.

    Both steps may be repeated: the batch replaces itself by its number, and last_activity never falls. So a batch that is
    replayed after a failure, in whichever step, counts once. ``name`` tells streams into one log apart. Sessions that the table doesn't know aren't added."""

    def put(batch: DataFrame, number: int) -> None:
        log.append(batch, f"{name}-{number:012d}")
        if sessions is not None:
            written = log.read(f"{name}-{number:012d}")  # what is in the log, not the source once more
            sessions.merge(written.groupBy("session_id").agg(F.max("timestamp").alias("last_activity")), keep=(), greatest=("last_activity",), insert=False)

    return put


def append_audit(stream: DataFrame, log: AuditLog, checkpoint: str, sessions: KeyedTable | None = None, name: str = "stream") -> StreamingQuery:
    """Append a stream of interactions to the log until what is there is taken; each row once."""
    return stream.writeStream.foreachBatch(audit_sink(log, sessions, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SESSION = "session_id string, status string, closed_at timestamp, last_activity timestamp, operations long"


PACK_ROWS = 100_000  # of a pack in a batch that are held before they are summed up by session
NEVER = -(1 << 63)
PACKED = pa.schema({"session_id": pa.string(), "status": pa.string(), "newest": pa.int64(), "closed": pa.int64(), "n": pa.int64(), "due": pa.int64()})


def _summed(parts: list[pa.Table]) -> pa.Table:
    """A row of PACKED for each session, in no order; of rows with the newest time, the first has the status and the timer."""
    t = pa.concat_tables(parts).combine_chunks()
    codes = pc.dictionary_encode(t["session_id"]).combine_chunks().indices.to_numpy()
    newest, closed, n = (t[c].to_numpy() for c in ("newest", "closed", "n"))
    order = np.lexsort((-np.arange(len(codes)), newest, codes))
    begins = np.flatnonzero(np.diff(codes[order], prepend=-1))
    last = order[np.append(begins[1:], len(order)) - 1]
    cols = [t["session_id"].take(last), t["status"].take(last), newest[last], np.maximum.reduceat(closed[order], begins), np.add.reduceat(n[order], begins), t["due"].take(last)]
    return pa.table(cols, schema=PACKED)


def _pack_step(gap_ms: int):
    """The step of a pack of sessions: what session_updates() has it do for one, for all of the pack at once. NEVER is no time."""

    def rows_of(part: pd.DataFrame) -> pa.Table:
        us, said = part["us"].to_numpy(), pa.array(part["status"].to_numpy(), pa.string(), from_pandas=True)
        over = pc.fill_null(pc.equal(said, "closed"), False).to_numpy(zero_copy_only=False)
        return pa.table([pa.array(part["session_id"].to_numpy(), pa.string()), said, us, np.where(over, us, NEVER), np.ones(len(us), np.int64), np.full(len(us), NEVER)], schema=PACKED)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else PACKED.empty_table()
        found: list[pa.Table] = []
        for part in parts:
            if len(part):
                found.append(rows_of(part))
                if len(found) > 1 and sum(len(x) for x in found) > max(PACK_ROWS, 2 * len(found[0])):
                    found = [_summed(found)]
        now = state.getCurrentWatermarkMs()
        fresh = pc.unique(pa.concat_tables(found)["session_id"]) if found else pa.array([], pa.string())
        t = _summed([*found, held]) if found else held  # of equal times, that which came later counts
        if not len(t):
            return
        came = pc.is_in(t["session_id"], fresh).to_numpy()
        due, still = t["due"].to_numpy(), ~pc.fill_null(pc.is_in(t["status"], pa.array(["closed", "idle"])), False).to_numpy()
        late = ~came & (due != NEVER) & (due <= now)
        due = np.where(came, np.where(still, np.maximum(t["newest"].to_numpy() // 1000 + gap_ms, now + 1), NEVER), np.where(late, NEVER, due))
        status = pc.if_else(pa.array(late), "idle", t["status"].combine_chunks())
        t = t.set_column(1, "status", status).set_column(5, "due", pa.array(due))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, PACKED) as w:
            w.write_table(t)
        state.update((sink.getvalue().to_pybytes(),))
        if (due != NEVER).any():
            state.setTimeoutTimestamp(int(due[due != NEVER].min()))
        out = t.filter(pa.array(came | late))
        if len(out):
            yield out.select(["session_id", "status", "closed", "newest", "n"]).to_pandas()

    return step


def session_updates(events: DataFrame, idle: str = "30 minutes", late: str = "10 minutes", packs: int | None = None) -> DataFrame:
    """The state of each session (SESSION) whenever it changes, from a stream of session_id, status and ts; for update mode.

    As audit.session_states() has it from the whole log: the status of the newest event, whatever order events come in, and the newest time of closing. A session
    that isn't closed, and whose newest event is ``idle`` behind the watermark, becomes idle, by a timer of its own; a later event opens it again, with its counts.
    Events without a session or a time don't count, nor do those that come ``late`` behind the newest.

    Without ``packs`` Python is called for each session of a batch: for batches of few rows. With it, for each of so many packs of sessions (by hash), whose states
    are one value, read and written whole: for batches that reach a good part of all sessions. The number belongs to the checkpoint, as that of shuffle partitions does."""
    gap = pd.Timedelta(idle)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, newest, closed, n = state.get if state.exists else (None, None, None, 0)
        if state.hasTimedOut:
            status = "idle"
        for part in parts:  # arrays, as most sessions have a few rows in a batch
            if not len(part):
                continue
            ts, said = part["ts"].to_numpy(), part["status"].to_numpy()
            known = ~np.isnat(ts)
            if not known.any():
                continue
            us, said = ts[known].astype("datetime64[us]").astype(np.int64), said[known]
            n += len(us)
            top = int(us.argmax())
            if newest is None or us[top] >= newest:
                status, newest = said[top], int(us[top])
            over = us[said == "closed"]
            if len(over):
                closed = max(int(over.max()), closed if closed is not None else int(over.max()))
        if newest is None:
            return
        state.update((status, newest, closed, n))
        due = (newest // 1000) + int(gap.total_seconds() * 1000)
        if status not in ("closed", "idle"):
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        time = lambda x: np.array(["NaT" if x is None else x], "datetime64[us]").astype("datetime64[ns]")
        yield pd.DataFrame({"session_id": [key[0]], "status": [status], "closed_at": time(closed), "last_activity": time(newest), "operations": [n]})

    rows = events.where("session_id IS NOT NULL AND ts IS NOT NULL").select("session_id", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    if packs:
        packed = rows.select(F.pmod(F.xxhash64("session_id"), F.lit(packs)).alias("pack"), "session_id", "status", F.unix_micros("ts").alias("us"), "ts")  # ts for what is late
        out = packed.groupBy("pack").applyInPandasWithState(_pack_step(int(gap.total_seconds() * 1000)), "session_id string, status string, closed long, newest long, n long", "sessions binary", "update", GroupStateTimeout.EventTimeTimeout)
        time = lambda c: F.timestamp_micros(F.when(F.col(c) > NEVER, F.col(c))).alias({"closed": "closed_at", "newest": "last_activity"}[c])
        return out.select("session_id", "status", time("closed"), time("newest"), F.col("n").alias("operations"))
    return rows.groupBy("session_id").applyInPandasWithState(step, SESSION, "status string, newest long, closed long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def newest_states(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write session_updates() below ``path``, a folder a batch, which a replay writes again; current_states() reads them."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(rows: DataFrame) -> DataFrame:
    """The last update of each session."""
    return rows.groupBy("session_id").agg(F.max_by(F.struct("status", "closed_at", "last_activity", "operations"), "batch").alias("s")).select("session_id", "s.*")
