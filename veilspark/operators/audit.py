"""The audit log and its questions: interactions, sessions, users, statistics, risk.

Tables (see FIXTURES.md for all columns): interactions(session_id, user_id, action, timestamp, details ...),
sessions(session_id, user_id, user_role, created_at, status, closed_at), users(user_id, email, hashed_password,
full_name, is_active, is_admin, created_at, last_login), user_stats(user_id, total_..., last_activity, created_at).
Tables are append-only; what a document store would update in place is derived from the newest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.frames import fresh, same_columns
from veilspark.operators.classify import needs_approval

DETAILS = "struct<original_text:string,redacted_text:string,detections:array<struct<type:string,original:string,placeholder:string>>,total_redacted:bigint,sensitivity_level:string>"
PAGE, MOST = 50, 100
RANGES = {"1h": "1 HOUR", "24h": "24 HOURS", "7d": "7 DAYS", "30d": "30 DAYS"}


def parsed_details(details: Column) -> Column:
    """Details that came as a JSON string, as a struct; null if it is no JSON object."""
    return F.from_json(details, DETAILS)


def enhanced(interactions: DataFrame, endpoint: str, version: str = "1.0") -> DataFrame:
    """With operation (type, categories, level, approval) and compliance metadata, from columns action, categories and level."""
    operation = F.struct(F.col("action").alias("operation_type"), F.col("categories").alias("data_categories"), F.col("level").alias("risk_classification"), needs_approval(F.col("action"), F.col("level")).alias("requires_approval"))
    meta = F.struct(F.lit(endpoint).alias("endpoint"), F.col("timestamp").cast("string").alias("server_timestamp"), F.lit(version).alias("audit_version"), F.lit(True).alias("banking_compliance"))
    return interactions.withColumns({"customer_data_operation": operation, "compliance_metadata": meta})


def with_last_activity(sessions: DataFrame, interactions: DataFrame) -> DataFrame:
    """Sessions with the time of their last interaction, their creation if there is none; interactions of unknown sessions don't matter."""
    key, newest = fresh(sessions.columns, "key", "newest")
    last = interactions.groupBy(F.col("session_id").alias(key)).agg(F.max("timestamp").alias(newest))
    return sessions.join(last, F.col("session_id") == F.col(key), "left").withColumn("last_activity", F.greatest("created_at", newest)).drop(key, newest)


def session_states(events: DataFrame) -> DataFrame:
    """Newest status of each session from appended rows (session_id, status, ts), and when it was closed."""
    return events.groupBy("session_id").agg(F.max_by("status", "ts").alias("status"), F.max(F.when(F.col("status") == "closed", F.col("ts"))).alias("closed_at"))


def session_interactions(interactions: DataFrame, session_id: str) -> DataFrame:
    return interactions.where(F.col("session_id") == session_id).orderBy("timestamp")


def redaction_records(interactions: DataFrame, user_id: str | None = None, limit: int = PAGE) -> DataFrame:
    """Newest redactions first; at most 100. A limit of 0 is none."""
    rows = interactions.where(F.col("action") == "text_redacted")
    rows = rows if user_id is None else rows.where(F.col("user_id") == user_id)
    rows = rows.orderBy(F.desc("timestamp"), F.desc("session_id"))
    return rows.limit(min(limit, MOST)) if limit else rows


def record_lookup(interactions: DataFrame, session_id: str, action: str = "text_redacted") -> DataFrame:
    return interactions.where((F.col("session_id") == session_id) & (F.col("action") == action)).orderBy("timestamp").limit(1)


def user_stats(interactions: DataFrame, text: str = "original_text", scrubbed: str = "redacted_text") -> DataFrame:
    """Sessions, interactions, texts and characters taken out, by user."""
    taken = F.char_length(text) - F.char_length(scrubbed)
    return interactions.groupBy("user_id").agg(
        F.countDistinct("session_id").alias("total_sessions"), F.count("*").alias("total_interactions"), F.count(text).alias("total_text_processed"),
        F.coalesce(F.sum(F.greatest(taken, F.lit(0))), F.lit(0)).cast("long").alias("total_chars_scrubbed"), F.max("timestamp").alias("last_activity"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """``old`` with the rows of ``new`` set over it by ``key``; columns in ``keep`` are set on insert only."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")

    def pick(c: str) -> Column:
        first, second = ("a", "b") if c in keep else ("b", "a")
        return (F.coalesce(f"{first}.{c}", f"{second}.{c}") if c in new.columns else F.col(f"a.{c}")).alias(c)

    return both.select(*[pick(c) for c in old.columns])


def collection_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
        out = one if out is None else out.union(one)
    return out


def users_page(users: DataFrame, skip: int = 0, limit: int = PAGE) -> DataFrame:
    """Without password hashes, newest first."""
    return users.drop("hashed_password").orderBy(F.desc("created_at"), "user_id").offset(skip).limit(limit)


def new_users(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates whose email isn't taken, one an email (the least user_id)."""
    (taken,) = fresh(candidates.columns, "taken")
    known = users.select(F.col("email").alias(taken)).distinct()
    free = candidates.join(known, F.col("email") == F.col(taken), "left_anti")
    return free.groupBy("email").agg(F.min(F.struct("user_id", *[c for c in candidates.columns if c not in ("email", "user_id")])).alias("u")).select("email", "u.*")


def empty_stats(users: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return users.select("user_id", zero.alias("total_sessions"), zero.alias("total_interactions"), zero.alias("total_text_processed"), zero.alias("total_chars_scrubbed"), F.col("created_at").alias("last_activity"), "created_at")


def by_email(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.col("email") == email)


def with_login(users: DataFrame, email: str, at: Column) -> DataFrame:
    return users.withColumn("last_login", F.when(F.col("email") == email, at).otherwise(F.col("last_login")))


def deactivated(users: DataFrame, email: str) -> DataFrame:
    return users.withColumn("is_active", F.when(F.col("email") == email, False).otherwise(F.col("is_active")))


def migrated_users(users: DataFrame) -> DataFrame:
    """Users without an id get one that their email decides."""
    return users.withColumn("user_id", F.coalesce("user_id", F.concat(F.lit("u-"), F.substring(F.md5("email"), 1, 12))))


def migrated_stats(stats: DataFrame, users: DataFrame) -> DataFrame:
    """Statistics that are keyed by an email get its user's id."""
    email, own = fresh(stats.columns, "email", "own")
    ids = users.select(F.col("email").alias(email), F.col("user_id").alias(own))
    return stats.join(ids, F.col("user_id") == F.col(email), "left").withColumn("user_id", F.coalesce(own, "user_id")).drop(email, own)


def seeding_summary(interactions: DataFrame) -> DataFrame:
    of = lambda a: F.count_if(F.col("action") == a)
    return interactions.agg(F.count("*").alias("interactions"), of("text_redacted").alias("redactions"), of("prediction_generated").alias("predictions"), of("text_de_scrubbed").alias("de_scrubs"), F.countDistinct("session_id").alias("sessions"))


def truncate(spark: SparkSession, path: str, schema) -> None:
    """An empty table in place of the interactions."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def audit_sessions(interactions: DataFrame, user_id: str | None = None, risk_level: str | None = None, operation_type: str | None = None, limit: int = PAGE) -> DataFrame:
    """Newest operations with any of the filters."""
    for column, value in (("user_id", user_id), ("level", risk_level), ("action", operation_type)):
        if value is not None:
            interactions = interactions.where(F.col(column) == value)
    return interactions.orderBy(F.desc("timestamp"), "session_id").limit(limit)


def risk_dashboard(interactions: DataFrame, now: Column, time_range: str = "24h") -> DataFrame:
    """One row of counts over the time before ``now``.

    High risk: level C3 or C4; customer data: any category; a violation: an operation that needs approval and has none."""
    since = now - F.expr(f"INTERVAL {RANGES[time_range]}")
    rows = interactions.where((F.col("timestamp") > since) & (F.col("timestamp") <= now))
    need = needs_approval(F.col("action"), F.col("level"))
    return rows.agg(
        F.count("*").alias("total_operations"), F.count_if(F.col("level").isin("C3", "C4")).alias("high_risk_operations"), F.count_if(F.col("action") == "text_de_scrubbed").alias("de_scrub_requests"),
        F.count_if(F.col("n_categories") > 0).alias("customer_data_operations"), F.count_if(need & ~F.coalesce(F.col("approved"), F.lit(False))).alias("compliance_violations"),
    )


def access_status(requests: DataFrame, users: DataFrame, admin: bool = True) -> DataFrame:
    """Requests (email) with status 404 (no such user), 403 (inactive, or no admin where one is needed) or 200."""
    email, active, rights = fresh(requests.columns, "known_email", "is_active", "is_admin")
    known = users.select(F.col("email").alias(email), F.col("is_active").alias(active), F.col("is_admin").alias(rights))
    joined = requests.join(known, F.col("email") == F.col(email), "left")
    bad = ~F.coalesce(F.col(active), F.lit(False)) | (F.lit(admin) & ~F.coalesce(F.col(rights), F.lit(False)))
    return joined.select(*same_columns(requests, "status"), F.when(F.col(email).isNull(), 404).when(bad, 403).otherwise(200).alias("status"))
