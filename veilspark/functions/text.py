"""Scalar text functions, all of them expressions of Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split() takes for white space, as a Java character class.
SPACE = r"[\s\x0B\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def clean_lines(text: Column) -> Column:
    """White space within each line to single spaces, none at its ends."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, SPACE + "+", " "))), "\n")


def drop_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, SPACE + "+", "") != ""), "\n")


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts, joined by |, nulls as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def client_ip(forwarded: Column, peer: Column) -> Column:
    """First address of the forwarded list, else the peer's, else unknown."""
    return F.when(forwarded != "", F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))).otherwise(F.coalesce(peer, F.lit("unknown")))


def with_fallback(context: dict[str, Column], failed: Column) -> list[Column]:
    """Context columns; where building them failed all are unknown and the risk is high."""
    return [F.when(failed, "unknown").otherwise(F.coalesce(c, F.lit("unknown"))).alias(n) for n, c in context.items()] + [F.when(failed, "high").otherwise("medium").alias("risk_level")]


def prompt(text: Column, context: Column) -> Column:
    """Context, with a note on placeholders where it mentions them, and the prompt, line by line."""
    some = F.when(context != "", context)
    low = F.lower(some)
    note = F.when(F.contains(low, F.lit("anonymized")) | F.contains(low, F.lit("placeholder")), "Note: Angle brackets like <name> are placeholders, not real data.")
    return F.concat_ws("\n", note, F.concat(F.lit("Context: "), some), text)


def password_ok(password: Column) -> Column:
    """Three characters at least, 72 bytes at most."""
    return F.coalesce((F.char_length(password) >= 3) & (F.octet_length(password) <= 72), F.lit(False))


def valid_email(email: Column) -> Column:
    return F.coalesce(email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))
