"""Building blocks of the DuckDB statements that check the queries."""

from __future__ import annotations

from veilspark.operators.patterns import LEVELS, PATTERNS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def texts(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def has_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {q(w)})" for w in words) + ")"


def allowed() -> str:
    """Condition on level and type: the level redacts the type."""
    parts = [f"(level = '{lv}' AND type IN {names(types)})" for lv, types in LEVELS.items() if types and lv != "C4"]
    return "(" + " OR ".join([*parts, "level = 'C4' OR level IS NULL"]) + ")"


def redaction(base: str, where: str = "TRUE", tail: str = "SELECT id, redacted_text, total_redacted FROM red") -> str:
    """Spans, detections and redacted text of ``base`` (id, text, level), as CTEs base, spans, agg and red; then ``tail``."""
    each = " UNION ALL ".join(
        f"SELECT id, level, {p.ord} AS ord, {q(p.type)} AS type, {q(p.placeholder)} AS ph, regexp_extract_all(text, {q(p.re2)}) AS f, string_split_regex(text, {q(p.re2)}) AS g FROM base" for p in PATTERNS
    )
    return f"""
WITH base AS ({base}),
m AS ({each}),
spans AS (SELECT id, level, ord, type, ph, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, f[i] AS original
          FROM m, unnest(range(1, len(f) + 1)) AS t(i) WHERE {where}),
agg AS (SELECT id, list({{'s': s, 'l': length(original)::BIGINT, 'p': ph, 't': ''}} ORDER BY s DESC, ord) AS sp,
               list({{'type': type, 'original': original, 'placeholder': ph}} ORDER BY s, ord DESC) AS detections, count(*) AS n FROM spans GROUP BY id),
red AS (SELECT base.id, text, level, coalesce(n, 0) AS total_redacted, detections,
               coalesce(list_reduce(list_prepend({{'s': 0::BIGINT, 'l': 0::BIGINT, 'p': '', 't': text}}, sp),
                 lambda a, x: {{'s': x.s, 'l': x.l, 'p': x.p, 't': substr(a.t, 1, x.s) || x.p || substr(a.t, x.s + x.l + 1)}}).t, text) AS redacted_text
        FROM base LEFT JOIN agg ON agg.id = base.id),
det AS (SELECT id, i - 1 AS pos, detections[i].type AS type, detections[i].original AS original, detections[i].placeholder AS placeholder FROM red, unnest(range(1, coalesce(len(detections), 0) + 1)) AS t(i))
{tail}"""
