"""Find, redact and restore sensitive spans.

Every pattern scans the original text by itself. Matches are replaced from the right with their original offsets, on
the text as changed so far: where matches overlap, neighbouring text is lost, by definition. ``resolve_overlaps`` asks
for the clean variant instead, in which a match that overlaps an earlier-starting one is left out.

Two forms give the same rows: Python's ``re`` over Arrow batches (the default: faster for many patterns, exact in its
Unicode classes), and Spark's own functions (``native``), which stay in the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.frames import fresh, same_columns, sliced
from veilspark.operators.patterns import PATTERNS, Pattern, compiled, may_match, types_of_level

_DIGIT = re.compile(r"\d")
DETECTION = pa.struct([("type", pa.string()), ("original", pa.string()), ("placeholder", pa.string())])
DETECTIONS_SQL = "array<struct<type:string,original:string,placeholder:string>>"


def find(text: str, patterns: list[tuple[Pattern, re.Pattern, re.Pattern]]) -> list[tuple[int, int, int, Pattern, str]]:
    """Matches as (start, end, tie order, pattern, text), from the last start to the first, ties by order.

    Texts in ASCII are lowered once and meet the quicker forms, which match in the same places."""
    if text.isascii():
        low = text.lower()
        out = [(s, e, k, p, text[s:e]) for k, (p, _, quick) in enumerate(patterns) for s, e in p.spans(low, quick)]
    else:
        out = [(m.start(), m.end(), k, p, m.group()) for k, (p, regex, _) in enumerate(patterns) for m in regex.finditer(text)]
    out.sort(key=lambda m: (-m[0], m[2]))
    return out


def replace(text: str, matches: list[tuple[int, int, int, Pattern, str]]) -> str:
    for start, end, _, p, _ in matches:
        text = text[:start] + p.placeholder + text[end:]
    return text


def apart(matches: list[tuple[int, int, int, Pattern, str]]) -> list[tuple[int, int, int, Pattern, str]]:
    """Without the matches that begin before an earlier one has ended; of those with one start the longest stays."""
    out, reach = [], -1
    for m in sorted(matches, key=lambda m: (m[0], -m[1], m[2])):
        if m[0] >= reach:
            out.append(m)
            reach = m[1]
    return out[::-1]


def redact(df: DataFrame, text: str = "text", level: str | None = None, types: list[str] | None = None, resolve_overlaps: bool = False, detections: bool = True) -> DataFrame:
    """``df`` with redacted_text, detections and total_redacted (columns of these names are replaced).

    ``level`` names a column with C1..C4 or null, which picks the patterns row by row; ``types`` names them for all
    rows, in tie order. Without ``detections`` these aren't built, and the column isn't there. Null texts give null and
    no detections. No shuffle, one Arrow pass; works on streams too."""
    added = ("redacted_text", "detections", "total_redacted") if detections else ("redacted_text", "total_redacted")
    kept = [c for c in df.columns if c not in ("redacted_text", "detections", "total_redacted")]
    # a string column that is kept anyway travels once
    own = text in kept and dict(df.dtypes)[text] == "string"
    body, policy = fresh(df.columns, "body", "policy")
    extra = [] if own else [F.col(text).cast("string").alias(body)]
    source = df.select(*kept, *extra, *([F.col(level).cast("string").alias(policy)] if level else []))
    kinds = {"redacted_text": "string", "detections": DETECTIONS_SQL, "total_redacted": "long"}
    schema = df.select(*kept).withColumns({c: F.lit(None).cast(kinds[c]) for c in added}).schema
    at = kept.index(text) if own else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str | None, list] = {}
        for b in sliced(batches, at):
            texts, totals, ends, types_, originals, places = [], [], [0], [], [], []
            levels = b.column(b.num_columns - 1).to_pylist() if level else [None] * b.num_rows
            for t, lv in zip(b.column(at).to_pylist(), levels, strict=True):
                if lv not in sets:
                    sets[lv] = compiled(types if types is not None else types_of_level(lv))
                matches = find(t, sets[lv]) if t is not None else []
                if resolve_overlaps:
                    matches = apart(matches)
                texts.append(replace(t, matches) if matches else t)
                totals.append(len(matches))
                if detections:
                    for _, _, _, p, m in reversed(matches):
                        types_.append(p.type)
                        originals.append(m)
                        places.append(p.placeholder)
                    ends.append(len(originals))
            found = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (types_, originals, places)], fields=list(DETECTION)))] if detections else []
            columns = [pa.array(texts, pa.string()), *found, pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *columns], names=[*kept, *added])

    return source.mapInArrow(run, schema)


SPANS_SQL = "array<struct<start:int,ord:int,length:int,type:string,placeholder:string,original:string>>"
_CUT = "\uE000"  # a private sign; a text that has it takes the slower way


def native_spans(text: Column, types: list[str] | None = None) -> Column:
    """array<struct<start,ord,length,type,placeholder,original>> of all matches, last start first, with Spark's functions only.

    Texts in ASCII, on which they say the same, meet the cheaper expressions without Unicode classes."""

    def of(p: Pattern, regex: str) -> Column:
        # Spark compiles a split's expression for each row, a replacement's once
        parts = F.when(F.contains(text, F.lit(_CUT)), F.split(text, regex, -1)).otherwise(F.split(F.regexp_replace(text, regex, _CUT), _CUT, -1))
        both = F.struct(parts.alias("parts"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found"))
        before = lambda x, n: F.char_length(F.array_join(F.slice(x, F.lit(1), n), ""))

        def span(x: Column, m: Column, i: Column) -> Column:
            start = before(x["parts"], i + 1) + before(x["found"], i)
            return F.struct(start.alias("start"), F.lit(p.ord).alias("ord"), F.char_length(m).alias("length"), F.lit(p.type).alias("type"), F.lit(p.placeholder).alias("placeholder"), m.alias("original"))

        # in an array of one, so that the inner function's body doesn't evaluate the expressions again for each match
        spans = F.transform(F.array(both), lambda x: F.transform(x["found"], lambda m, i: span(x, m, i)))
        return F.when(F.regexp_like(text, F.lit(regex)), F.get(spans, F.lit(0))).otherwise(F.array().cast(SPANS_SQL))

    chosen = [p for p in PATTERNS if types is None or p.type in types]
    spans = F.when(_ascii(text), F.concat(*[of(p, p.ascii) for p in chosen])).otherwise(F.concat(*[of(p, p.java) for p in chosen]))
    order = lambda a, b: F.when(a["start"] != b["start"], b["start"] - a["start"]).otherwise(a["ord"] - b["ord"])
    return F.when(text.isNotNull(), F.when(may_match(text), F.array_sort(spans, order)).otherwise(F.array().cast(SPANS_SQL)))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def native_redacted(text: Column, spans: Column) -> Column:
    """The text with native_spans() replaced."""
    return F.aggregate(spans, text, lambda t, x: F.concat(F.substring(t, F.lit(1), x["start"]), x["placeholder"], F.substring(t, x["start"] + x["length"] + 1, F.char_length(t))))


def count(text: Column, p: Pattern) -> Column:
    """Number of matches of a pattern, JVM-side. Most texts lack what a pattern needs, so that only few meet the pattern itself."""
    return F.when(~p.may_match(text), 0).when(_ascii(text), F.regexp_count(text, F.lit(p.ascii))).otherwise(F.regexp_count(text, F.lit(p.java)))


def found(text: str, patterns: list[tuple[Pattern, re.Pattern, re.Pattern]]) -> list[int]:
    """Number of matches of each of the patterns, like find(); those that need a sign which the text lacks aren't searched for."""
    plain, digit = text.isascii(), _DIGIT.search(text)
    low = text.lower() if plain else text

    def n(p: Pattern, regex: re.Pattern, quick: re.Pattern) -> int:
        if "@" not in text if p.type == "EMAIL" else not (digit or p.type in ("NATIONAL_ID", "BIOMETRIC")):
            return 0
        return len(p.spans(low, quick)) if plain else sum(1 for _ in regex.finditer(text))

    return [n(*p) for p in patterns]


def counts(text: Column) -> list[Column]:
    """Number of matches of each pattern, JVM-side."""
    return [count(text, p).cast("long").alias(f"n_{p.type.lower()}") for p in PATTERNS]


def detection_rows(redacted: DataFrame, id: str) -> DataFrame:
    """A row for each detection: id, pos (from 0), type, original, placeholder."""
    return redacted.select(id, F.posexplode("detections").alias("pos", "d")).select(id, F.col("pos").cast("long").alias("pos"), "d.type", "d.original", "d.placeholder")


def detection_summary(redacted: DataFrame, id: str) -> DataFrame:
    """Count of detections by id and type, with the place of the type's first appearance."""
    return detection_rows(redacted, id).groupBy(id, "type").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def originals_by_type(redacted: DataFrame, id: str) -> DataFrame:
    """For each id and type the originals in order; within a row, so without a shuffle."""
    types = F.array_distinct(F.transform("detections", lambda d: d["type"]))
    rows = redacted.select(id, "detections", F.explode(types).alias("type"))
    return rows.select(id, "type", F.transform(F.filter("detections", lambda d: d["type"] == F.col("type")), lambda d: d["original"]).alias("originals"))


def overlaps(df: DataFrame, text: str = "text") -> DataFrame:
    """first_type, second_type and n: pairs of matches of different patterns in a text of which the second begins, ties by the
    catalogue's order, before the first has ended. One Arrow pass that sums up each slice; only sums are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = compiled()
        for b in sliced(batches, 0):
            pairs: Counter[tuple[str, str]] = Counter()
            for t in b.column(0).to_pylist():
                open_: list[tuple[int, int, int, Pattern, str]] = []
                for m in sorted(find(t, patterns), key=lambda m: (m[0], m[2])) if t else ():
                    open_ = [a for a in open_ if a[1] > m[0]]
                    pairs.update((a[3].type, m[3].type) for a in open_ if a[2] != m[2])
                    open_.append(m)
            if pairs:
                first, second = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(list(pairs.values()), pa.int64())], names=["first_type", "second_type", "n"])

    rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "first_type string, second_type string, n long")
    return rows.groupBy("first_type", "second_type").agg(F.sum("n").alias("n"))


def reduction(original: Column, redacted: Column) -> list[Column]:
    """Lengths in code points, and by how many percent the text got shorter (0 for an empty one; may be negative)."""
    a, b = F.char_length(original).cast("long"), F.char_length(redacted).cast("long")
    return [a.alias("original_length"), b.alias("scrubbed_length"), F.when(a > 0, F.round((1 - b / a) * 100, 2)).otherwise(0.0).alias("reduction_percentage")]


def restored(text: Column, detections: Column) -> Column:
    """struct(text, n): detection by detection, a placeholder that is still in the text is replaced everywhere by its original.

    So the first original of a repeated type fills all its places, and the later ones don't count."""
    start = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, d: Column) -> Column:
        fits = (d["placeholder"] != "") & (d["original"] != "") & F.contains(acc["text"], d["placeholder"])
        return F.when(fits, F.struct(F.replace(acc["text"], d["placeholder"], d["original"]).alias("text"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return F.aggregate(detections, start, step)


def restore_requests(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Restore by session_id: status (200, 404 without a record of action text_redacted, 400 without detections), text and count.

    ``records``: session_id, action, timestamp, redacted_text, detections; the earliest of a session counts."""
    session, record, back = fresh(requests.columns, "session", "record", "back")
    known = records.where("action = 'text_redacted'").groupBy(F.col("session_id").alias(session)).agg(F.min_by(F.struct("redacted_text", "detections"), "timestamp").alias(record))
    joined = requests.join(known, F.col("session_id") == F.col(session), "left")
    found = F.col(record)["detections"]
    status = F.when(F.col(session).isNull(), 404).when(F.coalesce(F.size(found), F.lit(0)) <= 0, 400).otherwise(200)
    ok = status == 200
    kept = same_columns(requests, "status", "restored_text", "restored")
    out = joined.withColumn(back, restored(F.col(record)["redacted_text"], found))
    return out.select(*kept, status.alias("status"), F.when(ok, F.col(back)["text"]).alias("restored_text"), F.when(ok, F.col(back)["n"]).alias("restored"))


def preview(text: Column, size: int = 200) -> Column:
    """The first ``size`` characters, and ``...`` if there are more."""
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
