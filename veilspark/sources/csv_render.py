"""A table of strings as aligned lines of text, typed by its columns: two aggregates over the table, then a line for each row.

The first aggregate is each column's place in a lattice of types (whole number and truth value below number, all below
text); the second has the widths that its printed values need. Both are one row, whatever the table's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Cells that stand for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
DIGITS = 6  # decimals at most
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|Inf|INF|infinity|Infinity)\s*$"
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def _gone(c: Column) -> Column:
    return c.isNull() | c.isin(*MISSING)


def _whole(c: Column) -> Column:
    return F.when(c.rlike(WHOLE), F.regexp_replace(F.btrim(c), r"^\+", "").try_cast("long"))


def _number(c: Column) -> Column:
    bare = F.lower(F.btrim(c))
    return F.when(c.rlike(NUMBER), F.when(bare.startswith("-inf"), F.lit(float("-inf"))).when(bare.rlike("^[+]?inf"), F.lit(float("inf"))).otherwise(bare.try_cast("double")))


def types_of(df: DataFrame, columns: list[str]) -> list[str]:
    """whole, truth, number or text for each column. Whole numbers beyond 64 bits are text; a column without any value is a number's."""

    def facts(n: str) -> Column:
        c = F.col(f"`{n}`")
        return F.struct((~_gone(c)).alias("there"), _whole(c).isNotNull().alias("whole"), c.rlike(WHOLE).alias("digits"), c.isin(*TRUE, *FALSE).alias("truth"), _number(c).isNotNull().alias("number"))

    def joined(f: Column) -> Column:
        every = lambda x: F.coalesce(F.bool_and(F.when(f["there"], F.coalesce(f[x], F.lit(False)))), F.lit(True)).alias(x)
        return F.struct(F.coalesce(F.bool_and(f["there"]), F.lit(True)).alias("full"), F.coalesce(F.bool_or(f["there"]), F.lit(False)).alias("any"), *map(every, ("whole", "digits", "truth", "number")))

    cells = df.select(*[facts(n).alias(f"f{i}") for i, n in enumerate(columns)])
    row = cells.agg(*[joined(F.col(n)).alias(n) for n in cells.columns]).first()
    kind = lambda f: "number" if not f.any else "truth" if f.truth and f.full else "whole" if f.whole and f.full else "text" if f.digits and not f.whole else "number" if f.number else "text"
    return [kind(f) for f in row]


def _fixed(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{DIGITS}f", x))  # a null would be printed as one


def _power(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{DIGITS}e", x))


def _text(c: Column) -> Column:
    shown = reduce(lambda t, ab: F.replace(t, F.lit(ab[0]), F.lit(ab[1])), (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")), c)
    return F.when(_gone(c), "NaN").otherwise(shown)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cell(c: Column, kind: str) -> Column:
    """What a cell adds to the second aggregate."""
    if kind != "number":
        return F.struct(F.char_length(_shown(c, kind, None)).alias("width"))

    def of(x: Column) -> Column:
        usual = F.when(F.abs(x) < float("inf"), x)
        other = F.when(x.isNull(), 3).when(F.abs(x) == float("inf"), F.when(x < 0, 4).otherwise(3)).otherwise(0)

        def parts(f: Column) -> Column:
            decimals = F.greatest(F.char_length(F.regexp_extract(f, r"\.([0-9]*?)0*$", 1)), F.lit(1))
            return F.struct(F.when(f.isNotNull(), decimals).alias("decimals"), F.char_length(F.substring_index(f, ".", 1)).alias("before"), F.char_length(_power(usual)).alias("power"), (F.abs(x) > 1e6).alias("large"), ((F.abs(x) < 10.0**-DIGITS) & (x != 0)).alias("small"), other.alias("other"))

        return _let(_fixed(usual), parts)

    return _let(_number(c), of)


def _facts(f: Column, kind: str) -> Column:
    """What the second aggregate knows of a column."""
    most = lambda x, least: F.coalesce(F.max(f[x]), F.lit(least)).alias(x)
    some = lambda x: F.coalesce(F.bool_or(f[x]), F.lit(False)).alias(x)
    if kind != "number":
        return F.struct(most("width", 0))
    return F.struct(most("decimals", 1), most("before", 0), most("power", 0), some("large"), some("small"), most("other", 0))


def _powers(f: Row) -> bool:
    return f.small or (f.large and max(f.before + 1 + f.decimals if f.before else 0, f.other) > DIGITS + 6)


def _shown(c: Column, kind: str, f: Row | None) -> Column:
    if kind == "whole":
        return _whole(c).cast("string")
    if kind == "truth":
        return F.when(c.isin(*TRUE), "True").otherwise("False")
    if kind == "text":
        return _text(c)

    def number(x: Column) -> Column:
        fixed = _let(_fixed(x), lambda t: F.substring(t, F.lit(1), F.length(t) - DIGITS + f.decimals))
        return F.when(x.isNull(), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(_power(x) if _powers(f) else fixed)

    return _let(_number(c), number)


def rendered(df: DataFrame, order: list[str] = ()) -> DataFrame:
    """``order`` columns and line: a line for the titles (order columns null) and one for each row, all columns but ``order`` as text.

    Values are aligned to the right, with a space between columns and one before the title of a column that isn't text. Numbers have the decimals that some value of the
    column needs, at most six, or powers of ten where there are values under a millionth, or over a million that get long. Missing values are NaN.
    A table without rows has its titles."""
    columns = [c for c in df.columns if c not in order]
    kinds = types_of(df, columns)
    cells = df.select(*[_cell(F.col(f"`{n}`"), k).alias(f"f{i}") for i, (n, k) in enumerate(zip(columns, kinds, strict=True))])
    facts = cells.agg(*[_facts(F.col(f), k).alias(f) for f, k in zip(cells.columns, kinds, strict=True)]).first()

    def width(title: str, kind: str, f: Row) -> int:
        own = f.width if kind != "number" else max(f.power if _powers(f) else f.before + 1 + f.decimals if f.before else 0, f.other)
        return max(own, len(title) + (kind != "text"))

    widths = [width(n, k, f) for n, k, f in zip(columns, kinds, facts, strict=True)]
    cells = [F.lpad(_shown(F.col(f"`{n}`"), k, f), w, " ") for n, k, f, w in zip(columns, kinds, facts, widths, strict=True)]
    body = df.select(*order, F.concat_ws(" ", *cells).alias("line"))
    title = " ".join(n.rjust(w) for n, w in zip(columns, widths, strict=True))
    head = df.sparkSession.range(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order], F.lit(title).alias("line"))
    return head.union(body)
