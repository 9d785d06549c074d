"""Model metrics from (actual, predicted) rows; sums only, so that one shuffle of a few rows is all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame) -> DataFrame:
    return df.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def label_metrics(df: DataFrame) -> DataFrame:
    """label, precision, recall, f1 and support; 0 where a quotient has no base."""
    cells = confusion_matrix(df)
    sides = cells.select(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")).union(
        cells.select("predicted", F.lit(0).cast("long"), "n", F.lit(0).cast("long"))
    )
    s = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return s.select("label", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"), "support")


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def parse_report(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows of a printed metric report: C1..C4 with precision, recall, f1 and support; accuracy with its value as precision."""
    t = F.filter(F.split(F.trim(F.col(column)), r"\s+"), lambda x: x != "")
    rows = lines.select(t.alias("t")).where(F.size("t") >= 2)
    label = F.col("t")[0]
    levels = rows.where(label.isin("C1", "C2", "C3", "C4") & (F.size("t") >= 5)).select(label.alias("label"), *[F.get("t", F.lit(k)).cast("double").alias(n) for k, n in ((1, "precision"), (2, "recall"), (3, "f1"))], F.get("t", F.lit(4)).cast("long").alias("support"))
    return levels.union(rows.where(label == "accuracy").select(label, F.col("t")[1].cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("long")))
