"""Rendered tables against the plain reader's own printing."""

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspark.sources import csv_render, csv_scan

#: Columns of three cells each; a column's type and widths don't depend on others.
COLUMNS = [
    ["1", "22", "3"], ["x", "", "y"], ["2.5", "4", "1"], ["1.123456789", "2", "3"], ["1e10", "1", "2"], ["1e-9", "1", "0"], ["1234567.5", "0.00001", "1"], ["True", "False", "true"], ["True", "", "x"], ["True", "", "False"], ["", "NA", ""],
    ["1", "NA", "3"], ["99999999999999999999", "1", "2"], ["007", "1", "2"], ["-1.5", "2", "0"], ["1000000.5", "1", "2"], ["0.1", "0.12", "0.123"], ["123456789.123", "0.001", "2"], ["1e20", "1e20", "1e20"], ["inf", "1", "2"], ["-inf", "NA", "1"],
    ["+5", "-3", "0"], ["TRUE", "false", "FALSE"], ["José", "two\nlines", "tab\there"], ["日本", "a\"b", "c,d"], ["0.0", "0", "0"], ["-0.5", "-12.25", "1"], [".5", "5.", "5.25"], ["1,5", "2", "3"], ["-999999.25", "2000000.125", "3"],
]


def lines(spark, text, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    df = csv_scan.read_csv(spark, str(path))
    order = df.withColumn("at", F.monotonically_increasing_id())  # one piece: in the file's order
    return [r.line for r in csv_render.rendered(order, ["at"]).orderBy(F.asc_nulls_first("at")).collect()]


@pytest.mark.parametrize("rows", [3, 1])
def test_rendering(spark, tmp_path, rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([[f"c{i}" * (i % 3 + 1) for i in range(len(COLUMNS))], *[[c[k] for c in COLUMNS] for k in range(rows)]])
    assert lines(spark, out.getvalue(), tmp_path) == pd.read_csv(io.StringIO(out.getvalue())).to_string(index=False).split("\n")


def test_rendering_of_random_tables(spark, tmp_path):
    rng = random.Random(8)
    for _ in range(3):
        kinds = [rng.choice(["int", "float", "word", "bool", "gaps"]) for _ in range(4)]
        make = {"int": lambda: str(rng.randrange(-500, 50_000)), "float": lambda: f"{rng.uniform(-100, 100):.{rng.randrange(5)}f}", "word": lambda: rng.choice(["a", "bcd", "é" * 7, "NULL"]), "bool": lambda: rng.choice(["true", "False"]), "gaps": lambda: rng.choice(["", "3", "4.25"])}
        text = ",".join(f"{k}{i}" for i, k in enumerate(kinds)) + "\n" + "".join(",".join(make[k]() for k in kinds) + "\n" for _ in range(30))
        if any(set(r) <= {","} for r in text.split("\n") if r):
            continue
        assert lines(spark, text, tmp_path) == pd.read_csv(io.StringIO(text)).to_string(index=False).split("\n")


def test_no_rows(spark, tmp_path):
    assert lines(spark, "a,b\n", tmp_path) == [" a  b"]
