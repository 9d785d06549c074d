"""CSV in pieces against a plain reader: quoted line ends, quotes in unquoted cells, any cut of the files."""

import csv
import io
import random

import pytest

from veilspark.plans import queries
from veilspark.sources import csv_scan
from veilspark.sources.csv_scan import Lines


@pytest.fixture
def small_pieces(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("200", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def plain_end(text, sep=","):
    """Whether a text ends inside a quoted cell: sign by sign."""
    state = "start"
    for c in text:
        if state == "quoted":
            state = "quote" if c == '"' else state
        elif state == "quote" and c == '"':
            state = "quoted"
        elif c in (sep, "\n"):
            state = "start"
        else:
            state = "quoted" if state == "start" and c == '"' else "cell"
    return state == "quoted"


def test_what_lines_do_to_the_state():
    rng = random.Random(1)
    rule = Lines(b",")
    for _ in range(20_000):
        line = "".join(rng.choice('"",ax ') for _ in range(rng.randrange(9)))
        assert rule.outside(line.encode()) == plain_end(line), line
        assert rule.inside(line.encode()) == plain_end('"\n' + line), line
    long = b'"' + b'""' * 300_000
    assert rule.outside(long) and rule.inside(long[1:]) and not rule.outside(long + b'"') and not rule.outside(b"a" * 10 + b',"b"' * 200_000)


def write(path, rows, rng, sep=",", end="\n"):
    out = io.StringIO()
    for r in rows:
        cells = []
        for c in r:
            must = any(x in c for x in (sep, "\n", "\r")) or c.startswith('"')
            cells.append('"' + c.replace('"', '""') + '"' if must or rng.random() < 0.3 else c)
        out.write(sep.join(cells) + (end if rng.random() < 0.95 else end * 2))
    path.write_bytes(out.getvalue().encode())


def content(rng):
    return "".join(rng.choice(["a", "b c", '"', "\n", ",", "é", "x" * 30, ";", "\r\n", "日本"]) for _ in range(rng.randrange(7)))


def got(df):
    return [tuple(x or "" for x in r) for r in df.collect()]


@pytest.mark.parametrize("seed, sep, end", [(1, ",", "\n"), (2, ";", "\r\n"), (3, ",", "\n")])
def test_files_of_many_pieces(spark, tmp_path, small_pieces, seed, sep, end):
    rng = random.Random(seed)
    want = []
    for k in range(2):
        rows = [["id", "no\nte", "z"]] + [[f"{k}-{i}", content(rng), content(rng) + "."] for i in range(60)]
        rows.insert(20, ["long", "line\n" * 300 + '"' * 90, "end"])
        write(tmp_path / f"f{k}.csv", rows, rng, sep, end)
        plain = list(csv.reader(io.StringIO((tmp_path / f"f{k}.csv").read_bytes().decode(), newline=""), delimiter=sep))
        assert [r for r in plain if r] == rows
        want += rows[1:]
    df = csv_scan.read_csv(spark, str(tmp_path / "*.csv"), sep)
    assert df.columns == ["id", "no\nte", "z"] and sorted(got(df)) == sorted(map(tuple, want))
    pieces = csv_scan.lines(spark, str(tmp_path / "*.csv"))
    size = sum(f.stat().st_size for f in tmp_path.glob("*.csv"))
    assert pieces.rdd.getNumPartitions() >= size / 200 and csv_scan.piece_states(pieces, sep).count() >= 5


def test_records_keep_their_order(spark, tmp_path, small_pieces):
    rng = random.Random(5)
    rows = [["h"]] + [[f"{i}\n" * rng.randrange(1, 90)] for i in range(50)]
    write(tmp_path / "f.csv", rows, rng)
    out = csv_scan.records(spark, str(tmp_path)).orderBy("begin", "place").collect()
    assert [next(csv.reader(io.StringIO(bytes(r.record).decode(), newline=""))) for r in out] == rows


def test_odd_files(spark, tmp_path, small_pieces):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfa,b\n1,5" pipe\n2,"x""y"\n3\n,""\n"open,\nnever closed')
    assert got(csv_scan.read_csv(spark, str(tmp_path / "a.csv"))) [:4] == [("1", '5" pipe'), ("2", 'x"y'), ("3", ""), ("", "")]
    assert csv_scan.read_csv(spark, str(tmp_path / "a.csv")).columns == ["a", "b"] and csv_scan.read_csv(spark, str(tmp_path / "a.csv")).count() == 5
    (tmp_path / "latin.csv").write_bytes("a,b\né,ü\nx,y\n".encode("latin-1"))
    assert got(csv_scan.read_csv(spark, str(tmp_path / "latin.csv"))) == [("é", "ü"), ("x", "y")]
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_bytes(b"a,b")
    assert csv_scan.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0 and csv_scan.read_csv(spark, str(tmp_path / "empty.csv")).columns == []
    assert csv_scan.read_csv(spark, str(tmp_path / "head.csv")).count() == 0 and csv_scan.read_csv(spark, str(tmp_path / "head.csv")).columns == ["a", "b"]
    (tmp_path / "other.csv").write_bytes(b"c,d\n1,2\n")
    with pytest.raises(ValueError):
        csv_scan.read_csv(spark, [str(tmp_path / "head.csv"), str(tmp_path / "other.csv")])


def test_empty_cells_in_quotes_are_no_nulls(spark, tmp_path, small_pieces):
    (tmp_path / "f.csv").write_bytes(b'a,b,c\n1,"",\n2,,""\n"","",""\n,,\n"",x\n')
    rows = [tuple(r) for r in csv_scan.read_csv(spark, str(tmp_path / "f.csv")).collect()]
    assert rows == [("1", "", None), ("2", None, ""), ("", "", ""), (None, None, None), ("", "x", None)]
    odd = [(0, "", "en", 0), (1, None, "en", None), (2, "", "", 0), (3, "a\r\n", None, 3), (None, None, "", None), (5, '"",\n""', "", 6)]
    spark.createDataFrame(odd, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    text = lambda x: x if x is None else str(x)
    got = [tuple(r) for r in queries.csv_scan_documents(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((tuple(map(text, r)) for r in odd), key=str)
