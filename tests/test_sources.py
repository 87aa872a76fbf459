import codecs
import random
import uuid

import pytest
from pyspark.sql import functions as F

from staffline.functions.text import NULL_TOKENS
from staffline.operators.columns import collapse_repeated
from staffline.sources import csv, records
from staffline.sources.csv import inspect_csv, read_csv
from staffline.sources.records import _with_both_states
from staffline.sources.sinks import write_table


def put(tmp_path, data: bytes, name="in.csv") -> str:
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def cells(df):
    return [tuple(r) for r in df.collect()]


def test_utf8_with_bom_and_repeated_header(spark, tmp_path):
    path = put(tmp_path, codecs.BOM_UTF8 + "ID,ANIO,X,ANIO,ID\n1,2010,ñ,2011,9\n".encode())
    df = read_csv(spark, path)
    assert df.columns == ["ID", "ANIO", "X", "ANIO.1", "ID.1"]
    assert cells(df) == [("1", "2010", "ñ", "2011", "9")]
    assert cells(collapse_repeated(df)) == [("1", "2010", "ñ")]
    assert collapse_repeated(df).columns == ["ID", "ANIO", "X"]


def test_encodings_are_tried_in_order(spark, tmp_path):
    utf8 = put(tmp_path, "a\nó\n".encode(), "u.csv")
    cp = put(tmp_path, "a€\nó“x”\n".encode("cp1252"), "c.csv")
    latin = put(tmp_path, b"a\n\xf3\x81\n", "l.csv")
    assert inspect_csv(spark, utf8)[0].encoding == "utf-8"
    assert inspect_csv(spark, cp)[0].encoding == "cp1252"
    assert inspect_csv(spark, latin)[0].encoding == "latin-1"
    assert cells(read_csv(spark, utf8)) == [("ó",)]
    got = read_csv(spark, cp)
    assert got.columns == ["a€"]
    assert cells(got) == [("ó“x”",)]
    assert cells(read_csv(spark, latin)) == [("ó\x81",)]


def test_null_spellings(spark, tmp_path):
    lines = "".join(f'"{t}",x\n' for t in NULL_TOKENS)
    df = read_csv(spark, put(tmp_path, f"a,b\n{lines}kept,y\n".encode()))
    assert [r.a for r in df.collect()] == [None] * len(NULL_TOKENS) + ["kept"]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_cells_with_quotes_and_line_breaks(spark, tmp_path, newline):
    rows = ["ID,NOTE", '1,"say ""hi"""', '2,"two\nlines, one cell"', "3,plain", '4,"a\n\nb"']
    path = put(tmp_path, newline.join(rows + [""]).encode())
    assert inspect_csv(spark, path)[0].breaks_in_cells
    df = read_csv(spark, path, with_ordinal=True)
    got = [(r.ID, r.NOTE) for r in df.orderBy("_ORDINAL").collect()]
    assert got == [
        ("1", 'say "hi"'), ("2", "two\nlines, one cell"), ("3", "plain"), ("4", "a\n\nb"),
    ]


def by_pandas(path):
    import pandas as pd

    return pd.read_csv(path, dtype=str, keep_default_na=False)


@pytest.mark.parametrize(
    "text",
    [
        'id,note\n1,5" pipe\n2,plain\n3,"a ""b"""\n4,c\n5,d\n',
        'id,note\n1,x\n2,y" z\n3,u\n4,v\n5,w\n6,t\n7,s\n',
        'ID,"NO\nTE",X\n1,a,b\n2,"c\r\nd",e\n',
        'id,note\r\n1,"a\nb"\r\n2,c\r\n',
        "id,note\n1\n2,\n3,x\n",
    ],
)
def test_stray_quotes_broken_headers_and_short_rows_as_pandas_reads_them(spark, tmp_path, text):
    path = put(tmp_path, text.encode())
    expected = by_pandas(path)
    df = read_csv(spark, path, with_ordinal=True)
    assert df.columns[:-1] == list(expected.columns)
    got = [tuple(c or "" for c in r[:-1]) for r in df.orderBy("_ORDINAL").collect()]
    assert got == [tuple("" if c != c else c for c in r) for r in expected.itertuples(index=False)]


@pytest.mark.parametrize("surplus", ["5,y,extra", "5,y,extra,more", '5,y,"line\nbreak"'])
def test_surplus_cells_raise(spark, tmp_path, surplus):
    path = put(tmp_path, f"a,b\n1,x\n{surplus}\n".encode())
    with pytest.raises(Exception, match="more cells than the header"):
        read_csv(spark, path).collect()


def test_files_of_one_extract_keep_their_own_header_and_encoding(spark, tmp_path):
    folder = tmp_path / "extract"
    folder.mkdir()
    put(folder, "A,B\n1,ó\n".encode(), "1.csv")
    put(folder, "B,A\né“,2\n".encode("cp1252"), "2.csv")
    put(folder, 'A,B\n3,"x\ny"\n'.encode(), "3.csv")
    df = read_csv(spark, str(folder), with_ordinal=True).orderBy("_ORDINAL")
    assert [(r.A, r.B) for r in df.collect()] == [("1", "ó"), ("2", "é“"), ("3", "x\ny")]
    put(folder, b"A,C\n1,2\n", "4.csv")
    with pytest.raises(ValueError, match="different columns"):
        read_csv(spark, str(folder))


def test_files_without_rows_or_header(spark, tmp_path):
    assert read_csv(spark, put(tmp_path, b"a,b\n", "h.csv")).columns == ["a", "b"]
    assert read_csv(spark, put(tmp_path, b"a,b\n", "h.csv")).count() == 0
    assert read_csv(spark, put(tmp_path, b"", "e.csv")).count() == 0


def test_ordinal_follows_the_file(spark, tmp_path):
    body = "".join(f"{i}\n" for i in range(3000))
    path = put(tmp_path, ("n\n" + body).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        rows = read_csv(spark, path, with_ordinal=True).orderBy("_ORDINAL").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [int(r.n) for r in rows] == list(range(3000))


def test_written_tables_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, t string")
    out = write_table(df, str(tmp_path / "t"))
    assert sorted(cells(spark.read.parquet(out))) == [(1, "a,b"), (2, None)]
    out = write_table(df, str(tmp_path / "c"), "csv")
    assert sorted(cells(read_csv(spark, out))) == [("1", "a,b"), ("2", None)]
    with pytest.raises(ValueError):
        write_table(df, out, "xml")


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def random_rows(rng, n):
    cell = lambda: "".join(rng.choices(["a", "é", " ", ",", '"', "\n", "\n\n", 'x"y'], k=rng.choice([0, 1, 3, 8, 60])))
    return [(f"k{i}", cell(), cell()) for i in range(n)]


def spelled(rows, newline, rng):
    """Cells quoted where they must be and sometimes where they need not."""
    must = lambda c: any(x in c for x in ',"\n') or c.startswith('"')
    one = lambda c: '"' + c.replace('"', '""') + '"' if must(c) or rng.random() < 0.2 else c
    return newline.join([*(",".join(map(one, r)) for r in rows), ""])


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["utf-8", "cp1252"])
def test_a_file_with_line_breaks_in_cells_is_read_in_splits(spark, tmp_path, small_splits, newline, encoding):
    rng = random.Random(f"{newline}{encoding}")
    rows = random_rows(rng, 1200)
    text = spelled([("k", "note, one", 'x "y"'), *rows], newline, rng) + ("" if encoding == "utf-8" else f"last,€,“{newline}")
    path = put(tmp_path, text.encode(encoding))
    df = read_csv(spark, path, with_ordinal=True)
    got = [tuple(r[:3]) for r in df.orderBy("_ORDINAL").collect()]
    from staffline.functions.text import NULL_TOKENS

    expected = [tuple(None if c in NULL_TOKENS else c for c in r) for r in rows]
    assert df.columns[:3] == ["k", "note, one", 'x "y"']
    assert got[: len(rows)] == expected and len(got) == len(rows) + (encoding == "cp1252")
    assert df.select("_ORDINAL.block").distinct().count() > 5


def test_a_cell_over_many_splits(spark, tmp_path, small_splits):
    """A record longer than splits, quotes at the edges of lines, a split of nothing but text."""
    long = "\n".join(f'line {i} , "" and "more""' .replace('"', "'") for i in range(400))
    tricky = 'a"\n"b,\n,"\n""\nc'
    rows = [("1", long), ("2", tricky), ("3", "plain"), ("4", long + '"'), ("5", "end")]
    path = put(tmp_path, spelled([("k", "v"), *rows], "\n", random.Random(0)).encode())
    assert [tuple(r) for r in read_csv(spark, path).orderBy("k").collect()] == rows


def test_files_without_rule_are_read_as_before(spark, tmp_path):
    """A quote that closes before the cell ends, a file that ends in a cell, lone CRs."""
    for i, text in enumerate(['a,b\n1,"x"y\n2,"u\nv"\n', 'a,b\n1,x\n2,"open\nto the end', 'a,b\n1,"x\ry"\n2,"p\nq"\n']):
        path = put(tmp_path, text.encode(), f"{i}.csv")
        (file,) = inspect_csv(spark, path)
        assert file.whole and file.header == ("a", "b")
        plain = csv._reader(spark, "utf-8", True).option("header", True).schema("a string, b string").csv(path)
        assert cells(read_csv(spark, path)) == cells(plain)


def test_a_quote_without_partner_raises(spark, tmp_path):
    path = put(tmp_path, ('a,b\n1,"x\n' + "2,y\n" * 50).encode())
    lines = csv._lines(spark, path)
    name = lines.first().path
    with pytest.raises(ValueError, match="51 lines"):
        records.find_records(lines, [(name, False, False)], record_lines=40)


def jobs_of(spark, action):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_number_of_files(spark, tmp_path):
    """Every encoding, marks, headers of one line and of two, cells with breaks."""
    seen = {}
    for n in (12, 120):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            head = '"a\nb",c,c' if i % 3 else "\ufeff" * (i % 2) + '"a\nb",c,c'
            text = f'{head}\n{i},"x\ny{"“" if i % 2 else "ó"}",z\n{i + 1000},plain,w\n'
            put(folder, text.encode("cp1252" if i % 3 else "utf-8"), f"{i}.csv")
        found = []
        seen[n] = jobs_of(spark, lambda: found.append(read_csv(spark, str(folder))))
        assert found[0].columns == ["a\nb", "c", "c.1"] and found[0].count() == 2 * n
        assert found[0].where(F.col("c").startswith("x\ny")).count() == n
    assert seen[120] <= seen[12] + 2


def test_lines_are_moved_and_sorted_once(spark):
    """All running values of a split share one exchange and one sort of its lines."""
    at = "named_struct('file', 'f', 'block', id % 3, 'row', id) at"
    lines = spark.range(60).selectExpr("'f' path", at, "if(id % 4 = 1, 'a,\"b', if(id % 4 = 2, 'c\"', '')) line")
    plan = _with_both_states(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
