import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tabrig.sources.delimited import first_record, header, inside_after, physical_lines, records, split_starts
from tabrig.sources.io import read_table_csv


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few bytes, so that boundaries fall everywhere."""
    keys = {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(spark, path):
    got = records(spark, str(path)).collect()
    heads = [r["text"] for r in got if r["head"]]
    body = sorted(((r["n"], r["text"]) for r in got if not r["head"]))
    assert [n for n, _ in body] == list(range(len(body)))
    return heads, [t for _, t in body]


def parsed(texts):
    return [next(csv.reader(io.StringIO(t, newline=""))) for t in texts]


def invented(rnd, n):
    cells = ["plain", "", "a,b", "two\nlines", 'say ""', "x\r\ny", '"', "\n", "long " * 30 + "\n" + "text " * 30, "5' pipe", "\n\n\n", "ünï", " "]
    return [[str(i), rnd.choice(cells), rnd.choice(cells)] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("last", [True, False])
def test_records_at_any_split_equal_a_reader_of_the_whole_file(tiny_splits, tmp_path, end, last):
    rows = invented(random.Random(len(end) + last), 120)
    buf = io.StringIO()
    csv.writer(buf, lineterminator=end).writerows([["id", "a", "b"], *rows])
    data = buf.getvalue() if last else buf.getvalue().removesuffix(end)
    (tmp_path / "t.csv").write_bytes(data.encode())
    heads, body = rows_of(tiny_splits, tmp_path / "t.csv")
    assert parsed(heads) == [["id", "a", "b"]] and parsed(body) == rows
    assert physical_lines(tiny_splits, str(tmp_path / "t.csv")).rdd.getNumPartitions() > 20


def test_a_field_over_many_splits_and_an_open_end(tiny_splits, tmp_path):
    text = "\n".join(f"line {i}, of one field" for i in range(40))
    (tmp_path / "t.csv").write_text(f'id,text\n1,"{text}"\n\n2,x\n3,"never\nclosed')
    heads, body = rows_of(tiny_splits, tmp_path / "t.csv")
    assert heads == ["id,text"] and body == [f'1,"{text}"', "2,x", '3,"never\nclosed']


def test_files_of_a_folder_follow_each_other(tiny_splits, tmp_path):
    want = []
    for k in range(4):
        rows = invented(random.Random(k), 15)
        with open(tmp_path / f"part-{k}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows([['the "id"', "a\nb", "c"], *rows])
        want += rows
    heads, body = rows_of(tiny_splits, tmp_path)
    assert parsed(heads) == [['the "id"', "a\nb", "c"]] * 4 and parsed(body) == want


def test_quotes_within_unquoted_fields_are_text(tiny_splits, tmp_path):
    (tmp_path / "t.csv").write_text('id,size\n1,5" pipe\n2,6"\n3,"a ""b"\n4,x"y"z\n')
    _, body = rows_of(tiny_splits, tmp_path / "t.csv")
    assert body == ['1,5" pipe', '2,6"', '3,"a ""b"', '4,x"y"z']


def test_states_of_splits(tiny_splits, tmp_path):
    (tmp_path / "t.csv").write_text("h\n" + '"' + "in\n" * 60 + '"\n' + "out\n" * 60)
    states = list(split_starts(physical_lines(tiny_splits, str(tmp_path / "t.csv"))).values())
    assert states[0] == (False, -1) and states[1][0] and not states[-1][0]
    assert [n for _, n in states] == sorted(n for _, n in states)


@pytest.mark.parametrize("line,inside,want", [("a,b", False, False), ('"a', False, True), ('a"', True, False), ('a""', True, True), ('a"",b', True, True),
                                              ('a","b', True, True), ('","', True, True), ('x"y', False, False), ("", True, True), ('""', False, False),
                                              ('"a"b"c,"', False, True), ('a,"b","c', False, True)])
def test_inside_after(line, inside, want):
    assert inside_after(line, inside) is want


def test_headers(spark, tmp_path):
    assert header("\ufeffa,b,a,,a") == ["a", "b", "a.1", "Unnamed: 3", "a.2"]
    (tmp_path / "t.csv").write_text('\n\n"a\nb",c\n')
    assert first_record(spark, str(tmp_path / "t.csv")) == '"a\nb",c'
    back = read_table_csv(spark, str(tmp_path / "t.csv"))
    assert back.columns == ["a\nb", "c", "_row_id"] and back.count() == 0
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="header"):
        read_table_csv(spark, str(tmp_path / "empty.csv"))


def test_table_of_many_splits(tiny_splits, tmp_path):
    lines = ["n,x,flag,text"] + [f'{i},{i / 4},{"true" if i % 2 else "false"},"row {i}\nof, many"' for i in range(200)] + ["200,NA,true", "201,1e3,false,a,b"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    back = read_table_csv(tiny_splits, str(tmp_path / "t.csv"))
    assert dict(back.dtypes) == {"n": "bigint", "x": "double", "flag": "boolean", "text": "string", "_row_id": "bigint"}
    assert back.where(F.col("n") == F.col("_row_id")).count() == 202
    got = {r["n"]: r for r in back.collect()}
    assert got[7]["text"] == "row 7\nof, many" and got[200]["x"] is None and got[200]["text"] is None and got[201]["text"] == "a"
