"""Files whose cells hold line breaks, cut into records by many tasks."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from scrubline import CleanOptions
from scrubline.plans.files import clean_files
from scrubline.sources import records
from scrubline.sources.delimited import FILE, PLACE, find_layouts, read_layout
from scrubline.sources.lines import opens, stays_open


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256")
    yield
    spark.conf.set(key, before)


def table(seed: int, rows: int, sep: str = ",") -> tuple[str, list[list[str]]]:
    """A file of cells with line breaks, quotes and delimiters, as the csv module writes it."""
    some = random.Random(seed)
    pieces = ["a", "bc", '"', '""', "\n", sep, "\n\n", " x", "é", f'{sep}"', f'"{sep}', "long " * 30]
    cells = [
        [str(i), *("".join(some.choices(pieces, k=some.randrange(5))) for _ in range(2))]
        for i in range(rows)
    ]
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="\n").writerows([["id", "p", "q"], *cells])
    return out.getvalue(), cells


def read_cells(spark, path, **options):
    layouts, _ = find_layouts(spark, [path], **options)
    assert len(layouts) == 1
    rows = read_layout(spark, layouts[0]).orderBy(PLACE).collect()
    return layouts[0], [["" if c is None else c for c in list(r)[2:]] for r in rows]


@pytest.mark.parametrize("sep, encoding", [(",", "utf-8"), ("\t", "utf-8"), (";", "cp1252")])
def test_records_cross_any_number_of_splits(spark, tmp_path, small_splits, sep, encoding):
    content, cells = table(7, 120, sep)
    path = str(tmp_path / "cells.csv")
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(content)
    layout, rows = read_cells(spark, path)
    assert (layout.multiline, layout.encoding, layout.width) == (True, encoding, 3)
    assert rows == cells
    scan = spark.read.text(path).select(F.spark_partition_id().alias("task")).distinct()
    assert scan.count() > 20


def brute_states(line: str, sep: str, inside: bool) -> bool:
    """The state after a line, one character after another."""
    start, i = not inside, 0
    while i < len(line):
        if inside:
            if line[i] == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif line[i] == '"':
                inside = start = False
        elif line.startswith(sep, i):
            start, i = True, i + len(sep) - 1
        else:
            inside, start = start and line[i] == '"', False
        i += 1
    return inside


@pytest.mark.parametrize("sep", [",", "|", "||"])
def test_states_of_lines(spark, sep):
    some = random.Random(3)
    lines = ["".join(some.choices(['"', '"', "a", " ", *sep], k=some.randrange(9))) for _ in range(3000)]
    lines += ['"' + "x" * 200_000, '""' * 100_000, f'"a"{sep}' * 50_000 + '"', "", '"']
    df = spark.createDataFrame([(x,) for x in lines], "line string").repartition(4)
    told = df.select("line", opens(F.col("line"), sep), stays_open(F.col("line"), sep)).collect()
    wrong = [
        r for r in told
        if (r[1], r[2]) != (brute_states(r[0], sep, False), brute_states(r[0], sep, True))
    ]
    assert wrong == []


def test_a_quote_within_a_cell_opens_nothing(spark, tmp_path):
    path = tmp_path / "inches.csv"
    path.write_text('id,part,size\n1,5" pipe,6" long\n2,plain,"7"" x"\n3,8" pipe,short\n')
    layout, rows = read_cells(spark, str(path))
    assert not layout.multiline and layout.width == 3
    assert [r[:2] for r in rows] == [["1", '5" pipe'], ["2", "plain"], ["3", '8" pipe']]


def test_quote_that_opens_after_one_within_a_cell(spark, tmp_path, small_splits):
    path = tmp_path / "both.csv"
    path.write_text('id,part\n1,5" pipe\n2,"two\nlines"\n3,6" pipe\n\n4,"a\n\n""b"""\n')
    layout, rows = read_cells(spark, str(path))
    assert layout.multiline
    assert rows == [["1", '5" pipe'], ["2", "two\nlines"], ["3", '6" pipe'], ["4", 'a\n\n"b"']]


def test_line_ends_of_other_systems(spark, tmp_path, small_splits):
    path = tmp_path / "crlf.csv"
    path.write_bytes(b'\xef\xbb\xbfid,part\r\n1,"two\r\nlines"\r\n2,plain\r\n')
    layout, rows = read_cells(spark, str(path))
    assert layout.names == ["id", "part"]
    assert rows == [["1", "two\nlines"], ["2", "plain"]]


def test_header_over_splits_and_cell_that_never_closes(spark, tmp_path, small_splits):
    name = "a " * 100 + "\n" + "b " * 100
    path = tmp_path / "head.csv"
    path.write_text(f'id,"{name}"\n1,x\n2,"open\n3,y\n')
    layout, rows = read_cells(spark, str(path))
    assert layout.names == ["id", name]
    assert rows[0] == ["1", "x"] and rows[1][0] == "2" and "3,y" in rows[1][1]
    assert len(rows) == 2


def test_many_files_one_held_folder_removed_after_use(spark, tmp_path, small_splits):
    expected = {}
    for k in range(4):
        content, cells = table(20 + k, 15 + k)
        (tmp_path / f"f{k}.csv").write_text(content)
        expected[f"f{k}.csv"] = len(cells)
    layouts, _ = find_layouts(spark, [str(tmp_path)])
    assert len(layouts) == 1 and len({x.held for x in layouts}) == 1
    counts = read_layout(spark, layouts[0]).groupBy(FILE).count().collect()
    assert {os.path.basename(r[FILE]): r["count"] for r in counts} == expected
    options = CleanOptions(drop_empty_rows=False)
    audit = clean_files(spark, [str(tmp_path)], options, str(tmp_path / "out")).collect()
    assert {os.path.basename(r.input_path): r.rows_in - 1 for r in audit} == expected
    # what was written is read again in the same way
    again = clean_files(spark, [str(tmp_path / "out")], options, str(tmp_path / "out2")).collect()
    assert sorted(r.rows_out for r in again) == sorted(expected.values())


def test_states_joined_where_splits_are_too_many_to_send(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(records, "SPLITS_MOST", 0)
    content, cells = table(11, 60)
    path = tmp_path / "cells.csv"
    path.write_text(content)
    _, rows = read_cells(spark, str(path))
    assert rows == cells
