"""Golden tests: small files with one feature each, read, cleaned and written."""

import csv
import glob
import os
import shutil

import pytest

from scrubline import CleanOptions
from scrubline.plans.files import clean_files
from scrubline.sources.delimited import find_layouts, resolve_inputs
from scrubline.sources.sinks import manifest_of, store_of, target_of

NBSP = " "
FILES = {
    "headers.csv": " ID , First Name,first  name,First-Name,first&name\n1,Ali,Ali,Ali,Ali\n"
    "2,Sara,Sara,Sara,Sara\n",
    "trim.csv": f"name,note\nAli\t,  has\tnon{NBSP} breaking space  \n  Sara,\t tab before\n"
    "Reza,  \n",
    "empty_rows.csv": "id,val\n1,a\n,\n2,b\n,\n",
    "uneven.csv": "id,a,b\n1,x\n2,y,z,extra\n3,\n",
    "empty_columns.csv": "id,data,empty_col\n1,x,\n2,y,\n3,z,\n",
    "dup_rows.csv": "id,name,note\n1,Ali,same\n1,Ali,same\n2,Sara,diff\n",
    "dup_keys.csv": "id,name,note\n1,Ali,r1\n1,Ali,r2\n2,Sara,x\n",
    "types.csv": 'num,bool,percent\n"1,200",yes,25%\n"(1,200)",FALSE,0.25\n3e2,t,50%\n 42 ,no,\n',
    "dates.csv": "id,date\n1,2024-03-01\n2,03/02/2024\n3,2024/03/03\n4,03-04-2024\n"
    "5,2024-03-05 12:00:00\n6,2024-03-06T08:15:00\n",
    "missing.csv": "id,num,text\n1,,na\n2,10,hello\n3,20,?\n4,,NULL\n5,30,\n",
    "tab.tsv": "sku\tname\tqty\tprice\nA-1\tWidget small\t10\t12.50\nA-2\tWidget medium\t\t15.00\n",
    "pipe.psv": "sku|name|qty|price\nB-1|Gadget|5|9.99\nB-2|Thing|2|19.99\n",
}


def run(spark, folder, name, content=None, **options):
    """Clean one file and read the result back as header, rows and audit record."""
    path = os.path.join(folder, name)
    data = FILES[name] if content is None else content
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    out = os.path.join(folder, "out")
    audit = clean_files(spark, [path], CleanOptions(**options), out).first()
    stem, ext = os.path.splitext(name)
    header, rows = None, []
    for part in sorted(glob.glob(f"{out}/{stem}_cleaned{ext}/part-*")):
        with open(part, newline="", encoding="utf-8") as f:
            lines = list(csv.reader(f, delimiter=audit["delimiter"]))
        if lines:
            header = lines[0]
            rows += lines[1:]
    return header, rows, audit


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_headers(spark, folder):
    header, rows, audit = run(spark, folder, "headers.csv")
    assert header == ["id", "first_name", "first_name_2", "first_name_3", "first_name_4"]
    assert rows == [["1"] + ["Ali"] * 4, ["2"] + ["Sara"] * 4]
    assert (audit["rows_in"], audit["rows_out"]) == (3, 2)
    assert audit["header_in"][0] == " ID "


def test_trim(spark, folder):
    _, rows, _ = run(spark, folder, "trim.csv")
    assert rows == [["Ali", "has non breaking space"], ["Sara", "tab before"], ["Reza", ""]]


def test_no_trim_leaves_cells_alone(spark, folder):
    _, rows, _ = run(spark, folder, "trim.csv", trim=False)
    assert rows[1] == ["  Sara", "\t tab before"]
    assert rows[2] == ["Reza", ""]


def test_empty_rows(spark, folder):
    _, rows, audit = run(spark, folder, "empty_rows.csv")
    assert rows == [["1", "a"], ["2", "b"]]
    assert (audit["rows_in"], audit["rows_out"], audit["empty_rows_dropped"]) == (5, 2, 2)


def test_fill_comes_before_the_empty_row_test(spark, folder):
    _, rows, _ = run(
        spark, folder, "empty_rows.csv", fill_missing="constant", fill_constant="X"
    )
    assert rows == [["1", "a"], ["X", "X"], ["2", "b"], ["X", "X"]]


def test_uneven_rows(spark, folder):
    header, rows, _ = run(spark, folder, "uneven.csv")
    assert header == ["id", "a", "b", "extra_1"]
    assert rows == [["1", "x", "", ""], ["2", "y", "z", "extra"], ["3", "", "", ""]]


def test_uneven_rows_truncated(spark, folder):
    header, rows, _ = run(spark, folder, "uneven.csv", pad_rows="truncate")
    assert header == ["id", "a", "b"]
    assert rows == [["1", "x", ""], ["2", "y", "z"], ["3", "", ""]]


def test_uneven_rows_refused(spark, folder):
    with pytest.raises(ValueError, match="uneven"):
        run(spark, folder, "uneven.csv", pad_rows="error")


def test_empty_columns(spark, folder):
    header, rows, _ = run(spark, folder, "empty_columns.csv", remove_empty_columns=True)
    assert header == ["id", "data"]
    assert rows == [["1", "x"], ["2", "y"], ["3", "z"]]


def test_whole_row_duplicates(spark, folder):
    _, rows, audit = run(spark, folder, "dup_rows.csv", drop_duplicates=True)
    assert rows == [["1", "Ali", "same"], ["2", "Sara", "diff"]]
    assert audit["duplicate_rows_dropped"] == 1


def test_key_duplicates(spark, folder):
    _, rows, audit = run(
        spark, folder, "dup_keys.csv", drop_duplicates=True, dedup_keys=("id", "Name ")
    )
    assert rows == [["1", "Ali", "r1"], ["2", "Sara", "x"]]
    assert audit["duplicate_rows_dropped"] == 1


def test_unknown_key_is_an_error(spark, folder):
    with pytest.raises(ValueError, match="nope"):
        run(spark, folder, "dup_keys.csv", drop_duplicates=True, dedup_keys=("nope",))


def test_types(spark, folder):
    _, rows, audit = run(spark, folder, "types.csv", infer_types=True)
    assert rows == [
        ["1200", "true", "25.0"],
        ["-1200", "false", "0.25"],
        ["300", "true", "50.0"],
        ["42", "false", ""],
    ]
    assert audit["column_types"] == {"num": "integer", "bool": "boolean", "percent": "float"}


def test_dates(spark, folder):
    _, rows, audit = run(spark, folder, "dates.csv", parse_dates=True)
    assert [r[1] for r in rows] == [
        "2024-03-01", "2024-02-03", "2024-03-03", "2024-04-03", "2024-03-05", "2024-03-06",
    ]
    assert audit["column_types"] == {"id": "string", "date": "date"}


@pytest.mark.parametrize(
    "options, num, text",
    [
        ({"infer_types": True}, "", ""),
        ({"infer_types": True, "fill_missing": "mean"}, "20", ""),
        ({"infer_types": True, "fill_missing": "median"}, "20", ""),
        ({"infer_types": True, "fill_missing": "zero"}, "0", ""),
        ({"fill_missing": "mode"}, "10", "hello"),
        ({"fill_missing": "constant", "fill_constant": "X"}, "X", "X"),
        ({"fill_missing": "mean"}, "", ""),
        ({"fill_missing": "empty"}, "", ""),
    ],
)
def test_missing(spark, folder, options, num, text):
    _, rows, _ = run(spark, folder, "missing.csv", **options)
    assert rows == [
        ["1", num, text], ["2", "10", "hello"], ["3", "20", text], ["4", num, text],
        ["5", "30", text],
    ]


def test_tab(spark, folder):
    _, rows, audit = run(spark, folder, "tab.tsv", infer_types=True)
    assert audit["delimiter"] == "\t"
    assert rows == [["A-1", "Widget small", "10", "12.5"], ["A-2", "Widget medium", "", "15.0"]]


def test_pipe(spark, folder):
    _, rows, audit = run(spark, folder, "pipe.psv", infer_types=True)
    assert audit["delimiter"] == "|"
    assert audit["column_types"] == {
        "sku": "string", "name": "string", "qty": "integer", "price": "float",
    }
    assert rows[1] == ["B-2", "Thing", "2", "19.99"]


def test_quotes_and_newlines(spark, folder):
    content = 'id,note\n1,"a ""b"", c"\n2,"two\nlines"\n3,plain\n'
    _, rows, audit = run(spark, folder, "quoted.csv", content)
    assert rows == [["1", 'a "b", c'], ["2", "two lines"], ["3", "plain"]]
    assert audit["rows_in"] == 4


def test_newline_in_header_and_width(spark, folder):
    content = '"first\nname",b\n1,"x\ny",z\n'
    header, rows, _ = run(spark, folder, "h.csv", content)
    assert header == ["first_name", "b", "extra_1"]
    assert rows == [["1", "x y", "z"]]


@pytest.mark.parametrize(
    "data, encoding, cell",
    [
        ("k,v\n1,né €\n".encode("cp1252"), "cp1252", "né €"),
        (b"k,v\n1,n\xe9 \x81x\n", "latin-1", "né \x81x"),
        ("k,v\n1,né €\n".encode("utf-8-sig"), "utf-8", "né €"),
    ],
)
def test_encodings(spark, folder, data, encoding, cell):
    header, rows, audit = run(spark, folder, "enc.csv", data)
    assert audit["encoding_read"] == encoding
    assert header == ["k", "v"]
    assert rows == [["1", cell]]


def test_blank_first_line_gives_default_names(spark, folder):
    header, rows, audit = run(spark, folder, "blank.csv", "\n1,a\n\n2,b\n")
    assert header == ["column_1", "column_2"]
    assert rows == [["1", "a"], ["2", "b"]]
    assert (audit["rows_in"], audit["rows_out"], audit["empty_rows_dropped"]) == (4, 2, 1)


def test_many_files_at_once(spark, folder):
    for name in ("empty_rows.csv", "dup_rows.csv", "dup_keys.csv", "pipe.psv"):
        with open(os.path.join(folder, name), "w") as f:
            f.write(FILES[name])
    with open(os.path.join(folder, "with space.csv"), "w") as f:
        f.write("id,name,note\n7,yes,\n8,no,\n")
    options = CleanOptions(infer_types=True, drop_duplicates=True, remove_empty_columns=True)
    audit = clean_files(spark, [folder], options, os.path.join(folder, "out"))
    rows = {os.path.basename(r["input_path"]): r for r in audit.collect()}
    assert sorted(rows) == ["dup_keys.csv", "dup_rows.csv", "empty_rows.csv", "with space.csv"]
    assert rows["with space.csv"]["header_out"] == ["id", "name"]
    assert rows["with space.csv"]["column_types"] == {"id": "integer", "name": "boolean"}
    assert rows["dup_keys.csv"]["column_types"]["name"] == "string"
    for r in rows.values():
        assert r["rows_in"] - 1 == (
            r["rows_out"] + r["empty_rows_dropped"] + r["duplicate_rows_dropped"]
        )
    made = glob.glob(os.path.join(folder, "out", "with space_cleaned.csv", "part-*"))
    assert made


def test_in_place(spark, folder):
    path = os.path.join(folder, "dup_rows.csv")
    with open(path, "w") as f:
        f.write(FILES["dup_rows.csv"])
    clean_files(spark, [path], CleanOptions(drop_duplicates=True), inplace=True)
    back = spark.read.option("header", True).csv(path).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", "Ali", "same"), ("2", "Sara", "diff")]


def test_ragged_files_keep_their_delimiter(spark, folder):
    path = os.path.join(folder, "ragged.tsv")
    with open(path, "w") as f:
        f.write("a\tb\n1\n2\n3\n4\tx\n5\n")
    audit = clean_files(spark, [path], CleanOptions()).first()
    assert audit["delimiter"] == "\t" and audit["header_out"] == ["a", "b"]


@pytest.mark.parametrize("by_folder", [False, True])
def test_in_place_again_and_again(spark, folder, by_folder):
    """An output is an input like a file: three runs leave one dataset, in order, and one audit."""
    here = os.path.join(folder, "again")
    os.makedirs(here)
    path = os.path.join(here, "a.csv")
    lines = [f"{i},{'x' * (i % 7)},\"q{i}, z\"" for i in range(300)]
    with open(path, "w") as f:
        f.write("id,b,c\n" + "\n".join(lines) + "\n")
    options = CleanOptions(infer_types=True)
    audits, parts = [], []
    for _ in range(3):
        audit = clean_files(spark, [here if by_folder else path], options, inplace=True).collect()
        audits.append([tuple(r) for r in audit])
        parts.append(sorted(os.listdir(path)))
    assert audits[0] == audits[1] == audits[2] and len(audits[0]) == 1
    assert os.listdir(here) == ["a.csv"] and parts[0] != parts[1]
    manifest = manifest_of(spark, path)
    assert manifest["generation"] == 3 and manifest["parts"] == [p for p in parts[2] if p.startswith("part-")]
    back = spark.read.option("header", True).csv(path)
    assert sorted(int(r.id) for r in back.collect()) == list(range(300))
    assert [p for p in resolve_inputs(spark, [here])] == [p for p in resolve_inputs(spark, [path])]


def test_a_swap_that_breaks_off_leaves_the_old_output(spark, folder, monkeypatch):
    here = os.path.join(folder, "broken")
    os.makedirs(here)
    path = os.path.join(here, "a.csv")
    with open(path, "w") as f:
        f.write("id\n1\n2\n")
    clean_files(spark, [path], inplace=True)
    # as after the first of the two renames
    os.rename(path, os.path.join(here, "_previous-a.csv"))
    found = resolve_inputs(spark, [path])
    assert [p.rstrip("/").rsplit("/", 1)[-1] for p in found] == ["a.csv"]
    assert spark.read.option("header", True).csv(path).count() == 2
    os.rename(path, os.path.join(here, "_previous-a.csv"))
    assert resolve_inputs(spark, [here]) == found
    # as before the last step: the old one lies beside the new one
    shutil.copytree(path, os.path.join(here, "_previous-a.csv"))
    assert resolve_inputs(spark, [here]) == found
    clean_files(spark, [path], inplace=True)
    assert os.listdir(here) == ["a.csv"] and manifest_of(spark, path)["generation"] == 2


def test_parts_of_a_dataset_keep_their_order(spark, folder):
    """Keep-first follows the parts, whichever task reads them."""
    path = os.path.join(folder, "parts.csv")
    os.makedirs(path)
    for k in range(12):
        with open(os.path.join(path, f"part-{k:05d}-x.csv"), "w") as f:
            f.write("id,v\n" + "".join(f"{i},{k}\n" for i in range(5)))
    with open(os.path.join(path, "_manifest.json"), "w") as f:
        f.write('{"generation": 4}')
    out = os.path.join(folder, "kept")
    audit = clean_files(spark, [path], CleanOptions(drop_duplicates=True, dedup_keys=("id",)), out).first()
    assert (audit["rows_in"], audit["rows_out"]) == (61, 5)
    back = spark.read.option("header", True).csv(os.path.join(out, "parts_cleaned.csv"))
    assert {r.v for r in back.collect()} == {"0"}


@pytest.mark.parametrize(
    "source, folder, expected",
    [
        ("file:/d/a.csv", None, "file:/d/a_c.csv"), ("hdfs://h:1/d/a.b.tsv", "s3://o/p/", "s3://o/p/a.b_c.tsv"),
        ("/d/noext", None, "/d/noext_c.csv"), ("/d/.hidden", "/o", "/o/.hidden_c.csv"),
    ],
)
def test_target_names(source, folder, expected):
    assert target_of(source, folder, "_c", False) == expected and target_of(source, folder, "_c", True) == source


def test_stores():
    assert store_of("hdfs://h:1/d") == "hdfs://h:1" and store_of("file:/d") == "file:" and store_of("/d/e") == ""


def test_input_resolution(spark, folder):
    os.makedirs(os.path.join(folder, "sub.csv"))
    for name in ("b.csv", "a.csv", "c.tsv"):
        with open(os.path.join(folder, name), "w") as f:
            f.write("x\n1\n")
    found = resolve_inputs(
        spark, [os.path.join(folder, "b.csv"), folder, os.path.join(folder, "missing.csv"),
                os.path.join(folder, "*.tsv")]
    )
    assert [os.path.basename(p) for p in found] == ["b.csv", "a.csv", "c.tsv"]


def test_forced_delimiter_alias(spark, folder):
    path = os.path.join(folder, "x.txt")
    with open(path, "w") as f:
        f.write("a,b\tc\n1,2\t3\n")
    layouts, _ = find_layouts(spark, [path], "tab")
    assert layouts[0].header == ("a,b", "c")


def test_files_without_rows(spark, folder):
    for name, text in (("nothing.csv", ""), ("head.csv", "A,b c\n"), ("some.csv", "A,b c\n1,2\n")):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    audit = clean_files(spark, [folder], CleanOptions(infer_types=True), os.path.join(folder, "out"))
    rows = {os.path.basename(r["input_path"]): r for r in audit.collect()}
    counts = {k: (r["rows_in"], r["rows_out"], r["header_out"]) for k, r in rows.items()}
    assert counts == {
        "nothing.csv": (0, 0, ["column_1"]), "head.csv": (1, 0, ["a", "b_c"]),
        "some.csv": (2, 1, ["a", "b_c"]),
    }
    part = glob.glob(os.path.join(folder, "out", "head_cleaned.csv", "part-*"))
    assert open(part[0]).read().strip() == "a,b_c"


BLANKS = "a,b\n1,2\n\n3,4\n"


def test_blank_lines_are_rows_where_something_fills_them(spark, folder):
    header, rows, audit = run(
        spark, folder, "blank.csv", BLANKS, fill_missing="constant", fill_constant="X", infer_types=True
    )
    assert header == ["a", "b"] and sorted(rows) == [["1", "2"], ["3", "4"], ["X", "X"]]
    assert (audit["rows_in"], audit["rows_out"], audit["empty_rows_dropped"]) == (4, 3, 0)


def test_blank_lines_stay_if_empty_rows_do(spark, folder):
    header, rows, audit = run(spark, folder, "blank.csv", BLANKS, drop_empty_rows=False)
    assert len(rows) == 3 and (audit["rows_in"], audit["rows_out"]) == (4, 3)
    assert audit["empty_rows_dropped"] == 0


def test_rows_of_delimiters_alone_are_counted(spark, folder):
    _, rows, audit = run(spark, folder, "tabs.tsv", "a\tb\tc\n1\t2\t3\n\t\t\n   \n4\t5\t6\n")
    assert rows == [["1", "2", "3"], ["4", "5", "6"]]
    assert (audit["rows_in"], audit["empty_rows_dropped"]) == (5, 2)


def test_blank_line_inside_a_quoted_cell_is_no_record(spark, folder):
    _, rows, audit = run(spark, folder, "quoted.csv", 'a,b\n1,"x\n\ny"\n2,z\n')
    assert len(rows) == 2 and (audit["rows_in"], audit["empty_rows_dropped"]) == (3, 0)


def test_names_with_pattern_characters(spark, folder):
    for name in ("b[1].csv", "c{x}.csv", "d*.csv", "b1.csv"):
        with open(os.path.join(folder, name), "w") as f:
            f.write(f"a,b\n{name},2\n")
    audit = clean_files(spark, [folder], CleanOptions(), os.path.join(folder, "out")).collect()
    assert sorted(r.rows_out for r in audit) == [1, 1, 1, 1]
    assert len({r.input_path for r in audit}) == 4


def test_names_that_spark_hides_are_an_error(spark, folder):
    with open(os.path.join(folder, "_u.csv"), "w") as f:
        f.write("a\n1\n")
    with pytest.raises(ValueError, match="_u.csv"):
        clean_files(spark, [folder], CleanOptions(), os.path.join(folder, "out"))


def test_ragged_files_of_one_header_are_one_layout(spark, folder):
    bodies = ["1\n", "1,2\n", "1,2,3,4\n5\n", "1,2,3\n"]
    for k, body in enumerate(bodies):
        with open(os.path.join(folder, f"f{k}.csv"), "w") as f:
            f.write("a,b\n" + body)
    layouts, _ = find_layouts(spark, [folder])
    assert len(layouts) == 1 and layouts[0].width == 4
    audit = clean_files(spark, [folder], CleanOptions(), os.path.join(folder, "out"))
    headers = {os.path.basename(r.input_path): list(r.header_out) for r in audit.collect()}
    assert headers == {
        "f0.csv": ["a", "b"], "f1.csv": ["a", "b"],
        "f2.csv": ["a", "b", "extra_1", "extra_2"], "f3.csv": ["a", "b", "extra_1"],
    }
    with pytest.raises(ValueError, match="f0.csv|f2.csv"):
        clean_files(spark, [folder], CleanOptions(pad_rows="error"), os.path.join(folder, "out"))
