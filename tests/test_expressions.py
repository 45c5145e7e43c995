"""Edge strings per expression."""

import html
import random
import time

import pytest
from pyspark.sql import functions as F

from scrubline.functions.names import snake_name, unique_names, widen_names
from scrubline.functions.parsing import (
    integer_text,
    numeric_value,
    parse_boolean,
    parse_timestamp,
)
from scrubline.functions.render import float_text, format_timestamp
from scrubline.functions.text import clean_text, normalize_whitespace


def apply(spark, values, fn, kind="string"):
    """Results of an expression over distinct values, in the order given."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, c {kind}")
    out = df.select("i", fn(F.col("c")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in out]


def test_whitespace(spark):
    cases = {
        "  a  b ": "a b", "a \tb": "a b", "　a b\u0085": "a b", "a\x1cb\x1f": "a b",
        "a b": "a b", "x\n\ny": "x y", "": "", "   ": "", "​a": "​a",
    }
    assert apply(spark, list(cases), normalize_whitespace) == list(cases.values())


def test_missing(spark):
    gone = [" NA ", "n/a", "NULL", "None", "#N/A", "-", "?", "NaN", "", None, " ", "Nil", "tbd"]
    out = apply(spark, gone, lambda c: clean_text(c, True, ("nil", " TBD ")))
    assert out == [None] * len(gone)
    kept = ["0", "--", "nil", "n a"]
    assert apply(spark, kept, clean_text) == kept
    assert apply(spark, [" NA ", " x "], lambda c: clean_text(c, False)) == [None, " x "]


def test_numeric(spark):
    cases = {
        "1,200": 1200.0, "(1,200)": -1200.0, "25%": 25.0, "(5%)": -5.0, "3e2": 300.0, "1.0": 1.0,
        ".5": 0.5, "5.": 5.0, "+5": 5.0, "1 200": 1200.0, "-0": 0.0, "1_000": 1000.0, "5,": 5.0,
        "%": None, "()": None, "(-5)": None, "0x10": None, "1d": None, "inf": None, "nan": None,
        "1e400": None, "$5": None, "": None, "-": None, "_5": None, "5__0": None, "(5) %": None,
        ",(5)": None, "1.2.3": None, "e5": None, "5%%": None,
    }
    assert apply(spark, list(cases), numeric_value) == list(cases.values())


def test_whole_numbers(spark):
    big = "123456789012345678901234567890123456789012345"
    cases = {
        "007": "7", "-0": "0", "+12": "12", "3e2": "300", "1.0": "1", "(1,200)": "-1200",
        "1e20": "1" + "0" * 20, big: big, "-00" + big: "-" + big, "1.5": None, "x": None,
        "1e60": None,
    }
    assert apply(spark, list(cases), integer_text) == list(cases.values())


def test_float_text(spark):
    values = [25.0, 0.25, 1e7, 12345678.5, 123456789012345.6, 1e16, 1.5e17, 0.00012, 1e-5, 1.5e-7,
              0.001, -2e22, 0.0, 1e100, 9999999.0, -12345678.25]
    assert apply(spark, values, float_text, "double") == [repr(v) for v in values]


def test_boolean(spark):
    cases = {"T": True, "yes": True, "1": True, "Y": True, "N": False, "0": False, "FALSE": False,
             "on": None, "": None, "2": None}
    assert apply(spark, list(cases), parse_boolean) == list(cases.values())


def test_dates(spark):
    cases = {
        "03/02/2024": "2024-02-03 00:00:00", "13/02/2024": "2024-02-13 00:00:00",
        "02/13/2024": "2024-02-13 00:00:00", "03/02/2024 10:00:00": "2024-03-02 10:00:00",
        "13/02/2024 10:00:00": "2024-02-13 10:00:00", "2024-3-1": "2024-03-01 00:00:00",
        "2024-03-01T23:00:00-05:00": "2024-03-01 23:00:00", "2024.03.01": "2024-03-01 00:00:00",
        "20240301": "2024-03-01 00:00:00", "2024-03-01T08:15": "2024-03-01 08:15:00",
        "2024/3/1 1:2:3": "2024-03-01 01:02:03", "03-04-2024": "2024-04-03 00:00:00",
        "2024-03-01T10:20Z": "2024-03-01 10:20:00", "1/2/2024": "2024-02-01 00:00:00",
        "05 Mar 2024": None, "2024": None, "2024-02-30": None, "31/02/2024": None, "x": None,
        "2024-03-01 10:00:60": None, "03-02-2024 10:00:00": None, "0000-01-01": None,
        "12345678.5": None, "99999999": None, "2024-03-01T25:00": None, "24-03-2024x": None,
    }
    out = apply(
        spark, list(cases), lambda c: format_timestamp(parse_timestamp(c), "%Y-%m-%d %H:%M:%S")
    )
    assert out == list(cases.values())


def test_date_patterns(spark):
    text = ["2024-03-06T20:15:09.000123"]
    pattern = "%d.%m.%y|%I:%M:%S %p|%f|%b %B|%a %A|%j|%%|it's"
    want = "06.03.24|08:15:09 PM|000123|Mar March|Wed Wednesday|066|%|it's"
    assert apply(spark, text, lambda c: format_timestamp(parse_timestamp(c), pattern)) == [want]
    with pytest.raises(ValueError, match="%U"):
        format_timestamp(F.lit(None), "%U")


def test_names():
    assert snake_name("First&Name") == "first_name"
    assert snake_name("__a__") == "a"
    assert snake_name("%%") == "column"
    assert snake_name("Größe 李") == "größe_李"
    assert unique_names(["a", "a", "a"]) == ["a", "a_2", "a_3"]
    assert unique_names(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert widen_names(["id", "extra_1"], 4) == ["id", "extra_1", "extra_2", "extra_3"]


def test_names_in_rows_follow_the_list_rule(spark):
    from scrubline.functions.names import name_rows

    headers = [["a", "a", "a_2"], ["a", "A ", "a", "a_3", "b"], ["", "", "x"], ["a_2", "a", "a"]]
    rows = [(f, p, n) for f, header in enumerate(headers) for p, n in enumerate(header)]
    named = name_rows(spark.createDataFrame(rows, "f int, p int, n string"), "f", "p", "n")
    got = {(r.f, r.p): r.name for r in named.collect()}
    for f, header in enumerate(headers):
        assert [got[f, p] for p in range(len(header))] == unique_names(header)


def test_wide_headers_are_named_at_linear_cost(spark):
    from scrubline.functions.names import name_rows

    rng = random.Random(1)
    some = ["a", "b", "a_2", "a_3", "a_5", "b_2", "a_2_2", "A ", "c", "a_2_3", "b_10", "c_01", "c_1"]
    headers = [[rng.choice(some) for _ in range(rng.randint(1, 40))] for _ in range(60)]
    headers += [["x"] * 3000 + [f"x_{n}" for n in range(2, 9000, 2)], [f"n{i % 4000}" for i in range(20000)]]
    rows = [(f, p, n) for f, header in enumerate(headers) for p, n in enumerate(header)]
    named = name_rows(spark.createDataFrame(rows, "f int, p int, n string"), "f", "p", "n")
    began = time.perf_counter()
    got = {(r.f, r.p): r.name for r in named.collect()}
    assert time.perf_counter() - began < 20
    for f, header in enumerate(headers):
        assert [got[f, p] for p in range(len(header))] == unique_names(header)


def test_names_beside_columns_of_the_same_names(spark):
    from scrubline.functions.names import name_rows

    df = spark.createDataFrame([(1, 0, "a", 5, 6), (1, 1, "a", 7, 8)], "f int, p int, n string, `set` int, `x.y` int")
    named = name_rows(df, "f", "p", "n")
    assert named.columns == ["f", "p", "n", "set", "x.y", "base_name", "name"]
    assert sorted((r["set"], r["x.y"], r["name"]) for r in named.collect()) == [(5, 6, "a"), (7, 8, "a_2")]


def test_links_as_pages_write_them(spark):
    from scrubline.operators.html import decode_references, extract_links

    page = (
        "<a href='/x?a=1&amp;b=2'>Caf&eacute; &#8212; &#x41;&nbsp;b</a> <A class=q HREF=/plain/y>&lt;b&gt; &amp;lt;</a>"
        '<a name="here">no target</a><a href="">empty</a><a href = "it\'s">t&bogus; &amp</a>'
    )
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    rows = sorted((r.link_no, r.href, r.link_text) for r in extract_links(pages).collect())
    assert rows == [
        (0, "/x?a=1&b=2", "Café — A b"), (1, "/plain/y", "<b> &lt;"), (2, "", "empty"), (3, "it's", "t&bogus; &"),
    ]
    texts = ["&#128;&#150;&#129;&#0;&#xD800;&#1114112;", "&notin; &copy &AMP;&Eacute", "a & b &; &#; &#x;", "&amp;amp;", "&fjlig;&#128514;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.d for r in df.select(decode_references(F.col("t")).alias("d")).collect()] == [html.unescape(t).replace("\x81", "\ufffd") for t in texts]


def test_lines_of_any_width_are_parsed_once(spark):
    from pyspark.sql import functions as F

    from scrubline.operators.shape import uneven_rows
    from scrubline.sources.lines import field_count, line_shapes, parse_lines, vote_delimiter, widest

    lines = ["a,b,c", "1,2,3,4,5,6,7", '"x, y",2', " \t", "", "1,2,3"]
    df = spark.createDataFrame([(1, x) for x in lines], "f int, line string")
    shapes = line_shapes(df, ["f"], "line")
    width = widest(shapes, vote_delimiter(shapes, ["f"]), ["f"])
    assert width == 7
    parsed = parse_lines(df, "line", F.lit(","), width)
    cells = {r.line: list(r.fields) for r in parsed.collect()}
    assert cells[lines[1]] == list("1234567") and cells[lines[2]] == ["x, y", "2"] and cells[""] == []
    plan = parsed.filter(F.size("fields") != 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv") <= 4
    bad = uneven_rows(df, field_count(F.col("line"), F.lit(",")), F.lit(3)).collect()
    assert {r.line: r.cells for r in bad} == {lines[1]: 7, lines[2]: 2, "": 0, " \t": 0}


def test_pivot_keeps_values_that_are_not_listed(spark):
    from pyspark.sql import functions as F

    from scrubline.plans.reports import two_way

    df = spark.createDataFrame([(1, "a"), (1, "z"), (1, None), (2, "y")], "k int, v string")
    rows = {tuple(r) for r in two_way(df, "k", "v", ["a", "b"], F.count(F.lit(1))).collect()}
    assert rows == {(1, 1, 0, 2), (2, 0, 0, 1)}


def test_cleaning_is_the_same_for_narrow_and_wide_tables(spark):
    from scrubline.functions.text import INLINE_COLUMNS, with_clean_text

    cells = ["  a  b ", "N/A", None, "", "x\ty", " "]
    for count in (INLINE_COLUMNS, INLINE_COLUMNS + 1):
        names = [f"c{i}" for i in range(count)]
        df = spark.createDataFrame([(x,) * count for x in cells], ", ".join(f"{n} string" for n in names))
        got = [tuple(r) for r in with_clean_text(df, names, True, ("n/a",)).collect()]
        assert got == [(x,) * count for x in ("a b", None, None, None, "x y", None)]


def test_large_inputs_are_not_spread(spark, tmp_path):
    from scrubline import clean

    spark.range(100).selectExpr("id", "string(id) as c").repartition(6).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for spread in (False, True):
        frame = clean(df, order=["id"], spread=spread).frame
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_spanned_cells_and_references(spark):
    from scrubline.operators.html import extract_tables, extract_untidy_tables

    spans = (
        "<table><tr><th rowspan=2>C</th><th colspan='2'>IMF</th></tr><tr><th>est</th><th>yr</th></tr>"
        "<tr><td>C&ocirc;te &#8212; x<td rowspan=x>1<td>2</table><p><table><tr><td>t2</td></tr></table>"
    )
    tidy = "<table><tr><td>a &amp; b</td></tr></table>"
    pages = spark.createDataFrame([(1, spans), (2, tidy), (3, None)], "page_id int, html string")
    for extract in (extract_tables, extract_untidy_tables):
        rows = {(r.page_id, r.table_no, r.row_no): (r.is_header, list(r.cells)) for r in extract(pages).collect()}
        assert rows == {
            (1, 0, 0): (True, ["C", "IMF", "IMF"]), (1, 0, 1): (True, ["C", "est", "yr"]),
            (1, 0, 2): (False, ["Côte — x", "1", "2"]), (1, 1, 0): (False, ["t2"]),
            (2, 0, 0): (False, ["a & b"]),
        }
