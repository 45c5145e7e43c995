"""The cleaning plan on frames: golden fleet data, typed mode, skew paths and properties."""

import math
import random
import statistics
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrubline import AGGRESSIVE, LARGE, SAFE, CleanOptions, clean
from scrubline.operators import defects, html, profile
from scrubline.operators.lookup import lookup_join, salted_sides
from scrubline.operators.spelling import fix_spelling, merge_parts
from scrubline.plans import reports, views
from scrubline.plans.clean import clean_many
from scrubline.sources.sinks import write_small_csv
from scrubline.streaming.profiled import clean_stream
from scrubline.streaming.streams import distinct_stream, run_to_table
from tests.conftest import SF_SMALL

GAPS = [
    ("1", "10", "x", "2024-01-05"), ("2", "", "y", "05/01/2024"), ("3", "30", "n/a", "bad"),
    ("4", "2.5", "x", "2024/01/07"), ("5", "?", "", ""), ("", "", "-", ""),
]


@pytest.fixture
def gaps(spark):
    rows = [(i, *r) for i, r in enumerate(GAPS)]
    return spark.createDataFrame(rows, "n int, ID string, `Amount ` string, tag string, day string")


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_typed_mode_and_rejects(gaps):
    options = CleanOptions(infer_types=True, parse_dates=True, type_threshold=0.7)
    done = clean(gaps, options, ["n"], typed=True)
    kinds = {f.name: f.dataType.simpleString() for f in done.frame.schema}
    assert kinds == {
        "n": "int", "id": "bigint", "amount": "double", "tag": "string", "day": "timestamp_ntz",
    }
    assert done.frame.count() == 5
    assert [tuple(r) for r in done.rejects().collect()] == [(2, "day", "bad", "date")]


def test_text_mode_keeps_what_does_not_conform(gaps):
    options = CleanOptions(infer_types=True, parse_dates=True, type_threshold=0.7)
    out = rows_of(clean(gaps, options, ["n"]).frame, "n")
    assert out[0] == (0, "1", "10.0", "x", "2024-01-05")
    assert out[1] == (1, "2", None, "y", "2024-01-05")
    assert out[2][4] == "bad"


def test_audit_identity(gaps):
    options = CleanOptions(drop_duplicates=True, dedup_keys=("tag",))
    done = clean(gaps, options, ["n"])
    audit = done.audit().first()
    assert audit["rows_in"] == 7 and audit["empty_rows_dropped"] == 1
    assert audit["rows_out"] == done.frame.count() == 3


def test_zero_fill_equals_a_float_zero(spark):
    rows = [(0, "", "a"), (1, "0.0", "a"), (2, "1.5", "a")]
    df = spark.createDataFrame(rows, "n int, v string, w string")
    options = CleanOptions(infer_types=True, fill_missing="zero", drop_duplicates=True)
    assert rows_of(clean(df, options, ["n"]).frame, "n") == [(0, "0", "a"), (2, "1.5", "a")]


def test_mean_of_whole_numbers_may_be_fractional(spark):
    df = spark.createDataFrame([(0, "1"), (1, "2"), (2, "")], "n int, v string")
    options = CleanOptions(infer_types=True, fill_missing="mean", drop_empty_rows=False)
    assert rows_of(clean(df, options, ["n"]).frame, "n")[2] == (2, "1.5")
    typed = clean(df, options, ["n"], typed=True).frame
    assert rows_of(typed, "n") == [(0, 1.0), (1, 2.0), (2, 1.5)]


def test_big_whole_numbers_are_decimals(spark):
    df = spark.createDataFrame([(0, "12345678901234567890123"), (1, "5")], "n int, v string")
    frame = clean(df, CleanOptions(infer_types=True), ["n"], typed=True).frame
    assert dict(frame.dtypes)["v"] == "decimal(38,0)"
    assert str(frame.orderBy("n").first()["v"]) == "12345678901234567890123"


def test_key_duplicates_may_empty_a_column(spark):
    df = spark.createDataFrame([(0, "1", ""), (1, "1", "late")], "n int, id string, extra string")
    options = CleanOptions(
        drop_duplicates=True, dedup_keys=("id",), remove_empty_columns=True
    )
    assert clean(df, options, ["n"]).columns == ["id"]


def test_presets(spark):
    df = spark.createDataFrame([(0, "1", "yes", ""), (1, "1", "no", "")], "n int, a string, b string, c string")
    assert clean(df, SAFE, ["n"]).types == {"a": "integer", "b": "boolean", "c": "string"}
    assert clean(df, LARGE, ["n"]).types == {"a": "string", "b": "string", "c": "string"}
    assert clean(df, AGGRESSIVE, ["n"]).columns == ["a", "b"]
    with_id = df.withColumnRenamed("a", "Id")
    assert clean(with_id, AGGRESSIVE, ["n"]).frame.count() == 1


def test_many_datasets_equal_each_alone(spark):
    dirty = views.dirty_lineitem(spark, SF_SMALL).withColumn("place", views.lineitem_place())
    tagged = dirty.drop(*views.LINEITEM_KEY).withColumn(
        "part", F.pmod(F.col("place"), F.lit(3)).cast("int")
    )
    for fill in ("mean", "median", "mode", "zero"):
        options = CleanOptions(infer_types=True, fill_missing=fill, drop_duplicates=True)
        many = clean_many(tagged, "part", options, ["place"])
        one = clean(tagged.filter("part = 1").drop("part"), options, ["place"])
        mine = many.frame.filter("part = 1").drop("part").select(*one.frame.columns)
        # the order of addition may move a mean's last digit
        places = {c: F.round(F.col(c).cast("double"), 6) for c in ("qty_raw", "price_raw")}
        assert rows_of(mine.withColumns(places), "place") == rows_of(
            one.frame.withColumns(places), "place"
        )


def test_cleaning_twice_changes_nothing(spark):
    dirty = views.dirty_customer(spark, SF_SMALL)
    options = CleanOptions(infer_types=True)
    once = clean(dirty, options, ["c_custkey"]).frame
    twice = clean(once, options, ["c_custkey"]).frame
    assert rows_of(once, "c_custkey") == rows_of(twice, "c_custkey")


def test_partition_count_does_not_matter(spark):
    dirty = views.dirty_customer(spark, SF_SMALL)
    options = CleanOptions(fill_missing="mode", drop_duplicates=True, dedup_keys=("segment_raw",))
    results = []
    for n in (1, 7):
        spread = dirty.repartition(n, "active_raw")
        results.append(rows_of(clean(spread, options, ["c_custkey"]).frame, "c_custkey"))
    assert results[0] == results[1]


def test_median_against_brute_force(spark):
    rng = random.Random(5)
    groups = {
        "hot": [float(rng.choice([1, 1, 1, 2, 50])) for _ in range(3001)],
        "wide": [rng.uniform(-1e6, 1e6) for _ in range(2500)],
        "one": [4.5],
        "two": [1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {k: statistics.median(vs) for k, vs in groups.items()}
    out = profile.exact_medians(df, ["k"], "v")
    assert {r["k"]: r["median"] for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_bits_have_the_order_of_the_numbers(spark):
    from scrubline.operators.selection import ordered_bits

    rng = random.Random(4)
    tiny, huge = 5e-324, 1.7976931348623157e308
    numbers = [0.0, -0.0, tiny, 2 * tiny, 2.2250738585072014e-308, 2.225073858507201e-308, huge, float("inf"), 1.0, 0.1, 3.0]
    for _ in range(2000):
        bits = rng.getrandbits(63)
        number = struct.unpack("<d", struct.pack("<Q", bits))[0]
        if number == number:
            numbers.append(number)
    for power in range(-1074, 1024):
        numbers += [math.ldexp(1.0, power), math.nextafter(math.ldexp(1.0, power), 0.0)]
    numbers += [-x for x in numbers]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = [r.b for r in df.select("x", ordered_bits(F.col("x")).alias("b")).collect()]
    for number, bits in zip(numbers, got):
        want = struct.unpack("<q", struct.pack("<d", abs(number)))[0]
        assert bits == (-want if number < 0 else want)


def test_values_of_any_rank(spark):
    from scrubline.operators.selection import values_of_rank

    rng = random.Random(9)
    values = [rng.choice([0.0, -1.5, 1e300, 7.25, float("inf"), float("-inf"), rng.uniform(-1, 1)]) for _ in range(800)]
    rows = [("a", x) for x in values] + [("a", None), ("a", float("nan")), ("b", 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    at = [1, 2, 399, 400, 799, 800]
    out = values_of_rank(df, ["k"], "v", lambda n: F.when(n > 1, F.array(*map(F.lit, at))).otherwise(F.array(F.lit(1))))
    got = {(r.k, r.which): r.value for r in out.collect()}
    assert got == {("b", 0): 3.0} | {("a", i): sorted(values)[r - 1] for i, r in enumerate(at)}


def test_ranks_are_found_in_what_the_first_round_left(spark, monkeypatch):
    from scrubline.operators import selection

    written = {}

    def spy(df, name):
        written[name] = write_table(df, name)
        written[name + " plan"] = df._jdf.queryExecution().optimizedPlan().toString()
        return written[name]

    write_table = selection.write_table
    monkeypatch.setattr(selection, "write_table", spy)
    rng = random.Random(3)
    values = {k: [rng.uniform(0, 1000) for _ in range(1500)] for k in ("a", "b")} | {"c": [2.5] * 400}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [(None, 1.0), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    out = profile.exact_medians(df, ["k"], "v")
    assert {r["k"]: r["median"] for r in out.collect()} == {k: statistics.median(v) for k, v in values.items()}
    # a logarithm a row, or the stage's loop outgrows what the JVM compiles
    assert written["ranked plan"].count("LOG2") == 1
    assert written["ranked"].count() == len(rows)
    left = written["near"].groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in left}["c"] == 400
    assert all(r["count"] < 500 for r in left) and len(left) == 3


def test_mode_takes_the_first_seen_on_a_tie(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 0, "z"), ("a", 5, "y"), ("b", 9, "q")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    out = profile.first_modes(df, ["k"], "v", ["o"])
    assert {r["k"]: r["mode"] for r in out.collect()} == {"a": "y", "b": "q"}


def test_lookup_join_is_the_same_beyond_the_broadcast_limit(spark):
    big = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    near = lookup_join(big, small, ["k"], F.col("id"))
    far = lookup_join(big, small, ["k"], F.col("id"), limit_bytes=0)
    assert "_salt" in far._jdf.queryExecution().optimizedPlan().toString()
    cols = ["id", "k", "w"]
    assert rows_of(near.select(*cols), "id") == rows_of(far.select(*cols), "id")


def test_a_key_of_a_third_of_all_rows_is_divided_by_its_share(spark):
    hot = F.col("id") % 3 == 0
    big = spark.range(60_000).select(F.when(hot, -1).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(-1, 20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    divided, repeated = salted_sides(big, small, ["k"], F.col("id"))
    rows = divided.groupBy("k", "_salt").count()
    assert rows.agg(F.max("count")).first()[0] < 60  # of 20,000; an average class has 15
    assert repeated.filter("k = -1").count() > 1000
    assert 20_001 < repeated.count() < 2.5 * 20_001
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        done = lookup_join(big, small, ["k"], F.col("id"), limit_bytes=0)
        tasks = done.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert tasks < 2 * 60_000 / 16
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    wrong = done.filter(~F.col("w").eqNullSafe(F.when(F.col("k") < 20_000, F.col("k") * 2)))
    assert (done.count(), wrong.count()) == (60_000, 0)


def test_keys_of_two_types_and_without_value_beyond_the_limit(spark):
    big = spark.createDataFrame([(1, 1.0), (2, -0.0), (None, 0.0)], "a int, b double")
    small = spark.createDataFrame([(1, 1.0, "x"), (2, 0.0, "y")], "a bigint, b double, w string")
    done = lookup_join(big, small, ["a", "b"], F.lit(0), limit_bytes=0)
    assert [r["w"] for r in done.orderBy("a").collect()] == [None, "x", "y"]
    none = lookup_join(big.limit(0), small, ["a"], F.lit(0), limit_bytes=0)
    assert none.count() == 0
    texts = big.select(F.col("a").cast("bigint").alias("a"))
    done = lookup_join(texts, small.select("a", "w"), ["a"], F.lit(0), limit_bytes=0)
    assert [r["w"] for r in done.orderBy("a").collect()] == [None, "x", "y"]


def test_key_candidates(spark):
    rows = [(str(i), str(i % 5), "same", str(i % 96)) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, few string, one string, most string")
    for approximate in (False, True):
        found = profile.key_candidates(df, approximate=approximate).collect()
        assert [r["column_name"] for r in found] == ["id", "most"]


def test_key_candidates_count_only_what_sketches_leave(spark, monkeypatch):
    some = [(F.col("id") % (40 * (i + 1))).alias(f"some_{i}") for i in range(46)]
    near = (F.when(F.col("id") < 2990, F.col("id")).otherwise(0)).alias("near")
    edge = (F.col("id") % 2710).alias("edge.1")  # 0.9033
    below = (F.col("id") % 2700).alias("below")  # 0.9
    df = spark.range(3000).select(*some, below, edge, near, "id")
    asked = {n: profile.possible_keys(df, df.columns, 0.9, n) for n in (1, 3)}
    assert asked[3] == ["below", "edge.1", "near", "id"]
    counted, as_text = [], profile._as_text
    monkeypatch.setattr(profile, "_as_text", lambda d, c: counted.append(c) or as_text(d, c))
    found = profile.key_candidates(df)
    assert [(r["column_name"], r["distinct_values"]) for r in found.collect()] == [
        ("id", 3000), ("near", 2990), ("edge.1", 2710)
    ]
    # only those are unpivoted for the exact count
    assert counted == [df.columns, asked[3]]
    assert profile.key_candidates(df, [f"some_{i}" for i in range(3)]).collect() == []
    assert profile.key_candidates(df.limit(0)).collect() == []
    assert [r["column_name"] for r in profile.key_candidates(df, ["below", "edge.1"], top=1).collect()] == ["edge.1"]


FLEET_PARTS = [
    ("Board of", "Elections", "Van", "1"), ("", "", "", ""),
    ("Correction and", "Rehabilltation", "Public  Safety Sedan", "1"),
    ("Fire and", "Recsue", "Pick Up Trucks", "12"), ("Fire and", "Rescue", "Sedan", "1"),
    ("Fire and", "Rescue", "Sedan", "1"), ("Finance", "", "Sedan", "3"),
    ("General", "Servcies", "Heavy Duty", "5"), ("Enviromnental", "Protection", "CUV", "1"),
]


def test_fleet_from_dirty_rows_to_totals(spark):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(FLEET_PARTS)],
        "n int, first string, second string, kind string, cnt string",
    )
    words = spark.createDataFrame(
        [("Rehabilltation", "Rehabilitation"), ("Enviromnental", "Environmental"),
         ("Recsue", "Rescue"), ("Servcies", "Services")],
        "wrong string, right string",
    )
    options = CleanOptions(infer_types=True, drop_duplicates=True)
    done = clean(df, options, ["n"], typed=True).frame
    fixed = fix_spelling(fix_spelling(done, "first", words), "second", words)
    merged = fixed.select(merge_parts("first", "second").alias("department"), "kind", "cnt")
    totals = reports.total_by_group(merged, "department", "cnt").collect()
    assert [tuple(r) for r in totals] == [
        ("Fire and Rescue", 13), ("General Services", 5), ("Finance", 3), ("Board of Elections", 1),
        ("Correction and Rehabilitation", 1), ("Environmental Protection", 1),
    ]
    stats = reports.basic_stats(merged, "cnt").first()
    assert (stats["sum_value"], stats["count_value"]) == (24, 7)
    crossed = reports.two_way(merged, "department", "kind", ["Sedan", "Van"], F.sum("cnt"))
    assert {r["department"]: (r["Sedan"], r["Van"]) for r in crossed.collect()}["Finance"] == (3, 0)


UNTIDY = """<div><TABLE class=x><tr><th>A<th>B<tr><td>1<td>two<br>lines &amp; more
<tr><td colspan=2><table><tr><td>inner</td></tr></table></td></tr></TABLE></div>"""


def test_tables_of_pages(spark):
    tidy = "<table><tr><th>A</th><th>B</th></tr>\n<tr><td> 1 </td><td><b>x</b>&amp;y</td></tr></table>"
    pages = spark.createDataFrame([(1, tidy), (2, tidy + tidy), (3, "none")], "page_id int, html string")
    rows = html.extract_tables(pages)
    same = html.extract_untidy_tables(pages)
    keys = ["page_id", "table_no", "row_no"]
    assert rows_of(rows, *keys) == rows_of(same, *keys)
    assert rows.filter("page_id = 2").count() == 4
    assert rows_of(rows, *keys)[1] == (1, 0, 1, False, ["1", "x&y"])
    wild = html.extract_untidy_tables(spark.createDataFrame([(9, UNTIDY)], "page_id int, html string"))
    out = rows_of(wild, *keys)
    assert out[0][3:] == (True, ["A", "B"])
    assert out[1][4] == ["1", "twolines & more"]
    assert out[-1][1:] == (1, 0, False, ["inner"])


def test_defects_are_repeatable(spark):
    base = spark.range(20000).select("id", F.lit("abba").alias("t"), F.lit(1.0).alias("v"))
    pick = defects.hash_picker("id", seed=3)
    bad = defects.blank_cells(base, ["t"], 0.02, pick)
    blanks = bad.filter("t IS NULL").count()
    assert 300 < blanks < 500
    assert blanks == defects.blank_cells(base, ["t"], 0.02, pick).filter("t IS NULL").count()
    assert defects.misspell_cells(base, ["t"], 1.0, pick).first()["t"] == "aaabbaaa"
    assert spark.range(1).select(defects.misspell(F.lit("xyz"))).first()[0] == "xyz111"
    copies = defects.add_copies(base, 0.02, pick).count() - 20000
    assert copies == defects.sample_rows(base.withColumnRenamed("id", "id"), 0.02, lambda n, r: pick("copy", r)).count()
    order = [r["id"] for r in defects.shuffle_rows(base.limit(50), ["id"], 1).collect()]
    assert sorted(order) == list(range(50)) and order != sorted(order)


def test_stream_equals_batch(spark, tmp_path):
    options = CleanOptions(infer_types=True, parse_dates=True, fill_missing="mean")
    folder = str(tmp_path / "in")
    header = "id,amount,day\n"
    texts = ["1, 10 ,2024-01-02\n,,\n2,NA,03/01/2024\n", "3,20.5,bad\n4,,2024/01/05\n"]
    (tmp_path / "in").mkdir()
    for i, text in enumerate(texts):
        (tmp_path / "in" / f"{i}.csv").write_text(header + text)
    schema = "id string, amount string, day string"
    batch_in = spark.read.schema(schema).option("header", True).csv(folder)
    batch = clean(batch_in.withColumn("k", F.lit(0)), options, ["k"])
    stream_in = spark.readStream.schema(schema).option("header", True).csv(folder)
    stream = clean_stream(stream_in.withColumn("k", F.lit(0)), batch.rules, options, ["k"])
    done = run_to_table(stream, str(tmp_path / "state"), str(tmp_path / "out"))
    as_bag = lambda df: Counter(tuple(r) for r in df.collect())
    assert as_bag(done) == as_bag(batch.frame.select(*done.columns))


def test_stream_duplicates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = "a,2024-01-01 00:00:00\na,2024-01-01 00:00:00\nb,2024-01-01 00:05:00\n"
    (tmp_path / "in" / "1.csv").write_text(rows)
    (tmp_path / "in" / "2.csv").write_text(rows)
    events = spark.readStream.schema("k string, ts timestamp").csv(str(tmp_path / "in"))
    once = distinct_stream(events, ["k"], "ts", "1 hour")
    done = run_to_table(once, str(tmp_path / "state"), str(tmp_path / "out"))
    assert sorted(r["k"] for r in done.collect()) == ["a", "b"]


def test_small_result_as_one_csv_file(spark, tmp_path):
    path = str(tmp_path / "top")
    write_small_csv(spark.range(50).selectExpr("id", "' a \"b\"' AS t").limit(10), path)
    parts = list((tmp_path / "top").glob("part-*"))
    assert len(parts) == 1
    assert parts[0].read_text().splitlines()[:2] == ["id,t", '0," a ""b"""']


def test_reports_are_the_same_without_a_broadcast(spark, monkeypatch):
    lineitem = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    part = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    asked = [
        lambda: reports.quantity_by_model(lineitem, part),
        lambda: reports.profit_by_date_model(lineitem, part),
        lambda: reports.profit_one_model_by_dealer(lineitem, part, "Brand#12"),
    ]
    near = [rows_of(fn(), *fn().columns) for fn in asked]
    monkeypatch.setattr(reports, "fits_broadcast", lambda df: False)
    assert near == [rows_of(fn(), *fn().columns) for fn in asked]
