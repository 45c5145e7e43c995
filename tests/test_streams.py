"""Streams: first rows with all columns, late rows, bounded state, a profile kept up to date."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from scrubline.operators import profile
from scrubline.options import CleanOptions
from scrubline.plans.clean import clean
from scrubline.streaming.batches import BatchFolders
from scrubline.streaming.distinct import FirstRows
from scrubline.streaming.profiled import ProfiledStream

START = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, v int, `a.b` string"


def plainly(batches, hours):
    """Row by row: kept and late rows of ``(key, time, value, text)`` batches."""
    delay, high, kept, late, known = timedelta(hours=hours), None, [], [], []
    for rows in batches:
        mark = None if high is None else high - delay
        fresh = {}
        for row in rows:
            if row[1] is None or (mark is not None and row[1] < mark):
                late.append(row)
            elif not any(k == row[0] and (mark is None or t + delay >= mark) for k, t in known):
                if row[0] not in fresh or row[2] < fresh[row[0]][2]:
                    fresh[row[0]] = row
        kept += fresh.values()
        known += [(r[0], r[1]) for r in fresh.values()]
        high = max([t for _, t, *_ in rows if t is not None] + [high or datetime.min])
        high = None if high == datetime.min else high
    return kept, late


def bag(rows):
    return sorted((tuple(r) for r in rows), key=str)


def random_batches(seed, n):
    rng, value, out = random.Random(seed), 0, []
    for i in range(n):
        rows = []
        for _ in range(rng.choice([0, 1, 30, 60])):
            at = START + timedelta(hours=2 * i, minutes=rng.randint(-240, 120))
            value += 1
            key = rng.choice([None, "", "hot", "hot", *map(str, range(20))])
            rows.append((key, rng.choice([at] * 30 + [None]), value, f"t{value}"))
        rng.shuffle(rows)
        out.append(rows)
    return out


def test_first_rows_by_files_in_and_beyond_the_delay(spark, tmp_path):
    at = lambda h, m=0: START + timedelta(hours=h, minutes=m)
    batches = [
        [("a", at(10), 2, "x"), ("a", at(10), 1, "first"), ("b", at(10, 5), 3, None)],
        [("c", at(9, 30), 4, "out of order"), ("a", at(10, 1), 5, "copy"), ("d", at(12), 6, "x")],
        [("e", at(10, 30), 7, "late"), ("d", at(12), 8, "copy"), (None, at(12, 10), 9, "n"),
         ("f", None, 10, "no time")],
        [(None, at(12, 10), 11, "copy"), ("a", at(14), 12, "known no longer")],
    ]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(source))
        for f in source.glob("part-*"):
            if f.stat().st_mtime > 1_000_000_000:
                os.utime(f, (1000 + i, 1000 + i))  # files arrive in this order
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    first = FirstRows(("k",), "ts", "1 hour", str(tmp_path / "out"), ("v",))
    done = first.run(stream)
    kept, late = plainly(batches, 1)
    assert done.rows.columns == ["k", "ts", "v", "a.b"]
    assert bag(done.rows.collect()) == bag(kept)
    assert bag(done.late.collect()) == bag(late)
    assert {r[2] for r in kept} == {1, 3, 4, 6, 9, 12} and {r[2] for r in late} == {7, 10}
    # a second call has nothing to do
    assert first.run(stream).rows.count() == len(kept)
    # what is remembered now: nothing older than twice the delay
    folders = BatchFolders(str(tmp_path / "out"))
    mark = folders.read(spark, "marks", "batch int, first int", [3]).first()
    assert mark["first"] == 1
    passed = int((at(14) - timedelta(hours=1) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    known = first.remembered(spark, stream.schema, range(mark["first"], 4), passed)
    assert sorted(str(r[0]) for r in known.collect()) == ["None", "a", "d"]


def test_first_rows_against_a_plain_loop(spark, tmp_path):
    for seed in range(2):
        batches = random_batches(seed, 7)
        first = FirstRows(("the.k",), "ts", "2 hours", str(tmp_path / f"{seed}"), ("v",))
        for i, rows in enumerate(batches):
            frame = spark.createDataFrame(rows, SCHEMA.replace("k string", "`the.k` string"))
            first.take(frame, i)
            if i == 3:
                first.take(frame, i)  # runs again after a failure
        kept, late = plainly(batches, 2)
        read = lambda kind: first.folders.read(spark, kind, frame.schema).collect()
        assert bag(read("rows")) == bag(kept)
        assert bag(read("late")) == bag(late) and late


def test_first_rows_of_an_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    done = FirstRows(("k",), "ts", "1 hour", str(tmp_path / "out")).run(stream)
    assert done.rows.count() == 0 == done.late.count() and done.rows.columns[3] == "a.b"


def test_profile_of_parts_is_that_of_the_whole(spark):
    rows = [(i, str(i) if i % 7 else None, f"{i / 4}" if i % 3 else "x") for i in range(300)]
    whole = spark.createDataFrame(rows, "id int, a string, b string")
    parts = [whole.filter(F.col("id") % 3 == k) for k in range(3)] + [whole.limit(0)]
    one = profile.column_profile(whole, ["a", "b"])
    split = [profile.column_profile(p, ["a", "b"]) for p in parts]
    both = profile.merge_profiles(split[0].unionByName(split[1]))
    merged = profile.merge_profiles(both.unionByName(split[2]).unionByName(split[3]))
    shown = lambda df: {
        r["column_name"]: [round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()
    }
    assert shown(merged) == shown(one) and one.columns == merged.columns


def test_types_and_fills_follow_the_stream(spark, tmp_path):
    options = CleanOptions(infer_types=True, fill_missing="mean")
    texts = ["1,10\n2,\n", "3,20\n4,word\n", "5,word\n6,word\n7,\n"]
    keeper = ProfiledStream(options, ("k",), str(tmp_path / "out"))
    schema = "k string, `The Amount` string"
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(str(source))
    seen = []
    for i, text in enumerate(texts):
        (source / f"{i}.csv").write_text(text)
        done = keeper.run(stream)
        rules = done.rules["the_amount"]
        whole = clean(spark.read.schema(schema).csv(str(source)), options, ["k"])
        assert rules == whole.rules["the_amount"]
        seen.append(rules.kind)
    assert seen == ["integer", "string", "string"]
    rows = {r["k"]: r["the_amount"] for r in done.rows.collect()}
    # 7 has nothing but its key, and by then nothing fills it
    assert rows == {"1": "10", "2": "10", "3": "20", "4": "word", "5": "word", "6": "word"}
