import random
import re

import pytest

from scrubline.llm import boosting, private_data
from scrubline.llm.private_data import KINDS, all_spans, find_private, listed, redact, train

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_by_hand(text):
    return [
        (k, m.start(), m.end())
        for k, kind in enumerate(KINDS)
        for m in re.finditer(PLAIN[kind], text or "", re.ASCII)
        if fits(kind, m[0])
    ]


def card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if luhn(body + d))


def phone(rng):
    return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}"


@pytest.fixture(scope="module")
def letters():
    """Texts with personal data, some of it so close together that base patterns run over it."""
    rng, rows, hidden = random.Random(8), [], {}
    words = "the river stone winter of Été 日本 and lantern".split()
    for i in range(900):
        parts = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        for _ in range(rng.randint(0, 2)):
            made = rng.choice(
                [card(rng), phone(rng), f"a{i}.b@mail{i % 9}.example.com", f"10.{i % 256}.7.{rng.randint(0, 255)}", f"key={i:012x}{rng.getrandbits(64):x}", "1999", "12:30"]
            )
            parts.insert(rng.randrange(len(parts)), f"so {made} so")
        if i % 30 == 0:
            both = phone(rng), card(rng)
            hidden[i] = both
            parts.insert(3, f"so {both[0]} {both[1]} so")
        rows.append((i, " ".join(parts)))
    return rows, hidden


@pytest.fixture(scope="module")
def model(spark, letters):
    return train(spark.createDataFrame(letters[0], "doc_id long, text string"))


ODD = [
    "a@b.co a.b@c.d.e@f.g x@y.comz_a@b.com a@b@c.com @x.y foo@ bar@x.com", "a@b. a@b.c. (a@b.c)", "müller@mail.de",
    "1.2.3.4.5.6.7.8 256.1.1.1 999.10.2.3.4 0001.2.3.4 1.2.3 1..2.3.4", "٣.1.2.3.4 1.2.3.4٣",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112", "4" * 40,
    "+1 (743) 555-3824 4111111111111111", "+12 +1- +1 2 3 4 5 6 7 8 9 0 +1.(2).3.4.5.6.7.8", "++1 2345678+",
    "+1 743 555 3824\n+1 743 555 3825", "write to jan [at] mail4 [dot] example [dot] com now", "👍🏽 a@b.co 👍🏽 1.2.3.4",
]


def test_base_spans_as_by_hand(spark, odd_docs, odd_rows, letters, model):
    extra = [(None if i % 2 else 7, t) for i, t in enumerate(ODD)] + letters[0][:200]
    docs = odd_docs.select("doc_id", "text", "score", "start").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True
    )
    for some in (model, private_data.Model()):
        got = find_private(docs, some).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        expected = sorted(((i, t or "", base_by_hand(t)) for i, t in odd_rows + extra), key=key)
        assert sorted(((r.doc_id, r.text, [tuple(s) for s in r.base]) for r in got), key=key) == expected
        for r in got:
            places = sorted((s.start, s.stop) for s in r.added)
            assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))
            assert all(s.stop <= b.start or b.stop <= s.start for s in r.added for b in r.base)


def test_data_hidden_in_chains_is_found(spark, letters, model):
    rows, hidden = letters
    assert set(model.thresholds) == set(KINDS) and min(model.thresholds.values()) > 0.3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in find_private(docs, model).collect()}
    for i, both in hidden.items():
        added = {found[i].text[s.start : s.stop] for s in found[i].added}
        assert added == set(both)
        # the base pattern of phones runs into the card
        assert not any(s.kind == 3 and found[i].text[s.start : s.stop] in both for s in found[i].base)
    others = [r for i, r in found.items() if i not in hidden]
    assert sum(len(r.added) for r in others) == 0


def test_spelled_out_address_has_the_form_of_others(spark, model):
    docs = spark.createDataFrame([(1, ODD[-2]), (2, "[at] nothing [dot] here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in find_private(docs, model).collect()}
    assert [rows[1].text[s.start : s.stop] for s in rows[1].added] == ["jan [at] mail4 [dot] example [dot] com"]
    assert not rows[2].added


def test_listed_and_redacted(spark, model):
    texts = ["a@b.co, 1.2.3.4", "x +1 (743) 555-3824 4111111111111111 y", "", None, "no data", "+1.2.3.4567"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = find_private(docs, model)
    spans = {r.doc_id: r.s for r in found.select("doc_id", listed(all_spans()).alias("s")).collect()}
    assert spans[0] == "email:0:6,ip:8:15" and spans[1] == "card:20:36,phone:2:19"
    assert spans[2] == spans[3] == spans[4] == ""
    done = {r.doc_id: r.redacted for r in redact(found).collect()}
    assert done[0] == "[email], [ip]" and done[1] == "x [phone] [card] y" and done[4] == "no data"
    assert done[2] == done[3] == ""
    # spans of two kinds over the same characters give one mark
    assert done[5] == "[phone]"


def test_long_texts_take_time_in_proportion(spark, model):
    texts = ["x" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "a@b.co " * 4_000, "." * 200_000, "4" * 300_000, "1 " * 100_000, "a@b" + ".c" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in find_private(docs, model).collect()}
    assert len(got[4].base) == 4_000 and [len(got[k].base) for k in (0, 3, 5, 6, 7)] == [0] * 5
    assert [tuple(s) for s in got[8].base] == [(0, 0, 200_003)]


def test_empty_tables_and_clashing_columns(spark, no_docs, odd_docs):
    nothing = train(no_docs)
    assert nothing.trees is None and find_private(no_docs, nothing).count() == 0
    clash = odd_docs.selectExpr("*", "1 as base", "2 as proposed", "3 as `a.b`", "4 as found", "5 as TEXTS")
    assert find_private(clash, nothing).columns == ["doc_id", "text", "base", "added"]


def test_trees_learn_a_conjunction(spark):
    rows = [(a, b, a * 7 % 5, 40, 36 if a > 2 and b <= 1 else 2) for a in range(6) for b in range(4)]
    table = spark.createDataFrame(rows, "a int, b int, c int, n long, verified long")
    model = boosting.fit(table, ["a", "b", "c"], rounds=6)
    got = table.select("a", "b", model.probability(lambda f: table[f]).alias("p")).collect()
    assert all((r.p > 0.7) == (r.a > 2 and r.b <= 1) for r in got)
    assert boosting.fit(table.where("false"), ["a", "b"]) is None
    again = boosting.fit(table.orderBy("c", "b"), ["a", "b", "c"], rounds=6)
    assert again == model


def test_calibration_pools_what_falls():
    assert boosting.calibrated([(1, 10, 1), (5, 10, 9), (6, 10, 7), (9, 4, 4)]) == [
        (1, 0.1, 10), (5, 0.8, 20), (6, 0.8, 20), (9, 1.0, 4),
    ]
