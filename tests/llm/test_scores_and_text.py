import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import language, toxicity
from scrubline.llm.main_text import extract_main_text, kept_lines, main_text
from scrubline.llm.queries import tokenizer_path
from scrubline.llm.token_counts import ByteTokens, attribute, count_tokens

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
WORDS = "the of and river stone light winter under sails copper garden seven lantern".split()


def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


# --- toxicity ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def marked(spark):
    """Texts of which a third hold several of a few words that others never use."""
    rng = random.Random(6)
    bad = ["grumbler", "blighter", "scoundrel", "wretch"]
    rows = []
    for i in range(360):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 200))]
        toxic = int(i % 3 == 0)
        for _ in range(toxic * rng.randint(3, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_toxicity_on_a_held_out_fold(marked, odd_docs, odd_rows):
    docs, labels, truth = marked
    held_out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    known = labels.where(~F.col("doc_id").isin(held_out))
    model = toxicity.train(docs, known)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert set(got) == set(truth) and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.7) == bool(truth[i]) for i in held_out]
    assert np.mean(right) >= 0.95
    odd = toxicity.score_documents(odd_docs, model).collect()
    assert Counter(r.doc_id for r in odd) == Counter(i for i, _ in odd_rows)
    assert all(r.n_windows >= 1 and 0 <= r.score < 0.7 for r in odd)
    kept = toxicity.drop_toxic(docs, model)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}
    assert toxicity.drop_toxic(odd_docs, model).columns == odd_docs.columns


def test_toxicity_without_a_class(spark, marked, no_docs):
    docs, labels, _ = marked
    for part, score in (("toxic = 1", 1.0), ("toxic = 0", 0.0), ("toxic = 7", 0.0)):
        model = toxicity.train(docs, labels.where(part))
        assert {r.score for r in toxicity.score_documents(docs, model).collect()} == {score}
    assert toxicity.score_documents(no_docs, model).count() == 0
    odd = labels.limit(3).union(spark.createDataFrame([(None, 1), (1, None)], labels.schema))
    assert toxicity.sample_labelled(odd.union(odd)).count() == 3


def test_gain_is_a_difference_of_lengths():
    coder = toxicity.Coder()
    common, bad = b"".join(coder.words("the of and")), b"".join(coder.words("grumbler blighter"))
    gauge = toxicity.Gauge(common, bad)
    clean, marked = gauge.gains("the river of stone"), gauge.gains("the grumbler of blighter")
    assert clean[0] <= 0 < marked[0] and len(gauge.gains(None)) == 1
    assert len(gauge.gains("a " * 17)) == 3


# --- language ----------------------------------------------------------------------------------


def test_language(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(9)
    sounds = {"aa": "ba lo mi sa te".split(), "bb": "sch ung er ein ach".split(), "cc": "éa oux que ç ré".split()}
    rows = []
    for i in range(150):
        name = list(sounds)[i % 3]
        text = " ".join("".join(rng.choices(sounds[name], k=3)) for _ in range(rng.randint(5, 40)))
        rows.append((i, text.upper() if i % 5 == 0 else text, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = docs.where("doc_id % 4 <> 2").union(
        spark.createDataFrame([(900, None, "aa"), (901, "ba", None), (902, " 1 2", "dd")], docs.schema)
    )
    prototypes = language.train_prototypes(known)
    assert set(prototypes) == {"aa", "bb", "cc"}
    truth = {r[0]: r[2] for r in rows}
    got = language.identify_language(docs, prototypes).collect()
    assert all(r.lang_pred == truth[r.doc_id] and 0 < r.score <= 1 for r in got)
    odd = language.identify_language(odd_docs, prototypes).collect()
    assert Counter(r.doc_id for r in odd) == Counter(i for i, _ in odd_rows)
    letters = {i: any(c.isalpha() for c in t or "") for i, t in odd_rows}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in odd)
    assert language.identify_language(no_docs, prototypes).count() == 0
    assert {r.lang_pred for r in language.identify_language(docs, {}).collect()} == {"und"}
    assert language.train_prototypes(docs.limit(0)) == {}


def test_bundle_binds_shifted_letters():
    binder = language.Binder(64, 3)
    codes = language._letter_codes("ab, a")
    total = np.zeros(64)
    for k in range(len(codes) - 2):
        bound = np.ones(64)
        for place in range(3):
            bound = bound * binder.places[place][codes[k + place]]
        total += bound
    assert np.allclose(binder.bundle("AB, a"), total) and binder.bundle(" 1 ") is None
    assert (binder.places[0] == np.roll(binder.places[2], 2, axis=1)).all()


# --- token counts ------------------------------------------------------------------------------


def slow_counts(text, spans):
    """Every token against every section, by its bytes."""
    tokens = ByteTokens(RANKS, pattern())
    at, starts = 0, [k for k, c in enumerate(text) for _ in c.encode("utf-8", "replace")]
    counts, outside = [0] * len(spans), 0
    ids = tokens.encoding.encode_ordinary(text)
    for token in ids:
        size = len(tokens.encoding.decode_single_token_bytes(token))
        first, stop = starts[at], starts[at + size - 1] + 1
        at += size
        shares = [max(0, min(stop, b) - max(first, a)) for a, b in spans]
        if max(shares, default=0):
            counts[shares.index(max(shares))] += 1
        else:
            outside += 1
    return counts, outside, len(ids)


def test_token_counts_by_line(odd_docs, odd_rows, no_docs):
    got = Counter()
    for r in count_tokens(odd_docs, RANKS, pattern()).collect():
        got[r.doc_id, r.section, r.start, r.stop, r.n_tokens, r.doc_tokens] += 1
    expected = Counter()
    for i, text in odd_rows:
        text, at, spans = text or "", 0, []
        for line in text.split("\n"):
            spans.append((at, min(len(text), at + len(line) + 1)))
            at += len(line) + 1
        counts, outside, total = slow_counts(text, spans)
        assert outside == 0 and sum(counts) == total
        expected.update((i, k, a, b, n, total) for k, ((a, b), n) in enumerate(zip(spans, counts)))
    assert got == expected
    assert count_tokens(no_docs, RANKS, pattern()).count() == 0


def test_token_counts_of_given_sections(spark):
    text = "Überlange Wörter cross 👍🏽 the boundaries of internationalization sections"
    spans = [(0, 4), (4, 4), (7, 25), (25, 27), (40, 58)]
    sections = F.array(*[
        F.struct(F.lit(f"s{k}").alias("name"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop"))
        for k, (a, b) in enumerate(spans)
    ])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = count_tokens(docs, RANKS, pattern(), sections).orderBy("section").collect()
    counts, outside, total = slow_counts(text, spans)
    assert [r.n_tokens for r in rows] == [outside, *counts] and rows[0].section == -1
    assert sum(r.n_tokens for r in rows) == total and sum(r.n_crossing for r in rows) > 0


def test_rule_for_crossing_tokens():
    at = np.array
    counts, crossing, outside = attribute(at([0, 4, 9]), at([4, 8, 12]), at([0, 6]), at([6, 9]))
    assert counts.tolist() == [2, 0] and crossing.tolist() == [1, 0] and outside == 1


# --- main text ---------------------------------------------------------------------------------

PAGES = [
    (None, ""),
    ("", ""),
    ("<p>tiny", "tiny"),
    (
        "<html><head><title>T</title><style>p{}</style></head><body class='sidebar'><nav>menu</nav>"
        "<header>Site</header><article><header><h1>Head&amp;line</h1></header><p>One <b>two\n three"
        "<br>four</p><aside>by</aside><p>F&uuml;nf &#8212; <script>x('<p>')</script>six"
        "<div class='ad'>Buy<div>now</div></div><section id=comments>Nice</section></article>"
        "<div>after</div><footer>&copy;</footer>",
        "Head&line\nOne two three four\nFünf — six",
    ),
    (
        "<div id='menu'><a>Home</a></div><div><a href=x>only a link that is rather long, really long"
        "</a></div><div><h2>Title</h2><p>" + "Many words here. " * 8 + "</p><p>Short.</p><ul><li>item one"
        "</ul></div><form><p>mail us</p></form><div class='cookie-notice'>We use</div><p>Legal</p>",
        "Title\n" + ("Many words here. " * 8).strip() + "\nShort.\nitem one",
    ),
    ("<article><p>a<p>b<table><tr><td>c<td>d</table>e</article>", "a\nb\nc\nd\ne"),
    ("<article>x &lt;p&gt; y &am</article", "x <p> y &am"),
    ("<main><p>before " + "<i>deep</i> " * 3000 + "</p></main>", "before " + " ".join(["deep"] * 3000)),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert "\n".join(main_text(html)) == text


LONG = ("Many words of the main text here. " * 6).strip()
LINKS = "".join(f"<li><a href=/{k}>Another page, number {k}</a></li>" for k in range(6))


@pytest.mark.parametrize("html,text", [
    # a teaser in a mark does not take the page's text away
    (f"<div>{LONG}</div><div>{LONG}</div><article><h3><a href=x>Card</a></h3></article>", f"{LONG}\n{LONG}\nCard"),
    # a list of links in the mark is not text, a line that is a link between two lines of text is
    (f"<article><p>One</p><p><a href=x>Two</a></p><p>Three</p><ul>{LINKS}</ul></article>", "One\nTwo\nThree"),
    (f"<main><ul>{LINKS}</ul><h1><a href=x>Headline</a></h1><p>Body</p></main>", "Headline\nBody"),
    # little text beside the mark is no surge of its own, nor part of the mark's
    ("<div>Posted on Monday</div><article><p>Body</p></article><div>Legal</div>", "Body"),
])
def test_marks_are_extra_weight(html, text):
    assert "\n".join(main_text(html)) == text


@pytest.mark.parametrize("html,text", [
    ("<article><p class='notice'>Hi<p>Body</p><p>More</p></article>", "Body\nMore"),
    ("<article><p class='notice'>Hi<div>Body</div></article>", "Body"),
    ("<article><ul><li class=share>Post<ul><li>it</ul><li>One<li>Two</ul><p>Body</article>", "One\nTwo\nBody"),
    ("<article><table><tr><td class=ad>Buy<td>One<tr><th hidden>x<tr><td>Two</table>Body</article>", "One\nTwo\nBody"),
    ("<article><table><tr class=ad><td><table><tr><td>x</table>y<tr><td>One</table></article>", "One"),
    ("<article><dl><dt>A<dd class=promo>Buy<dt>B<dd>C</dl>Body</article>", "A\nB\nC\nBody"),
    ("<article><p><b class=ad>Buy<p>in</b> Body</article>", "in Body"),
    ("<article><div><p>One</p><section class=ad><p>Buy</div><p>Body</article>", "One\nBody"),
    ("<article><p>One <span class=ad>Buy <span>now</span></span> two <option class=ad>x<option>three</article>", "One two\nthree"),
    ("<article><nav><p>x</article>" + f"<div>{LONG}</div>", LONG),
    # what closes only inside a silent element does not end the silence
    ("<article><div class=ad><p>x<p>y</p></p></b></section><div>z</div>q</div>Body</article>", "Body"),
    ("<article><p>One <button><p>x</p>y</button> two</p></article>", "One\ntwo"),
    (f"<a name=top><div>{LONG}</div>", LONG),
    (f"<p><a href=x>Start<p>{LONG}</p>", LONG),
])
def test_elements_without_end_tag(html, text):
    assert "\n".join(main_text(html)) == text


def test_pages(spark):
    rows = [(k, f"http://e/{k}", html, 1, "x") for k, (html, _) in enumerate(PAGES)] + [(None, None, "<p>q", 2, "y")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = Counter(tuple(r)[:4] for r in extract_main_text(pages).collect())
    expected = Counter((k, f"http://e/{k}", t, len(t)) for k, (_, t) in enumerate(PAGES))
    expected[None, None, "q", 1] = 2
    assert got == expected
    assert extract_main_text(pages.limit(0)).count() == 0


def test_surge_and_dive():
    assert kept_lines([0, 5, 0, 0, 0, 90, 3, 0, 40, 0, 0, 0, 2], 86) == [(5, 9)]
    assert kept_lines([], 1) == [] and kept_lines([0, 0], 1) == []
