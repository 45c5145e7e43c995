import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scrubline.llm import alignment
from scrubline.llm.alignment import _range_fragment, align, byte_ranges
from scrubline.llm.queries import tokenizer_path
from scrubline.llm.token_groups import compose, empty_fragment, fragment, links, token_pair

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Groups of a whole text, encoded at once by tokenizers of our own."""
    from sentencepiece import SentencePieceProcessor

    tok_a, tok_b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tok_a.encode_special_tokens = True
    decoder = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        decoder[chr(b) if b in shown else chr(256 + [x for x in range(256) if x not in shown].index(b))] = b

    def groups(text):
        if not text:
            return []
        sides = []
        for ids, raw in (
            (tok_a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(decoder[c] for c in tok_a.id_to_token(i))),
            (tok_b.encode(text), lambda i: bytes([int(tok_b.id_to_piece(i)[3:5], 16)]) if tok_b.is_byte(i) else tok_b.id_to_piece(i).replace("▁", " ").encode()),
        ):
            tokens = [raw(i) for i in ids]
            if b"".join(tokens) != (" " + text).encode():
                return []
            sides.append((ids, np.cumsum([len(t) for t in tokens]).tolist()))
        shared = set(sides[0][1]) & set(sides[1][1])
        out = []
        for ids, ends in sides:
            cut = [[]]
            for i, end in zip(ids, ends):
                cut[-1].append(i)
                if end in shared:
                    cut.append([])
            out.append(cut[:-1])
        return list(zip(*out))

    return groups


def by_hand(rows, groups):
    found = [(key, groups(text)) for key, text in rows]
    counts = Counter()
    for _, gs in found:
        counts.update({(a, b) for xs, ys in gs for a in xs for b in ys})
    highest = Counter()
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    out = Counter()
    for key, gs in found:
        pairs = [(a, b) for xs, ys in gs for a in xs for b in ys]
        listed = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in gs)
        out[
            key, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(pairs),
            sum(counts[p] == highest[p[0]] for p in pairs), sum(counts[p] for p in pairs),
            hashlib.sha256(listed.encode()).hexdigest() if gs else "", listed,
        ] += 1
    return out


ODD = [
    "a  b", " lead", "trail ", "tab\tand\nnew line", "  nbsp", "<|endoftext|> <s> </s> <0x41>",
    "has ▁ mark", "▁", "=" * 900, "\x00 \x1c x", "日本語のテキスト 混ざった 文", "é é ﬁ",
    "spaces    many   of  them ", "x y" * 400, "👍🏽👨‍👩‍👧 ok", "\n\n a \n b", "   ", " ",
]
NAMES = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256 groups".split()


@pytest.mark.parametrize("chunk, fan, most", [(1 << 16, 8, 2_000_000), (40, 2, 2_000_000), (300, 3, 50), (64, 8, 0)])
def test_every_row_as_by_hand(spark, odd_docs, odd_rows, plain, chunk, fan, most):
    extra = spark.createDataFrame([(None if i % 3 else i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "score", "start").unionByName(extra, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = align(docs, A, B, with_groups=True, chunk=chunk, fan=fan, most_pairs=most)
    assert got.columns == NAMES
    assert Counter(tuple(r) for r in got.collect()) == by_hand(rows, plain)


def test_empty_table(no_docs):
    assert align(no_docs, A, B).columns == NAMES[:-1] and align(no_docs, A, B).count() == 0


def test_text_that_is_not_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text, 2 as `a.b`, 3 as DOC union all select 2L, 'ab', 2, 3")
    got = {r.doc_id: r for r in align(docs, A, B).collect()}
    assert got[1].n_a == 0 and got[1].groups_sha256 == "" and got[2].n_a > 0


@settings(max_examples=80, deadline=None)
@given(st.text("ab \n.é日=▁1", max_size=80), st.integers(1, 30))
def test_pieces_and_ranges_give_the_groups_of_the_whole(text, size):
    pair = token_pair(A, B)
    if not text:
        return
    found = pair.tokens(text)
    parts = [_range_fragment(pair, *r) for r in byte_ranges(pair, text, size)]
    if found is None:
        assert None in parts
        return
    whole, joined = fragment(*found), compose(parts)
    assert joined.closed
    assert [x.tolist() for x in whole] == [x.tolist() for x in joined]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 4)), max_size=30), st.data())
def test_composition_is_associative(steps, data):
    """Ranges cut anywhere and put together in any bracketing give one fragment."""
    ends = [np.cumsum([s[k] for s in steps], dtype=int) for k in (0, 1)]
    stop = max([0, *(int(e[-1]) for e in ends if len(e))])
    borders = sorted(data.draw(st.lists(st.integers(0, stop), max_size=5))) + [stop]
    parts, low = [], -1
    for high in borders:
        mask = [(e > low) & (e <= high) for e in ends]
        parts.append(fragment(np.flatnonzero(mask[0]), ends[0][mask[0]], np.flatnonzero(mask[1]), ends[1][mask[1]]))
        low = high
    whole = fragment(np.arange(len(steps)), ends[0], np.arange(len(steps)), ends[1])
    for _ in range(3):
        rest = list(parts)
        while len(rest) > 1:
            k = data.draw(st.integers(0, len(rest) - 2))
            rest[k : k + 2] = [compose([rest[k], empty_fragment(), rest[k + 1]])]
        assert [x.tolist() for x in compose(rest)] == [x.tolist() for x in whole]


def test_wide_groups_are_counted_by_distinct_ids():
    rng = random.Random(3)
    a, b = (np.array([rng.randrange(9) for _ in range(400)]) for _ in range(2))
    n = np.array([390, 10]), np.array([380, 20])
    packed, times, of = links(a, b, *n)
    got = Counter()
    for p, t, g in zip(packed.tolist(), times.tolist(), of.tolist()):
        got[g, p >> 32, p & 0xFFFFFFFF] += t
    expected = Counter((0, x, y) for x in a[:390].tolist() for y in b[:380].tolist())
    expected += Counter((1, x, y) for x in a[390:].tolist() for y in b[380:].tolist())
    assert got == expected and len(packed) < 400


@pytest.mark.parametrize("most", [0, 10**6])
def test_a_small_memory_gives_the_same_rows(monkeypatch, most):
    rng = np.random.default_rng(5)
    words = ["the", "of", "naïve", "日本", "x" * 40, *(f"w{i}" for i in range(300))]
    texts = [" ".join(rng.choice(words, 40) if k % 9 else words[:5]) for k in range(60)]
    texts += ["", "  two  spaces \n x", None, " edge ", texts[3]]
    batch = pa.record_batch(
        [pa.array(range(len(texts))), pa.array([t and t.encode() for t in texts], pa.binary())],
        ["doc_id", "body"],
    )
    taken = []
    monkeypatch.setattr(alignment, "map_batches", lambda docs, fn, schema: taken.append(fn))
    monkeypatch.setattr(alignment, "PORTION", 400)

    class Frame:
        def select(self, *_):
            return self

    def run(fn):
        done = pa.Table.from_batches(list(fn(iter([batch]))))
        return done.sort_by(done.column_names[0]).to_pylist()

    alignment._count_short(Frame(), A, B)
    whole = pa.Table.from_pylist(run(taken[0])).to_pydict()
    n = slice(0, most)
    counts = alignment._Counts(*(np.array(whole[c], np.int64)[n] for c in ("pair", "n", "n")))
    alignment._measure_short(Frame(), A, B, SimpleNamespace(value=counts), "rare", True)
    wide = [run(fn) for fn in taken]
    monkeypatch.setattr(alignment, "CACHE_BYTES", 3000)
    assert [run(fn) for fn in taken] == wide
    assert wide[1][0]["n_links"] > 0 and bool(wide[1][0]["rare"]) == (most == 0)
