import zlib

import numpy as np
import pytest

from scrubline.llm.packing import _fullest, best_pattern, pack_documents, solve
from scrubline.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def reference_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_every_id_in_one_place(odd_docs, odd_rows):
    rows = pack_documents(odd_docs, PATH).collect()
    expected = {}
    for i, t in odd_rows:
        expected.setdefault(i, reference_ids(t))
    repeats = {i: sum(1 for j, _ in odd_rows if j == i) for i in expected}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, {}).setdefault(r.start, []).append(r)
    assert set(pieces) == set(expected)
    for i, ids in expected.items():
        at = 0
        for start in sorted(pieces[i]):
            assert len(pieces[i][start]) == repeats[i] and start == at
            for r in pieces[i][start]:
                part = ids[start : start + r.length].tobytes()
                assert bytes(r.ids) == part and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)
            at += pieces[i][start][0].length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    filled = sum(len(ids) * repeats[i] for i, ids in expected.items())
    assert len(sequences) <= filled / 2048 * 1.1 + 2


def test_pack_nothing(no_docs):
    assert pack_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("text", ["Don't  STOP now…", "İstanbul ǅ ﬁne été", "a\x1cb\x1fc", "x<|endoftext|>y 12３", "ß" * 50, "İ" + "ΑΣ ΑΣ."])
def test_chunks_give_the_ids_of_the_whole(text):
    from scrubline.llm.word_tokens import encoder

    assert encoder(PATH).encode(text) + np.array([1], "<u4").tobytes() == reference_ids(text).tobytes()


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    demand = rng.poisson(rng.choice([0.3, 4, 200]), 64)
    demand[-1] = 0
    plan = solve(demand)
    sizes = np.arange(1, 65)
    assert (plan.columns.T @ plan.counts == demand).all() and (plan.columns @ sizes <= 64).all()
    ideal = float(demand @ sizes) / 64
    assert plan.counts.sum() <= ideal * 1.02 + 2


def test_dynamic_programs_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        prices = rng.random(6)
        best = max(
            sum(p * n for p, n in zip(prices, c))
            for c in np.ndindex(7, 4, 3, 2, 2, 2)
            if sum((k + 1) * n for k, n in enumerate(c)) <= 6
        )
        value, pattern = best_pattern(prices, 6)
        assert value == pytest.approx(best) and pattern @ np.arange(1, 7) <= 6
        left = rng.integers(0, 3, 10)
        room = int(rng.integers(1, 11))
        sums = {0}
        for size, n in enumerate(left[:room], start=1):
            for _ in range(n):
                sums |= {s + size for s in sums if s + size <= room}
        assert sum(_fullest(left, room)) == max(sums)


def test_words_stay_known_when_chunks_are_forgotten(monkeypatch):
    from scrubline.llm import word_tokens

    class Counted:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, word):
            self.asked.append(word)
            return self.model.tokenize(word)

    monkeypatch.setattr(word_tokens, "CACHE", 40)
    encoder = word_tokens.Encoder(PATH)
    encoder.model = Counted(encoder.model)
    words = ["Stone", "Möwe", "ÀÉÎ", "garden", "été", "x"]
    text = " ".join(w + m for m in ("", ",", ".", ";", ":", "!", "?", "!?", "...", "--", "(", ")") for w in words)
    plain = encoder.normalize
    encoder.normalize = None  # not needed up to the last letter of Latin-1
    for _ in range(3):
        got = encoder.encode(text)
    assert len(encoder) <= 40 and len(encoder.model.asked) == len(set(encoder.model.asked)) == len(words) + 11
    encoder.normalize = plain
    assert got + np.array([1], "<u4").tobytes() == reference_ids(text).tobytes()
    for letter in filter(str.isalpha, map(chr, range(128, 256))):
        assert plain(letter) == letter.lower() and plain("a" + letter + "Z") == ("a" + letter + "Z").lower()
