import random

import pytest

WORDS = "the of and river stone light winter under sails copper möwe été garden seven lantern".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls, empty and long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(25)]
    texts = [
        None, "", " \t\n", "a", "Sole", "x" * 700, "ab " * 900, base[0], base[0], base[0] + " ",
        base[1].replace(" ", "\t\n"), base[1], "Ünï çødé " * 40, "\x00nul\x00 byte", "👍🏽 emoji 👍🏽",
    ]
    for text in base:
        words = text.split()
        texts += [text, " ".join(words[: len(words) // 2] + ["changed"] + words[len(words) // 2 :])]
        texts.append("Shared opening passage that many documents have. " * 3 + prose(rng, 12))
    long = prose(rng, 6000)
    texts += [long, long + " end", long.upper()]
    rows = list(enumerate(texts, start=-2))
    return rows + [rows[7], rows[7], rows[20]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as a table of several partitions, with columns that clash with results."""
    clash = "keep_id long, score double, shard int, text_sha256 string, n_words long, start long"
    rows = [(i, t, "en", 1, 0.5, 2, "x", 3, 4) for i, t in odd_rows]
    schema = "doc_id long, text string, lang string, " + clash
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
