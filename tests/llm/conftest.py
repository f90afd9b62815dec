"""Small tables with the cases that the operators define: nulls, ties, copies, long texts, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
#: Names that operators give to columns of their own.
CLASHING = ["size", "kept", "n_words", "shard", "bucket", "slot", "target", "taken", "labels", "block", "words", "h", "node", "rep", "start", "key"]


def texts_of(seed: int, n: int) -> list:
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghiklmnoprstuvwxyz", k=r.randint(1, 9))) for _ in range(300)]
    vocabulary += ["Ünïcode", "naïve", "数据", "ΑΣ", "été", "don't", "U.S.", "#tag", "<|endoftext|>", "x y", "\U0001f600"]
    prose = lambda k: " ".join(r.choices(vocabulary, k=k))
    shared = prose(60)
    out = [None, "", "  \n\t ", "one", "One", "two words", prose(20_000), "a " * 600, "\n".join([prose(12)] * 6)]
    base = prose(80)
    out += [base] * 5 + [base.upper(), base.replace(" ", "\n", 3), base + " tail"]
    for _ in range(n):
        kind = r.random()
        if kind < 0.3:
            words = base.split()
            for _ in range(r.randint(0, 12)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(" ".join(words))
        elif kind < 0.6:
            out.append(f"{prose(r.randint(0, 60))} {shared[r.randint(0, 80):]} {prose(r.randint(0, 40))}")
        else:
            out.append(prose(r.randint(1, 200)))
    return out


@pytest.fixture(scope="session")
def rows():
    r = random.Random(5)
    texts = texts_of(1, 60)
    ids = r.sample(range(-50, 5000), len(texts))
    return [(i, t, r.choice(["en", "de", None]), r.choice(["web", "web", "web", "code", "books", None]), len(t or "")) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, a null id, one id with two texts, and extra columns of clashing names."""
    more = [*rows[:20], *rows[:3], (None, "no id", None, None, 0), (None, None, None, None, None), (rows[4][0], "another text", "en", "web", 3)]
    schema = ", ".join([SCHEMA, *[f"`{c}` string" for c in CLASHING]])
    return spark.createDataFrame([(*m, *["x"] * len(CLASHING)) for m in more], schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
