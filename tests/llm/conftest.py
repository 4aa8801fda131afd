import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    out = []
    for i in range(n):
        out.append(rng.choice(words) + (".\n" if i % 11 == 10 else ""))
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, blanks, nulls, ties and a long text."""
    rng = random.Random(7)
    passage = prose(rng, 90)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(12)]
    texts = list(base)
    texts += [base[0], base[0], base[1].upper(), base[2] + " tail end"]
    near = base[3].split(" ")
    near[5] = "changed"
    texts += [" ".join(near), base[4] + "\n" + passage, passage + base[5], base[6][:200] + passage + base[7][:150]]
    texts += ["", None, " \n\t ", "x", "é ü 日本 語", "one two three", "one two three", "ab " * 400, prose(rng, 6000), base[8] + "\n" + base[8]]
    sources = ["s1", "s2", None, "s3"]
    return [(i, t, ["en", "de", None][i % 3], sources[i % 4] if i % 2 else "s1", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, a repeated id with another text, null ids, and columns with clashing names."""
    more = rows[:4] + rows[:4] + [(0, "another text under a used id", None, None, None), (None, rows[0][1], "en", "s1", 3), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 1, 2, 3, "x", "y") for r in more], SCHEMA + ", size long, shard long, score long, id string, token string")
