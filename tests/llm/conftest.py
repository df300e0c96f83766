import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `row` int, id int, block int, tail boolean, fp long, starts int, row_key string, s_text string, hash string, key string, kept string, score double, copies int, _row int, _source string, _k string, runs int, items int"


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows():
    """Documents with every awkward case: nulls, empty and blank texts, a very long one, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(3)
    passage = words(rng, 45, 5000)
    base = words(rng, 120, 5000)
    near = base.split()
    near[60] = "changed"
    texts = {
        1: None, 2: "", 3: " \t\n ", 4: "one", 5: "one two three", 6: base, 7: base, 8: " ".join(near), 9: words(rng, 50) + " " + passage + " " + words(rng, 30),
        10: passage + " tail", 11: words(rng, 40_000, 400), 12: "La la la " * 30, 13: "É ü ñandú 東京 " * 8, 14: words(rng, 25), 15: words(rng, 19), 16: words(rng, 20),
        17: "x" * 100_000, 18: "Mixed CASE words ÀÉ\x0b\x0cnext\x1cline", 19: passage.upper(),
    }
    out = [(i, t) for i, t in texts.items()] + [(14, texts[14]), (None, "text without an id " * 3), (None, None)]
    return [(i, t, None if (i or 0) % 4 == 0 else "en", None if (i or 0) % 5 == 0 else f"src{(i or 0) % 3}", None if t is None else len(t), *[None] * 19) for i, t in out]


@pytest.fixture(scope="session")
def docs(spark):
    """The awkward documents, with extra columns named like the operators' own."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain():
    """(doc_id, text) pairs of docs."""
    return [(r[0], r[1]) for r in rows()]
