import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = (
    "run sha n_bytes best n segment place fp text_hash first root head size target weight slot block start from words chunk one taken d1 d2 seed "
    "seeds places again starts atom shard law kept label probability features value left right path nth mention kind shown row id hash swapped "
    "n_entities score toxic quality _n _id _h _base _sum component_id keep_id group_size"
).split()


def edge_rows():
    """Nulls everywhere, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "ünïcode", "Tail.", "x1", "the"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30_000))
    story = " ".join(f"w{i}" for i in range(60))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, None, None, None, None), (None, "two words", None, "b", 9),
        (3, "two words", "en", "a", 9), (4, "two words", "en", None, 9), (4, "two words", "en", None, 9), (5, long, "en", "a", len(long)),
        (6, long, "en", "b", len(long)), (7, " \t\n\x0b ", "en", "c", 5), (8, story, "en", "c", 1), (9, story + " more", "en", "c", 1),
        (9, "other text under a repeated id", "en", "c", 1), (10, "one", "en", "a", 3), (11, "ONE", "en", "a", 3), (12, "a  b   c \n\n d ", "en", "d", 1),
        (13, "\n".join(["same line here"] * 30), "en", "d", 1), (14, "mail me@site.org or call +1 (212) 555-0199", "en", "d", 1),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(edge):
    """The edge rows with extra columns under the names that operators use."""
    from pyspark.sql import functions as F

    return edge.select("*", *[F.lit(7).alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def small(spark):
    """A slice of prose with copies and near copies, built here."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    rows = []
    for i in range(160):
        text = rng.choice(texts)
        kind = i % 4
        if kind == 1:
            ws = text.split()
            ws[rng.randrange(len(ws))] = "changed"
            text = " ".join(ws)
        elif kind == 2:
            ws = text.split()
            k = rng.randrange(len(ws) + 1)
            text = " ".join(ws[:k] + passage.split() + ws[k:])
        rows.append((i, text, "en", f"s{i % 7}", len(text)))
    return spark.createDataFrame(rows, COLUMNS).cache()
