import random

import pytest

WORDS = [a + b for a in ("the", "and", "ing", "tion", "ou", "er", "st", "ha") for b in ("re", "nd", "ly", "est", "on", "at", "le", "is")]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case: nulls in any column, empty and long texts, ties, repeated rows."""
    base = prose(1, 300)
    words = base.split()
    near = " ".join(words[:100] + ["edited"] + words[101:])
    out = [(i, prose(100 + i, 60 + 7 * i), "en" if i % 3 else "de", f"src{i % 2}") for i in range(12)]
    out += [
        (20, base, "en", "src0"), (21, base, "en", "src0"), (22, near, "en", "src1"), (23, base.upper(), "en", None), (24, None, "en", "src0"), (25, "", None, "src1"), (26, " \t\n", "en", "src1"),
        (27, "For " * 400, "en", "src0"), (28, "one two three", "en", "src0"), (29, "One  Two\nthree", "en", "src0"), (30, prose(7, 20000), "en", "src0"), (31, "é" * 500 + " " + base, "fr", "src0"),
        (None, prose(9, 50), None, None), (32, prose(3, 40) + " " + base[:450] + " " + prose(4, 40), "en", "src0"), (33, prose(5, 40), "en", "src0"), (33, prose(5, 40), "en", "src0"),
        (34, "a### b### c$$$ " * 30, "en", "src0"), (35, "line of words here\n" * 8 + prose(6, 30), "en", "src1"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names clash with those that operators use."""
    schema = "doc_id long, text string, lang string, source string"
    extra = ["'x' as n_words", "1 as score", "2 as q", "'y' as doc", "3 as id", "4 as size", "5 as component_id", "6 as h"]
    return spark.createDataFrame(rows, schema).selectExpr("*", *extra).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
