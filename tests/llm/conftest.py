import random

import pytest

WORDS = "alpha beta gamma delta river stone of the and in light water cloud seven green".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ordinary texts, copies, near copies, shared passages, empty, null, blank, multi-byte, one long word, one very long text."""
    base, passage = prose(1, 150), prose(2, 70)
    near = base.split()
    near[75] = "changed"
    return [
        base, base, " ".join(near), base.upper(), None, "", " \t\n ", "one", "two words", "tab\there", passage + " " + prose(3, 80), prose(4, 60) + " " + passage,
        "é ñ ß – 漢字 " * 30, "x" * 5000, prose(5, 9000), "line one here\nline one here\nline one here\n" * 20, "a  b   c \n\n d <|endoftext|> don't 'll", prose(6, 200),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "no id at all " * 10, None, None, None), (None, None, None, None, None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashes = ("print", "size", "kept", "part", "o", "v", "u", "w", "toxic", "draw", "target", "bands")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in clashes}).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, i % 3 == 0) for i in range(18)] + [(None, 1, True), (3, None, None), (3, 0, True)]
    return spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in rows], "doc_id long, quality int, toxic int")
