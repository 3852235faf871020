import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(40_000))
PROSE = "The quick brown fox jumps over the lazy dog while the old farmer counts his seven white sheep near the river bank and sings a song about rain. "
TEXTS = [
    (1, PROSE * 3 + "Call +1 (017) 555-7713 or mail bob.42@mail8.example.com from 42.144.35.254, card 4539 1488 0343 6467."),
    (2, PROSE * 3 + "Call +1 (017) 555-7713 or mail bob.42@mail8.example.com from 42.144.35.254, card 4539 1488 0343 6467."),
    (3, None),
    (4, ""),
    (5, " \n\t \x0b\x0c\r "),
    (6, LONG),
    (7, "a"),
    (7, "a"),
    (8, "one two three four"),
    (9, "one two three four"),
    (10, "Élan ÉTÉ <|endoftext|> naïve ﬁne 漢字 😀 … Σίσυφος\x1c\x85 　x"),
    (11, "same same same same " * 40),
    (12, "1 2 3 !!! ### $$$ 4539148803436468 12.03.1987 3.0. 4.0."),
    (13, LONG + " tail"),
    (None, "a text without an id that nobody else has at all"),
    (14, "x" * 30_000),
]


def rows():
    return [(i, t, ("en", None)[k % 2], "s", None if t is None else len(t)) for k, (i, t) in enumerate(TEXTS)]


@pytest.fixture(scope="session")
def messy(spark):
    """Null, empty, blank and very long texts, repeated rows, a null id, and further columns with names that operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA)
    for name in ("n_words", "score", "found", "carried", "key", "node", "kept", "size", "packer"):
        df = df.withColumn(name, F.lit(1))
    return df.repartition(3, "n_chars").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 15)] + [(6, 1, 0), (15, None, None)], "doc_id long, quality int, toxic int")
