import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today " * 4, "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today " * 4, "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "de", "b", 0),
    (6, "Der alte Hund schläft am Fluss und der Fuchs springt über ihn hinweg heute", "de", "", 5),
    (7, "§§ 123 !!", "fr", "b", 2),
    (None, "a text without a key that is otherwise quite plain and has enough words", "en", "a", 3),
    (9, "word " * 30_000, "en", "long", 4),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today " * 4, "en", "a", 1),
    (11, "x", "es", "c", 1),
]
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "score double, _h string, spans string")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, ties, repeated rows and columns with clashing names."""
    return spark.createDataFrame([(*r, 0.5, "h", "s") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (4, 0, 1), (6, 1, 0), (7, 0, 1), (None, 1, 1), (9, None, None)],
        "doc_id bigint, quality int, toxic int")
