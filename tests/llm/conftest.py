import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _file string, key string"
WORDS = "the quick brown fox jumps over a lazy dog and runs far away from all the noise of town".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and names that clash with inner ones."""
    long_text = sentence(3, 30000)
    near = sentence(5, 200)
    rows = [
        (1, "", "en", "a", 0, 5, "f", "k"),
        (2, None, None, None, None, None, None, None),
        (None, "no id here", "en", "a", 10, 1, "f", "k"),
        (None, "no id here", "en", "a", 10, 1, "f", "k"),
        (3, long_text, "de", "a", len(long_text), 1, "f", "k"),
        (4, "same  text", "en", "a", 10, 1, "f", "k"),
        (5, "same text", "en", "b", 9, 1, "f", "k"),
        (6, "same\ttext ", "en", "b", 10, 1, "f", "k"),
        (7, near, "en", "b", len(near), 1, "f", "k"),
        (8, near + " extra", "en", "b", len(near), 1, "f", "k"),
        (8, near + " extra", "en", "b", len(near), 1, "f", "k"),
        (9, "x", "fr", "c", 1, 1, "f", "k"),
        (10, "日本語 ▁ é́ 🙂 \u0000 end", "ja", "c", 1, 1, "f", "k"),
        (11, " lead and trail \n\n", "en", "c", 1, 1, "f", "k"),
    ]
    return rows + [(100 + i, sentence(i, 5 + i % 40), "en", "hot" if i % 3 else "cold", 1, 1, "f", "k") for i in range(60)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
