import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, kept string, ids string, sequence_id string, rank string, block int, visit int, `a.b` int"


def docs_frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.5, "x", "y", "z", "q", "r", 1, 2, 3) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    passage = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions " * 8
    long = " ".join(f"word{i % 977} and" for i in range(60000))
    rows = [
        (1, passage + "first ending", "en", "a"),
        (2, passage + "second ending", "en", "a"),
        (2, passage + "second ending", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, "   \n\t ", "fr", "b"),
        (6, "12345 !!! ???", "de", "b"),
        (7, "Żółć ñandú 日本語 😀 straße", "de", None),
        (None, "a row without an id", "en", "c"),
        (None, None, None, None),
        (8, long, "en", "c"),
        (9, "word", "en", "c"),
        (10, "Bonjour le monde, ceci est un petit texte en français.", "fr", "c"),
        (10, "another text under the same id", "en", "c"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return docs_frame(spark, odd_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_frame(spark, [])
