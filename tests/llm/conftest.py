import pytest

from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and long texts, copies, repeated rows and a clashing column."""
    same = "The same words in the same order make the same text, however often they are told. " * 12
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, None),
        (4, same, "en", "a", len(same)),
        (5, same, "en", "b", len(same)),
        (5, same, "en", "b", len(same)),
        (None, same, None, None, None),
        (None, "lone", "de", "c", 4),
        (7, long, "en", "c", len(long)),
        (8, "Äußerst <b> ¼ 中文 🙂 é <|endoftext|> 'LL don't x", "de", "c", 1),
        (9, "a" * 3000, "fr", "c", 3000),
    ]
    return spark.createDataFrame([(*r, "theirs") for r in rows], DOCS + ", kept string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
