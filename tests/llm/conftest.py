import pytest

ODD = "doc_id long, text string, digest string, node long, length long, _d long, _h long, word string, place long"


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Documents with nulls, ties, repeats, empty and long texts, and columns whose names operators use inside."""
    def make(texts: list[tuple[int | None, str | None]]):
        return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, "w", 5) for i, t in texts], ODD)
    return make
