import pytest
from pyspark.sql import Row

DOCS = "doc_id bigint, text string, lang string, source string, score double, size string, spans string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows and columns that clash with results."""
    base = " ".join(f"word{i} the and of" for i in range(60)) + ".\nIt ends here."
    near = base.replace("word30 ", "other ")
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "en", "b"),
        (4, None, "en", "b"),
        (5, "", None, None),
        (6, "Released under the MIT License.", "en", "c"),
        (7, " \t\n", "en", None),
        (8, "und der die das " * 30000, "de", "a"),
        (8, "und der die das " * 30000, "de", "a"),
        (None, near + " x", None, "b"),
        (9, "12 34 %%% ###", "en", "d"),
        (10, "one two three", "en", "a"),
        (11, "one two three", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 0.5, "s", "x") for r in rows], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def result():
    def collect(df) -> list[Row]:
        return df.collect()

    return collect
