import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = "lorem ipsum dolor " * 4000
    rows = [
        (1, None, "en", None, None, "a"), (2, "", "en", "s1", 0, None), (3, "   \n\t", None, "s1", 5, "b"),
        (4, "One two three four five six seven", "en", "s2", 33, "b"), (4, "One two three four five six seven", "en", "s2", 33, "b"),
        (5, "One two three four five six seven", "en", "s3", 33, "c"), (None, "no id here at all", "en", "s1", 17, "d"),
        (7, long, "en", "s1", len(long), "e"), (8, long + "tail", "en", "s2", len(long) + 4, "e"), (9, "übergroß naïve Ωmega 😀 text", "de", "s3", 30, "f"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").withColumnsRenamed({"fp": "id"})
