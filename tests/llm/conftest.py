import pytest
from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and very long texts, ties and repeated rows.
HARD = [
    (1, "The cat sat on the mat and the dog lay by the door of the house.", "en", "s0", 60),
    (2, "The cat sat on the mat and the dog lay by the door of the house.", "en", "s0", 60),
    (2, "The cat sat on the mat and the dog lay by the door of the house.", "en", "s0", 60),
    (3, None, "en", "s0", None),
    (4, "", None, None, 0),
    (None, "Nobody knows the number of this one, which has eleven words here.", "en", "s1", 5),
    (None, None, None, None, None),
    (9007199254740993, "Ein Haus am See ist schön und groß.\n\nEin Haus am See ist schön und groß.", "de", "s1", 70),
    (6, "word " * 60_000, "en", "s0", 300_000),
    (7, " \t\r\n\x0b\x0c ", "fr", "s2", 7),
    (8, "12345 67890 !!! ???", "es", "s2", 19),
    (-5, "a", "es", "s2", 1),
]
EXTRA = "fp long, key string, id long, pos long, line string, comp long, length long, a long, n int, `__id` long, word string, found int, ids string, rank int, mark long"


@pytest.fixture(scope="session")
def hard(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HARD, DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(hard: DataFrame) -> DataFrame:
    """The same rows with columns named as the operators' own."""
    names = [part.strip().rsplit(" ", 1) for part in EXTRA.split(",")]
    return hard.selectExpr("*", *[f"cast(null as {kind}) as {name}" for name, kind in names])


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCUMENTS)
