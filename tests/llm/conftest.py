import pytest
from pyspark.sql import functions as F

#: Columns that docs may have besides their own, with names that operators use inside.
CLASHING = ["id", "t", "n", "row", "size", "rn", "part", "k_id", "spans", "label", "range", "first", "copies", "key0", "made"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and long texts, repeated rows, ids that are null or repeat, and columns of clashing names."""
    prose = " ".join(f"word{i % 97} follows{i % 89} another{i}" for i in range(40))
    rows = [
        (1, prose, "en", "a"),
        (2, prose, "en", "a"),
        (2, prose, "en", "a"),
        (3, prose + " tail", "en", None),
        (4, None, None, "b"),
        (5, "", "en", "b"),
        (6, " \n\t ", "fr", "b"),
        (7, "one two", "fr", "c"),
        (8, "ONE two", "fr", "c"),
        (9, "!!! ... 123 <|endoftext|> don't", "de", "c"),
        (10, "long " * 30_000 + "éÀ words. Next one! " * 2_000, "de", "c"),
        (11, "x" * 50_000, "de", None),
        (12, "line one of the text that is here\nline two of the text that is here\n\nend", "en", "a"),
        (12, "another text of the same id", "en", "a"),
        (None, "no id here", "en", "a"),
        (None, prose, "en", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2)
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select("*", *(F.lit("x").alias(name) for name in CLASHING))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
