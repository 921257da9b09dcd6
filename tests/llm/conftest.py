import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Null, empty and blank texts, ties, repeated rows, a null doc_id, marks only.
ODD = [
    (None, "a line without an id that is long enough\nsecond", "en", "a", 1),
    (1, None, "en", None, None),
    (2, "", None, "a", 0),
    (3, "   \t\n \n", "en", "b", 6),
    (4, "!!! --- 123 ???", "en", "b", 15),
    (5, "one two three", "en", "c", 13),
    (6, "One Two Three", "en", "c", 13),
    (7, "the same words again and again and again in one line", "en", "c", 52),
    (7, "the same words again and again and again in one line", "en", "c", 52),
    (8, "İÉ ß 漢字 é   \x1c words \U0001f600 here and there <|endoftext|> end", None, "c", 40),
]


@pytest.fixture()
def make(spark):
    def build(rows):
        return spark.createDataFrame(rows, DOCS)
    return build


@pytest.fixture()
def odd(make):
    return make(ODD)


@pytest.fixture()
def clashing(odd):
    """Extra columns with the names the operators use themselves."""
    from pyspark.sql import functions as F
    names = ["row_hash", "n", "hits", "starts", "ends", "shard", "slot", "key", "bucket", "taken", "size", "score", "label", "value", "token", "component_id"]
    return odd.withColumns({x: F.lit("x") for x in names}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))


@pytest.fixture()
def empty(make):
    return make([])
