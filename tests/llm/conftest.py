import pytest

from tablescope.llm.common import share_code


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    share_code(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, tiny and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
    near = " ".join(f"alpha{i}" for i in range(40))
    rows = [(1, "One two three four five six.\nAnother line of this text here.", "en", "a"),
            (2, "one TWO three four five six.\nANOTHER line of this text here.", "en", "a"),
            (3, None, "en", "b"), (4, "", None, "b"), (5, " \n\t ", "en", None),
            (6, "12 34 --", None, None), (7, "Ü", "de", "a"), (8, long, "en", "a"),
            (9, long, "en", "c"), (9, long, "en", "c"), (None, "Null id text, with some words.", "fr", "c"),
            (10, near, "en", "d"), (11, near + " omega", "en", "d"), (12, "Ü", "de", "a")]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    for name in ("kept", "keep_id", "size", "n_removed", "lang_pred", "component_id", "id", "key", "_n"):
        df = df.selectExpr("*", f"'extra' as {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
