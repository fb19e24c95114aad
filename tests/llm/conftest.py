import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def clashing(spark):
    """Adds columns named like those the operators use inside."""
    def add(df):
        from pyspark.sql import functions as F
        return df.select("*", *(F.lit("x").alias(n) for n in (
            "data", "fp", "digest", "first", "n", "row", "count", "items", "spans", "ids", "bits", "kept",
            "component_id", "text_sha256") if n not in df.columns))
    return add


#: Null, empty, blank, long, equal and repeated rows, and a null id.
ODD = [(3, None), (1, ""), (2, " \t\n"), (7, "one"), (7, "one"), (5, "one two three four"), (4, "one two three four"),
       (None, "one two three four"), (None, None), (9, "word " * 30_000), (8, "é ß 日本 😀"), (6, "!!! ???")]


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD)
