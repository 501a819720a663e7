import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use inside, to clash with.
    *[T.StructField(c, T.StringType()) for c in ("key", "part", "id", "bucket", "words", "n", "block", "shard", "kept", "__id")],
])


@pytest.fixture
def documents(spark):
    """documents(rows of (doc_id, text[, lang])) with all columns of the table and some that clash."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), *["x"] * 10) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(parts)

    return make


#: Nulls, empty and blank texts, repeated rows, ties, odd characters, a row without id.
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "one  two "), (7, "one  two "), (None, "no id at all"),
    (None, None), (8, "Éa ▁x \x00 <s> </s> <|endoftext|>\n\n  b"), (9, "ß" * 300), (10, "a b c " * 2000), (11, "   zero"),
    (12, "é \U0001F600 中文 text"), (13, "a b c " * 2000), (14, "x" * 20_000),
]
