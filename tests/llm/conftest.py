import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside, as further columns of their input.
CLASHES = ("rep", "bands", "part", "key", "slot", "run", "score", "host", "found", "spans", "features", "doc", "anchor", "_id", "_kept_doc_id", "_all", "n", "text_sha256")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Rows of every awkward kind: nulls, empty, repeated, tied, very long, odd characters."""
    long_text = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, same), (5, same.upper()), (6, same), (6, same), (7, long_text), (8, long_text + " end"), (9, "x" * 50_000),
        (None, "lost words here"), (None, None), (10, "né à l'été 😀 \u2028 x@y.org 10.0.0.1"), (11, "short"), (12, "idiot"), (13, "a\0b\x1cc <|endoftext|>"),
    ]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
