import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# Columns whose names the operators use inside.
CLASH = ("node", "base", "_row", "ranges", "label", "spans", "digest", "keep_id", "_id", "_h", "th", "key", "bucket", "class_id", "_gone", "_keep_id", "score", "x", "size")


def frame(spark, rows):
    """documents with the given (doc_id, text, lang) rows and columns of clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASH)])
    return spark.createDataFrame([(d, t, lang, None, None if t is None else len(t), *["?"] * len(CLASH)) for d, t, lang in rows], schema)


PROSE = "the quick brown fox jumps over the lazy dog and then it walks home through the wet field while the sun is going down behind the hills of the old country where nobody lives any more since the great flood of last century"


@pytest.fixture(scope="session")
def edge_rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [
        (1, PROSE, "en"), (2, PROSE, "en"), (3, PROSE.replace("lazy", "idle"), None), (4, None, "en"), (5, "", "de"), (6, " \t\n ", None), (7, "123 456 !!", "fr"),
        (8, long, "de"), (9, long + " tail", "de"), (10, "a", "en"), (11, "éè 日本語 \U0001f642 é", None), (12, "the the the " * 40, "en"), (13, PROSE + "\n" + PROSE, "en"),
        (14, "write to jo.smith@mail.example.com or +44 (0)20 7946 0958, card 4111 1111 1111 1111, host 10.0.0.1 and 999.1.1.1", "en"), (None, PROSE, None), (16, "x" * 50_000, "fr"), (17, PROSE.upper(), "en"),
    ]


@pytest.fixture(scope="session")
def repeated_rows():
    """Ids that repeat, with equal and with other texts, and several null ids."""
    own = lambda name: " ".join(f"{name}{i}" for i in range(60))
    return [
        (1, own("p"), "en"), (1, own("p"), "en"), (None, own("p"), None), (None, own("q"), None), (7, own("r"), "en"), (7, own("p") + " z", "de"),
        (7, own("r"), "en"), (None, own("s"), None), (None, own("s"), None), (None, None, None), (None, None, None), (8, None, "en"), (8, "", "en"),
        (9, own("t") + " end", "en"), (9, own("t"), "en"), (9, own("t") + "  end", "en"), (3, own("u"), None), (2, own("u"), None), (2, own("u") + " ", None),
    ]


@pytest.fixture(scope="session")
def repeated(spark, repeated_rows):
    return frame(spark, repeated_rows).repartition(3).persist()


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return frame(spark, edge_rows).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
