import os

import pytest
from pyspark.sql import types as T

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("words", T.StringType()),
                     T.StructField("row", T.StringType()), T.StructField("id", T.StringType())])


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def docs(spark):
    """Documents from (id, text) or (id, text, source), with extra columns whose names operators use themselves."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "w", "r", "i") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def sample_texts():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, source FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()


#: Empty, null, white space only, repeated, very long, and outside the first plane.
ODD_TEXTS = [None, "", " \t\n ", "a", "a", "x" * 70_000, "one two " * 9_000, "é́ ΑΣ Σ İ \U0001f600 <|endoftext|> it's",
             "\x1c\x85  ₝ 1½2", "\r\n\r\n"]
