"""Token counts: pre-tokens that are known whole tokens are counted directly, only the rest is merged.

Which vocabulary strings encode alone as one token is shown once per worker,
before any text is read (word_tokens.WordTokens.whole).

Null and empty texts have no bytes and no tokens. Texts of any length are
counted whole. Repeated rows are counted one by one; an empty table gives an
empty result. Columns of the input beyond the id and the text are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.llm.rows import without_cycle_search
from profseek.llm.word_tokens import word_tokens


def token_counts(df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, n_whole, over_limit): n_whole counts the tokens that needed no merging."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        for batch in without_cycle_search(batches):
            n_bytes, n_tokens, n_whole = [], [], []
            for value in batch.column(1):
                value = value.as_py() or ""
                every, whole = tokens.count(value)
                n_bytes.append(len(value.encode()))
                n_tokens.append(every)
                n_whole.append(whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array(n_whole, pa.int64())], ["id", "n_bytes", "n_tokens", "n_whole"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    counted = narrow.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, n_whole long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", "n_whole",
                          (F.col("n_tokens") > limit).alias("over_limit"))
