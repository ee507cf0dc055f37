"""Token counts of whole texts with the byte-level vocabulary, by rank-synchronous merging of ragged numpy arrays.

Batched pre-tokens lie end to end in one array with their lengths; each round applies every sequence's lowest-rank pair at
once, and the symbols that survive are counted (``bpe.merge``). Null texts are empty (0 bytes, 0 tokens); texts of any length are counted whole. An empty table
gives no rows. Every row gives
one row, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import byte_bpe, spec_of
from .common import arrow_map, col, fields, in_chunks
from .op2_bpe import vocabulary_path

#: Tokens that a document may have.
LIMIT = 1024


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(spec_of(path or vocabulary_path("byte_bpe_50k.json")))

    def run(batches):
        coder = byte_bpe(spec.value)
        for batch, texts in in_chunks(batches, "text"):
            n = coder.count(texts)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), run, fields(docs, {"doc_id": id_col}, "n_bytes long, n_tokens long, over_limit boolean"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
