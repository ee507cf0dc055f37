"""BPE encoding and decoding of whole texts, by batched numpy merge rounds (see bpe.py).

Null texts count as empty; empty texts give no ids; texts of any length are coded whole. An empty table gives no rows. Every row gives one row, repeated rows included, in any order; further
columns of the input, whatever their names, are ignored by ``encode`` and kept by the pipeline stage's own projection.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import spec_of, word_bpe
from .common import arrow_map, col, fields, in_chunks, stage_scratch

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = True, raw: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32 bytes), decoded text; ``raw=False`` gives SHA-256 digests of the two instead."""
    spec = docs.sparkSession.sparkContext.broadcast(spec_of(path or vocabulary_path()))

    def run(batches):
        coder = word_bpe(spec.value)
        for batch, texts in in_chunks(batches, "text"):
            ids, counts = coder.encode(texts)
            back = coder.decode(ids, counts) if decoded else [None] * len(texts)
            data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
            parts = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
            if raw:
                out = [pa.array(parts, pa.binary()), pa.array([None if b is None else b.decode() for b in back], pa.string())]
            else:
                out = [pa.array([hashlib.sha256(p).hexdigest() for p in parts]), pa.array([hashlib.sha256(b).hexdigest() if b is not None else None for b in back], pa.string())]
            names = ["ids", "decoded"] if raw else ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *out], ["doc_id", "n_tokens", *names])

    tail = "ids binary, decoded string" if raw else "ids_sha256 string, decoded_sha256 string"
    return arrow_map(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), run, fields(docs, {"doc_id": id_col}, f"n_tokens long, {tail}"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and the digest of what they decode to."""
    stage_scratch(spark)
    coded = encode(docs)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), raw=False)
