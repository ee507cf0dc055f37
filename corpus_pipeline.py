"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. toxicity: documents predicted toxic go. 2. near duplicates: one document of each group of five-word shingle sets with a
Jaccard similarity of 0.8 or more stays. 3. repeats: 100-byte strings that start earlier are cut out. 4. decontamination:
documents that hold a benchmark item go. 5. encoding: what is left becomes token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duet.llm import op1_suffix, op2_bpe, op6_decontaminate, op9_jaccard, op10_toxicity
from duet.llm.common import materialize

STAGES = [
    ("toxicity", op10_toxicity.stage),
    ("near_duplicates", op9_jaccard.stage),
    ("repeats", op1_suffix.stage),
    ("decontamination", op6_decontaminate.stage),
    ("encoding", op2_bpe.stage),
]
#: Tagging, suffix sorting, tiling and merging are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
