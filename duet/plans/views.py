"""The same operators from SQL text: temporary views of the tables and of the main derived frames, and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import edit_counts, words
from ..sources.tables import table
from .catalog import EXCLUDED, ORACLE, events, fused, query

TABLES = ("events", "conversations", "documents", "labels", "customer", "orders", "lineitem", "embeddings", "pages", "benchmark", "part", "supplier", "nation", "region")

TOPIC_EMOTION = """SELECT topic, count(*) AS n, round(avg(fused_valence), 4) AS mean_valence, round(avg(fused_arousal), 4) AS mean_arousal, sum(discord_flag) AS n_discord
FROM fused WHERE topic <> '{excluded}' GROUP BY topic"""


def _word_errors(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_counts(words(x), words(y))[0] for x, y in zip(a, b)], dtype="int32")


def register(spark: SparkSession, folder: str) -> None:
    """Views of the tables, and ``timeline`` and ``fused`` made of ``events``; functions ``word_errors`` and ``role_letter``."""
    for t in TABLES:
        table(spark, folder, t).createOrReplaceTempView(t)
    events(spark, folder).createOrReplaceTempView("timeline")
    fused(spark, folder).createOrReplaceTempView("fused")
    spark.udf.register("word_errors", F.pandas_udf(_word_errors, "int"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION role_letter(r STRING) RETURNS STRING RETURN nullif(upper(substring(r, 1, 1)), '')")


def register_function(spark: SparkSession, name: str, function, returns: str) -> None:
    """A function of one's own for SQL, on pandas series (a batch at a time, never a row)."""
    spark.udf.register(name, F.pandas_udf(function, returns))


def run(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    register(spark, folder)
    return spark.sql(sql)


@query("sql_topic_emotion", ORACLE["flagship_topic_emotion"])
def _(spark, d):
    return run(spark, d, TOPIC_EMOTION.format(excluded=EXCLUDED))


@query("sql_role_lengths", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def _(spark, d):
    return run(spark, d, "SELECT role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY role")


@query("unpivot_measures", "SELECT l_orderkey, l_linenumber, measure, x FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem) UNPIVOT (x FOR measure IN (l_quantity, l_discount))")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_discount").cast("double").alias("l_discount"))
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"], "measure", "x")
