"""Reading and writing the tables of a study: explicit schemas, optional sources, incremental intake, a restricted sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMAS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and, possibly, a byte order mark; empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header that begins with a byte order mark, in each file."""
    first, *others = df.columns
    df = df.toDF("\ufeff" + first, *others)
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_nested(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Recogniser or speaker files of nested JSON, one document a file; kind is a key of SCHEMAS."""
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", True).json(path)


def write_nested(df: DataFrame, path: str, by: str = "session_id") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def asr_words(asr: DataFrame) -> DataFrame:
    """session_id, seg, pos, w, s, e, p of every word that lasts."""
    seg = asr.select("session_id", F.posexplode("segments").alias("seg", "x"))
    return seg.select("session_id", "seg", F.posexplode("x.words").alias("pos", "y")).select("session_id", "seg", "pos", "y.*").where("e > s")


def diarized_words(diar: DataFrame) -> DataFrame:
    return diar.select("session_id", F.posexplode("words").alias("pos", "x")).select("session_id", "pos", "x.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several Parquet tables that exists."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


def unprocessed(source: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in the output yet."""
    return source.join(done.select(*keys).distinct(), keys, "left_anti")


def split_restricted(df: DataFrame, private: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(public, restricted): the private columns leave the public table and keep only the key with them."""
    return df.drop(*private), df.select(key, *private)


def write_restricted(df: DataFrame, private: list[str], key: str, public: str, restricted: str) -> None:
    """The public columns to one folder and the private ones, with the key, to another that mustn't lie within it."""
    if f"{restricted.rstrip('/')}/".startswith(f"{public.rstrip('/')}/"):
        raise ValueError("the restricted folder lies within the public one")
    for part, path in zip(split_restricted(df, private, key), (public, restricted)):
        part.write.mode("overwrite").parquet(path)


def present(df: DataFrame, names: list[str] = (), prefixes: tuple[str, ...] = ()) -> list[str]:
    """Of the named columns, and of those with a prefix, the ones that the table has, in its order."""
    return [c for c in df.columns if c in names or (prefixes and c.startswith(tuple(prefixes)))]


def landing(df: DataFrame, names: dict[str, str], suffix: str = "", only: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed as far as present, then ``suffix`` put to those in ``only``."""
    df = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
    return df.withColumnsRenamed({c: c + suffix for c in only if c in df.columns})


def lookup(files: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(files with what is known by their key, files that nothing is known of, those without a key too)."""
    return files.join(known, key), files.join(known.select(key).distinct(), key, "left_anti")


def debug_limit(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)
