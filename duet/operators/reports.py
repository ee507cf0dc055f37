"""Quality checks and worksheets, demographics, reconciliation, and the comparison of two coding schemes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_number
from .stats import agreement, corr, group_quantiles
from .timeline import context


def corr_checks(df: DataFrame, pairs: list[tuple[str, str, str]], least: int = 4) -> DataFrame:
    """For each (x, y, expected): r, n and a verdict; where ``positive`` is expected and r isn't, ``CHECK ALIGNMENT``."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(e).alias("expected"), F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")) for x, y, e in pairs])).alias("p")).select("p.*")
    out = rows.where("a is not null and b is not null").groupBy("x", "y", "expected").agg(corr("a", "b", least).alias("r"), F.count("*").alias("n"))
    fine = (F.col("expected") != "positive") | F.coalesce(F.col("r") > 0, F.lit(False))
    return out.withColumn("verdict", F.when(fine, "OK").otherwise("CHECK ALIGNMENT"))


def top_k(df: DataFrame, value: str, k: int, tie: str, largest: bool = True) -> DataFrame:
    """The k rows with the extreme values; of equals those that come first by ``tie``."""
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(value) if largest else F.asc(value), tie).limit(k)


def listening_sheet(df: DataFrame, by: list[str], order: list[str], role: str, text: str, value: str, tie: str, k: int = 30) -> DataFrame:
    """The k rows of highest value with their context and blank columns for a listener."""
    return top_k(context(df, by, order, role, text), value, k, tie).withColumns({"heard_emotion": F.lit(""), "agrees": F.lit("")})


#: Occupations and their groups; any other that isn't empty is pooled.
OCCUPATIONS = {"Nurse": "Nursing", "Physician": "Physician", "Social Worker": "Social work", "Security": "Security", "Pharmacist": "Pharmacy & research", "EMED RA": "Pharmacy & research"}
POOLED = "Pharmacy & research"


def pool_groups(df: DataFrame, column: str, groups: dict[str, str] = OCCUPATIONS, pooled: str = POOLED, name: str = "group") -> DataFrame:
    value, out = F.trim(F.col(column).cast("string")), F.lit(pooled)
    for k, v in groups.items():
        out = F.when(value == k, v).otherwise(out)
    return df.withColumn(name, F.when(value.isNotNull() & (value != ""), out))


def normalise_demographics(df: DataFrame, participant: str, occupation: str, years: dict[str, str], areas: list[str], contact: str) -> DataFrame:
    """Ids to PN and three digits, years as numbers, occupations pooled, areas as 0 or 1, and the contact flag."""
    digits = F.regexp_replace(F.upper(F.col(participant).cast("string")), "[^0-9]", "")
    out = pool_groups(df, occupation, name="occupation_category")
    out = out.withColumn("participant_id", F.when(digits != "", F.concat(F.lit("PN"), F.lpad(digits, 3, "0"))))
    out = out.withColumns({new: first_number(F.col(old).cast("string")) for old, new in years.items()})
    out = out.withColumns({f"area_{a}": F.coalesce(F.upper(a) == "Y", F.lit(False)).cast("int") for a in areas})
    return out.withColumn("direct_peer_contact", F.coalesce(F.lower(F.trim(contact)) == "yes", F.lit(False)))


def group_counts(df: DataFrame, group: str, least: int = 5) -> DataFrame:
    """Group sizes, and whether a group is large enough for a test."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).withColumn("testable", F.col("n") >= least)


def scheme_compare(df: DataFrame, a: str, b: str, flag_a: str, flag_b: str) -> dict[str, DataFrame]:
    """Correlation and agreement of two schemes' ratings, and the crosstab of their flags."""
    return {"agreement": agreement(df, a, b), "crosstab": df.groupBy(flag_a, flag_b).agg(F.count("*").alias("n"))}


def repeat_consistency(first: DataFrame, second: DataFrame, key: str, rating: str) -> DataFrame:
    """Agreement of two runs over the same rows."""
    both = first.select(key, F.col(rating).alias("run1")).join(second.select(key, F.col(rating).alias("run2")), key)
    return agreement(both, "run1", "run2")


def low_coverage(df: DataFrame, coverage: str = "coverage", least: float = 0.6) -> DataFrame:
    return df.where(F.col(coverage) < least)


def frame_percentiles(df: DataFrame, by: list[str], power: str) -> DataFrame:
    """Per group of frames: number, level of the loudest, RMS level, signal-to-noise estimate and speech share."""
    db = lambda x, k: k * F.log10(F.greatest(x, F.lit(1e-12)))
    q = F.broadcast(group_quantiles(df, by, power, [0.1, 0.95]))  # a row for each group
    speech = (F.col(power) >= F.greatest(F.col("q")[0], F.lit(1e-12)) * 10**1.2).cast("double")
    rows = df.join(q, by).groupBy(*by).agg(F.count("*").alias("n"), F.max(power).alias("__max"), F.avg(power).alias("__mean"), F.first("q").alias("__q"), F.avg(speech).alias("speech_frac"))
    return rows.select(*by, "n", db(F.col("__max"), 10).alias("peak_db"), db(F.col("__mean"), 10).alias("rms_db"), (db(F.col("__q")[1], 10) - db(F.col("__q")[0], 10)).alias("snr_est_db"), "speech_frac")


def cosine_topk(df: DataFrame, by: str, id_col: str, unit: str, k: int = 3, block: int = 2048) -> DataFrame:
    """Within each group the k other rows with the highest cosine to each row, of equals (to nine digits) the smaller ids.

    Exact for groups of any size: a group is cut into blocks of about ``block`` rows by a hash of the id, each pair of blocks is one
    matrix product in a task of its own, and only the k best of each row leave it. Rows without a group or vector take no part.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(unit).isNotNull()).select(by, F.col(id_col).alias("id"), F.col(unit).alias("x"))
    blocks = rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(blocks, by).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = rows.select(by, F.col("own").alias("p"), F.col("other").alias("q"), "id", "x")
    right = rows.select(F.col(by).alias("__by"), F.col("other").alias("p"), F.col("own").alias("q"), F.col("id").alias("id2"), F.col("x").alias("y"))

    def best(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({by: [], "a": [], "b": [], "cosine": []})
        b = b.sort_values("id2", kind="stable")
        ours, theirs = a["id"].to_numpy(), b["id2"].to_numpy()
        cosine = np.stack(a["x"].to_numpy()) @ np.stack(b["y"].to_numpy()).T
        cosine[ours[:, None] == theirs[None]] = -np.inf
        at = np.argsort(-np.round(cosine, 9), axis=1, kind="stable")[:, :k]  # ties stay in the order of the ids
        found = pd.DataFrame({"a": np.repeat(ours, at.shape[1]), "b": theirs[at].ravel(), "cosine": np.take_along_axis(cosine, at, 1).ravel()})
        found.insert(0, by, key[0])
        return found[np.isfinite(found["cosine"])]

    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    near = left.groupBy(by, "p", "q").cogroup(right.groupBy("__by", "p", "q")).applyInPandas(best, f"{by} {kind[by]}, a {kind[id_col]}, b {kind[id_col]}, cosine double")
    n = F.row_number().over(Window.partitionBy(by, "a").orderBy(F.desc(F.round("cosine", 9)), "b"))
    return near.withColumn("rank", n.cast("long")).where(F.col("rank") <= k)
