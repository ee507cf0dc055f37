"""Fusion of a measured and a text channel, discord between them, sensitivity to the weight, and annotation samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import WEIGHTS
from .stats import quantile_bins
from .timeline import dedupe_first


def analysable(role: str = "speaker_role", backchannel: str = "is_backchannel") -> Column:
    """The one predicate of rows that count: a participant's, and no backchannel."""
    return (F.col(role) == "participant") & (F.col(backchannel) == 0)


def backchannel(duration: str = "duration_s", words: str = "n_words") -> Column:
    return F.when((F.col(duration) < 1.0) | (F.col(words) < 3), 1).otherwise(0)


def fuse(df: DataFrame, ac: str = "ac_z", tx: str = "tx_z", arousal: str = "ar_z", wa: float = 0.5, ok: Column | None = None) -> DataFrame:
    """fused_valence = wa * ac + (1 - wa) * tx and fused_arousal, on analysable rows, else null."""
    keep = (F.lit(True) if ok is None else ok) & F.col(ac).isNotNull() & F.col(tx).isNotNull()
    return df.withColumns({"fused_valence": F.when(keep, wa * F.col(ac) + (1 - wa) * F.col(tx)), "fused_arousal": F.when(keep, F.col(arousal))})


def discord(df: DataFrame, ac: str = "ac_z", tx: str = "tx_z", thresh: float = 0.5, ok: Column | None = None) -> DataFrame:
    """discord_flag where the channels have opposite signs and both are strictly beyond ``thresh``; the type follows the text's sign."""
    flag = (F.signum(ac) != F.signum(tx)) & (F.abs(ac) > thresh) & (F.abs(tx) > thresh) & (F.lit(True) if ok is None else ok)
    flag = F.coalesce(flag, F.lit(False))
    kind = F.when(~flag, "").when(F.col(tx) > 0, "positive_words_flat_voice").otherwise("negative_words_bright_voice")
    return df.withColumns({"discord_flag": flag.cast("int"), "discord_type": kind})


def fusion_sensitivity(df: DataFrame, topic: str, excluded: str, ac: str = "ac_z", tx: str = "tx_z", weights: tuple[float, ...] = WEIGHTS, base: float = 0.5, topics: list[str] = ()) -> DataFrame:
    """For each weight: correlation with the base weight over all rows, the highest and lowest topic by mean, the excluded left out, and the
    means of the named ``topics`` as columns. One pass: all follow from the channels' moments and their means by topic."""
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(w,) for w in weights], "wa double"))
    both = df.where(F.col(ac).isNotNull() & F.col(tx).isNotNull())
    x, y = F.col(ac).cast("double"), F.col(tx).cast("double")
    parts = both.groupBy(topic).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    n = F.sum("n")
    mean = lambda m: F.sum(F.col("n") * F.col(m)) / n
    cov = lambda v, a, b: F.sum(F.col("n") * (F.col(v) + F.col(a) * F.col(b))) / n - mean(a) * mean(b)
    whole = parts.agg(n.alias("rows"), cov("vx", "mx", "mx").alias("vx"), cov("vy", "my", "my").alias("vy"), cov("c", "mx", "my").alias("c"))
    wa = F.col("wa")
    var = lambda w: w * w * F.col("vx") + 2 * w * (1 - w) * F.col("c") + (1 - w) * (1 - w) * F.col("vy")
    w0 = F.lit(base)
    with_base = wa * w0 * F.col("vx") + (wa * (1 - w0) + (1 - wa) * w0) * F.col("c") + (1 - wa) * (1 - w0) * F.col("vy")
    spread = var(wa) * var(w0)
    r = whole.crossJoin(table).select("wa", F.when((F.col("rows") >= 2) & (spread > 0), with_base / F.sqrt(spread)).alias("corr_with_default"))
    means = parts.where(F.col(topic) != excluded).crossJoin(table).select("wa", topic, (wa * F.col("mx") + (1 - wa) * F.col("my")).alias("m"))
    named = [F.max(F.when(F.col(topic) == t, F.col("m"))).alias(f"mean_{t}") for t in topics]
    ends = means.groupBy("wa").agg(F.min(F.struct((-F.col("m")).alias("k"), F.col(topic).alias("topic"))).alias("hi"), F.min(F.struct(F.col("m").alias("k"), F.col(topic).alias("topic"))).alias("lo"), *named)
    return r.join(ends, "wa").select("wa", "corr_with_default", F.col("hi.topic").alias("most_positive"), F.col("lo.topic").alias("most_negative"), (-F.col("hi.k")).alias("max_mean"), F.col("lo.k").alias("min_mean"), *[f"mean_{t}" for t in topics])


def sampling_key(id_col: str, seed: int) -> Column:
    """An order that looks random and is the same in every engine."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")).cast("binary"))


def stratified_sample(df: DataFrame, strata: list[str], target: int, id_col: str, seed: int = 7) -> DataFrame:
    """max(1, target // number of strata) rows of each stratum, in sampling order."""
    per = df.select(*strata).distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(target) / F.nullif(F.count("*"), F.lit(0)))).alias("__per"))
    n = F.row_number().over(Window.partitionBy(*strata).orderBy(sampling_key(id_col, seed), id_col))
    return df.withColumn("__n", n).crossJoin(F.broadcast(per)).where("__n <= __per").drop("__n", "__per")


def forced_sample(sampled: DataFrame, forced: DataFrame, target: int, id_col: str, seed: int = 11) -> DataFrame:
    """All forced rows, and of the sampled others as many, in sampling order, as reach the target."""
    ids = forced.select(id_col).distinct()
    room = max(0, target - ids.count())
    others = dedupe_first(sampled.join(ids, id_col, "left_anti").select(*sampled.columns), [id_col], [sampling_key(id_col, seed)])
    return dedupe_first(forced, [id_col], [sampling_key(id_col, seed)]).unionByName(others.orderBy(sampling_key(id_col, seed), id_col).limit(room))


def capped_sample(df: DataFrame, most: int, id_col: str, seed: int = 3) -> DataFrame:
    """At most ``most`` rows, the first in sampling order."""
    return df.orderBy(sampling_key(id_col, seed), id_col).limit(most)


def annotation_sample(df: DataFrame, session: str, topic: str, value: str, flag: str, id_col: str, target: int = 400, seed: int = 7) -> DataFrame:
    """Rows to be rated: spread over session, topic and value tercile, all discordant rows in, with blank rater columns."""
    binned = quantile_bins(df, value)
    chosen = forced_sample(stratified_sample(binned, [session, topic, "val_bin"], target, id_col, seed), binned.where(F.col(flag) == 1), target, id_col, seed)
    blank = ["rater1_valence", "rater1_arousal", "rater1_notes", "rater2_valence", "rater2_arousal", "rater2_notes", "consensus"]
    return chosen.withColumns({c: F.lit("") for c in blank})
