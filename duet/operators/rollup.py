"""From utterances to topics to people, prevalence by distinct person, contrasts, and the frames behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import t_test_1samp
from .timeline import dedupe_first


def prop_negative(stance: str = "stance") -> Column:
    """Share of negative rows among all rows of the group; null where no row has a stance."""
    negative = F.coalesce(F.col(stance) == "negative", F.lit(False)).cast("double")
    return F.when(F.count(stance) > 0, F.avg(negative))


def top_labels(df: DataFrame, by: list[str], label: str, k: int = 3, sep: str = "|", name: str = "dominant") -> DataFrame:
    """The ``k`` commonest labels of each group joined by ``sep``; of equal counts the smaller label first."""
    counts = df.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(*by, label).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by).orderBy(F.desc("__c"), label)
    top = counts.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
    return top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", label))), lambda x: x[label]), sep).alias(name))


def topic_level(df: DataFrame, person: str, topic: str, duration: str, stance: str = "stance", code: str | None = None, valence: str = "tx_z") -> DataFrame:
    """One row for each person and topic: counts, talk time, means and deviations, shares, and the dominant codes."""
    rows = df.where(F.col(person).isNotNull() & F.col(topic).isNotNull())
    out = rows.groupBy(person, topic).agg(
        F.count("*").alias("n_utt"), F.sum(duration).alias("talk_time_s"), F.avg("fused_valence").alias("mean_valence"), F.stddev_samp("fused_valence").alias("sd_valence"),
        F.avg("fused_arousal").alias("mean_arousal"), F.stddev_samp("fused_arousal").alias("sd_arousal"), F.avg(valence).alias("mean_tx_valence"), prop_negative(stance).alias("prop_negative"), F.avg(F.col("discord_flag").cast("double")).alias("prop_discord"),
    )
    return out.join(top_labels(rows, [person, topic], code, name="dominant_codes"), [person, topic], "left") if code else out


def participant_level(df: DataFrame, person: str, topic: str, duration: str, base: str, excluded: str, shifts: list[str], code: str = "code", arousal: str | None = None) -> DataFrame:
    """One row for each person, with the spread, the number of distinct codes, the most emotional topic, the shifts of topics against ``base``, and that of
    the topic ``arousal`` in arousal."""
    rows = df.where(F.col(person).isNotNull())
    spread = F.percentile("fused_arousal", F.array(F.lit(0.9), F.lit(0.1)))
    total = rows.groupBy(person).agg(
        F.count("*").alias("n_utt"), (F.sum(duration) / 60).alias("talk_time_min"), F.avg("fused_valence").alias("overall_mean_valence"), F.avg("fused_arousal").alias("overall_mean_arousal"),
        spread.alias("__q"), F.stddev_samp("fused_valence").alias("valence_sd"), F.avg(F.col("discord_flag").cast("double")).alias("prop_discord"), F.count_distinct(topic).alias("n_topics"), F.count_distinct(code).alias("n_distinct_codes"),
    )
    total = total.withColumn("arousal_range", F.col("__q")[0] - F.col("__q")[1]).drop("__q")
    means = rows.where(F.col(topic) != excluded).groupBy(person, topic).agg(F.avg("fused_valence").alias("m"), F.avg(F.abs("fused_valence")).alias("strength"))
    most = means.groupBy(person).agg(F.min(F.struct((-F.col("strength")).alias("k"), F.col(topic).alias("topic"))).alias("x")).select(person, F.col("x.topic").alias("most_emotional_topic"))
    wide = means.groupBy(person).pivot(topic, [base, *shifts]).agg(F.first("m"))
    wide = wide.select(person, *[(F.col(f"`{s}`") - F.col(f"`{base}`")).alias(f"shift_{s}_vs_{base}") for s in shifts])
    if arousal:
        of = lambda t: F.avg(F.when(F.col(topic) == t, F.col("fused_arousal")))
        total = total.join(rows.groupBy(person).agg((of(arousal) - of(base)).alias(f"arousal_shift_{arousal}")), person, "left")
    return total.join(most, person, "left").join(wide, person, "left")


def topic_shifts(df: DataFrame, person: str, topic: str, value: str, base: str, others: list[str]) -> DataFrame:
    """(contrast, person, shift): a person's mean on a topic less the mean on ``base``; one value a person."""
    wide = df.where(F.col(person).isNotNull()).groupBy(person).pivot(topic, [base, *others]).agg(F.avg(value))
    stack = F.array(*[F.struct(F.lit(f"{o}_vs_{base}").alias("contrast"), (F.col(f"`{o}`") - F.col(f"`{base}`")).alias("shift")) for o in others])
    return wide.select(person, F.explode(stack).alias("x")).select("x.contrast", person, "x.shift")


def topic_shift_tests(df: DataFrame, person: str, topic: str, value: str, base: str, others: list[str]) -> DataFrame:
    return t_test_1samp(topic_shifts(df, person, topic, value, base, others), "contrast", "shift")


def explode_codes(df: DataFrame, codes: str, sep: str = "|", name: str = "code_id") -> DataFrame:
    """A row for each label of a joined label string; null and empty strings have none."""
    return df.withColumn(name, F.explode(F.when(F.col(codes) != "", F.split(F.col(codes), f"[{sep}]"))))  # no filter, as it would score texts twice


def code_frequency(df: DataFrame, person: str, code: str, people: DataFrame | None = None) -> DataFrame:
    """Mentions, distinct people and their percentage of all distinct people, for each code."""
    everyone = (people if people is not None else df).agg(F.count_distinct(person).alias("__all"))
    out = df.where(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n_mentions"), F.count_distinct(person).alias("n_people"))
    return out.crossJoin(F.broadcast(everyone)).withColumn("pct_people", 100 * F.try_divide(F.col("n_people"), F.col("__all"))).drop("__all")


def code_by_group(coded: DataFrame, people: DataFrame, person: str, code: str, group: str) -> DataFrame:
    """For every code and group: how many people of the group said it, of how many, as ``said/pool`` too.

    Codes and groups are small controlled vocabularies; only these are crossed.
    """
    pool = people.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(person).alias("pool"))
    said = coded.join(people.select(person, group).distinct(), person).groupBy(code, group).agg(F.count_distinct(person).alias("said"))
    grid = said.select(code).distinct().crossJoin(pool)  # the same aggregate again, so its exchange is used twice
    out = grid.join(said, [code, group], "left").withColumn("said", F.coalesce("said", F.lit(0)).cast("long"))
    return out.withColumn("cell", F.concat_ws("/", F.col("said").cast("string"), F.col("pool").cast("string")))


def topic_emotion_summary(df: DataFrame, topic: str, excluded: str | None = None) -> DataFrame:
    rows = df.where(F.col(topic) != excluded) if excluded else df
    return rows.where(F.col("fused_valence").isNotNull()).groupBy(topic).agg(
        F.count("*").alias("n"), F.avg("fused_valence").alias("mean_valence"), F.avg("fused_arousal").alias("mean_arousal"), F.sum("discord_flag").cast("long").alias("n_discord")
    )


def arc(df: DataFrame, person: str, topic: str, bin_: str, value: str, least: int = 5, z: float = 1.96) -> DataFrame:
    """Mean of people's means in each topic and bin, with a 95 % interval, where at least ``least`` people have rows."""
    means = df.groupBy(topic, bin_, person).agg(F.avg(value).alias("m"))
    out = means.groupBy(topic, bin_).agg(F.count("*").alias("n_people"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd")).where(F.col("n_people") >= least)
    half = z * F.col("sd") / F.sqrt(F.col("n_people").cast("double"))
    return out.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def theme_prevalence(coded: DataFrame, person: str, code: str, least: int = 2) -> DataFrame:
    """Figure frame: themes that at least ``least`` people bring up."""
    return code_frequency(coded, person, code).where(F.col("n_people") >= least)


def require_coverage(coded_people: int, people: int, least: float = 0.9) -> None:
    """Refuse prevalence figures while too few people are coded."""
    if coded_people < least * people:
        raise ValueError(f"only {coded_people} of {people} people are coded")


def stance_shares(df: DataFrame, person: str, stance: str, skip: str = "na") -> DataFrame:
    """Figure frame: pooled share of each stance, and the mean of people's own shares."""
    rows = df.where(F.col(stance).isNotNull() & (F.col(stance) != skip))
    each = rows.groupBy(person, stance).agg(F.count("*").alias("c"))
    each = each.withColumn("own", F.col("c") / F.sum("c").over(Window.partitionBy(person)))
    people = rows.agg(F.count_distinct(person).alias("people"), F.count("*").alias("rows"))
    return each.groupBy(stance).agg(F.sum("c").alias("c"), F.sum("own").alias("own")).crossJoin(F.broadcast(people)).select(stance, (F.col("c") / F.col("rows")).alias("pooled"), (F.col("own") / F.col("people")).alias("per_person"))


def mostly_positive(df: DataFrame, person: str, stance: str, value: str = "positive", skip: str = "na", least: float = 0.5) -> DataFrame:
    """Figure frame: how many people say ``value`` in more than ``least`` of their rows, and of how many."""
    rows = df.where(F.col(stance).isNotNull() & (F.col(stance) != skip))
    own = rows.groupBy(person).agg(F.avg((F.col(stance) == value).cast("double")).alias("own"))
    return own.agg(F.count_if(F.col("own") > least).alias("n_mostly"), F.count("*").alias("n_people"))


def attach(df: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows with a dimension's columns (session, person); a key that the dimension repeats counts once, its smallest row."""
    return df.join(dedupe_first(dimension.select(key, *columns), [key], columns), key, "left")


def case_people(df: DataFrame, person: str, value: str, least: int = 25) -> DataFrame:
    """Figure frame: of people with enough rows the two with the largest spread and the one with the smallest."""
    sd = df.groupBy(person).agg(F.count("*").alias("n"), F.stddev_samp(value).alias("sd")).where(F.col("n") >= least)
    most = sd.orderBy(F.desc("sd"), person).limit(2).withColumn("case", F.lit("most_variable"))
    return most.unionByName(sd.orderBy("sd", person).limit(1).withColumn("case", F.lit("least_variable")))


def compare_reference(found: DataFrame, reference: DataFrame, code: str, pct: str, ref_pct: str, alarm: float = -25.0) -> DataFrame:
    """found and reference percentages by code with rank, gap, an alarm flag and the codes that never occur."""
    joined = reference.join(found, code, "left").withColumn(pct, F.coalesce(pct, F.lit(0.0)))
    rank = F.row_number().over(Window.orderBy(F.desc(pct), code))  # a row for each code of the codebook
    return joined.withColumn("rank", rank.cast("long")).withColumn("gap", F.col(pct) - F.col(ref_pct)).withColumn("alarm", F.col("gap") < alarm).withColumn("absent", F.col(pct) == 0)


def reference_rows(reference: DataFrame, code: str, pct: str, label: str) -> DataFrame:
    """The highest percentage among a code's rows of the reference and that row's label, of equals the smaller label."""
    top = F.min(F.struct((-F.col(pct)).alias("k"), F.col(label).alias("label")))
    return reference.groupBy(code).agg(F.max(pct).alias("max_pct"), top["label"].alias("top_row"))


def rollup_levels(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts and means at every level of the hierarchy, with the level's number."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.grouping_id().cast("long").alias("level"))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(status, n): keys only in a, only in b, and in both; nulls take no part."""
    x, y = (d.select(F.col(key)).where(F.col(key).isNotNull()).distinct() for d in (a, b))
    part = lambda d, name: d.agg(F.count("*").alias("n")).withColumn("status", F.lit(name))
    return part(x.join(y, key, "left_anti"), "only_left").unionByName(part(y.join(x, key, "left_anti"), "only_right")).unionByName(part(x.join(y, key, "left_semi"), "both"))
