"""Statistics within and across groups, as built-in expressions; p-values on the driver from a row of figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zscore(df: DataFrame, columns: dict[str, str], by: list[str], missing: str = "zero") -> DataFrame:
    """Add within-group z-scores {source: target}.

    Group means and deviations are one partial aggregation, joined back: broadcast where groups are few, else a join that
    can be split, so that a group with a third of all rows isn't one task as in a window. Sample deviation; a group of one
    or without spread gives 0. A missing measure gives 0 as well, or null with ``missing="null"``.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    sums = [f(F.col(c).cast("double")).alias(f"__{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    stats = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(*sums)
    same = F.lit(True)
    for c, k in zip(by, keys):
        same = same & df[c].eqNullSafe(stats[k])
    out = []
    for i, (source, target) in enumerate(columns.items()):
        x = df[source].cast("double")
        z = F.coalesce((x - F.col(f"__m{i}")) / F.nullif(F.col(f"__s{i}"), F.lit(0.0)), F.lit(0.0))
        out.append((z if missing == "zero" else F.when(x.isNotNull(), z)).alias(target))
    return df.join(stats, same, "left").select(*[df[c] for c in df.columns], *out)


def corr(a: str, b: str, least: int = 2) -> Column:
    """Pearson correlation of the rows that have both, null under ``least`` rows or without spread."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    n, spread = F.count(x), F.var_pop(x) * F.var_pop(y)
    return F.when((n >= least) & (spread > 0), F.covar_pop(x, y) / F.sqrt(F.nullif(spread, F.lit(0.0))))


def group_quantiles(df: DataFrame, by: list[str], column: str, probs: list[float], bins: int = 512) -> DataFrame:
    """Exact, linearly interpolated quantiles of few groups of any size: (by..., q array), nulls left out.

    ``percentile`` would hold all of a group's values in one task. Here each needed rank has an interval of values; a round
    counts the values of the intervals by bin and narrows each to the bin that holds its rank, until that holds one value. What
    reaches the driver is a row for each group, rank and bin. For many small groups ``percentile`` is the better tool.
    """
    spark = df.sparkSession
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("__x"))
    key = lambda r: tuple(r[c] for c in by)
    state: dict[tuple, dict[int, list]] = {}
    counts = {}
    for r in rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi")).collect():
        if r["n"]:
            counts[key(r)] = r["n"]
            ranks = {k for p in probs for k in (math.floor((r["n"] - 1) * p), math.ceil((r["n"] - 1) * p))}
            state[key(r)] = {k: [r["lo"], r["hi"], 0] for k in ranks}  # interval, and how many values lie below it
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by]
    while open_ := [(*g, k, lo, hi) for g, ranks in state.items() for k, (lo, hi, _) in ranks.items() if lo < hi]:
        table = spark.createDataFrame(open_, ", ".join([*kinds, "__k long", "__lo double", "__hi double"]))
        part = rows.join(F.broadcast(table), by) if by else rows.crossJoin(F.broadcast(table))
        part = part.where("__x >= __lo and __x <= __hi").withColumn("__bin", F.least(F.lit(bins - 1), F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins)))
        found: dict[tuple, list] = {}
        for r in part.groupBy(*by, "__k", "__bin").agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi")).collect():
            found.setdefault((key(r), r["__k"]), []).append((r["lo"], r["hi"], r["n"]))
        for (g, k), held in found.items():
            below = state[g][k][2]
            for lo, hi, n in sorted(held):
                if below + n > k:
                    state[g][k] = [lo, hi, below]
                    break
                below += n
    out = []
    for g, n in counts.items():
        q = []
        for p in probs:
            h = (n - 1) * p
            a, b = state[g][math.floor(h)][0], state[g][math.ceil(h)][0]
            q.append(a + (b - a) * (h - math.floor(h)))
        out.append((*g, q))
    return spark.createDataFrame(out, ", ".join([*kinds, "q array<double>"]))


def quantile_bins(df: DataFrame, column: str, labels: tuple[str, ...] = ("low", "mid", "high"), name: str = "val_bin") -> DataFrame:
    """Bins by exact quantiles over all rows, right-closed, the lowest value included; null stays null.

    The column is kept on the executors while the cuts are sought: computed anew it would cost each round what ``df`` costs, its
    broadcasts too, and sums of another order could move a value across the bounds of its interval.
    """
    n = len(labels)
    values = df.select(F.col(column).cast("double").alias(column)).persist()
    try:
        cuts = (group_quantiles(values, [], column, [i / n for i in range(1, n)]).first() or {"q": [0.0] * (n - 1)})["q"]
    finally:
        values.unpersist()
    bin_ = F.lit(labels[-1])
    for i in reversed(range(n - 1)):
        bin_ = F.when(F.col(column) <= cuts[i], labels[i]).otherwise(bin_)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), bin_))


def describe_iqr(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sd, min, quartiles, max and IQR of each measure, one row a measure."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns])).alias("m")).select("m.*")
    plain = tall.groupBy("measure").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = plain.join(F.broadcast(group_quantiles(tall, ["measure"], "x", [0.25, 0.5, 0.75])), "measure", "left")
    return out.select("measure", "n", "mean", "sd", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max", (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def value_counts(df: DataFrame, column: str, keep_nulls: bool = False) -> DataFrame:
    """(value, n, share), share of the rows counted."""
    rows = df if keep_nulls else df.where(F.col(column).isNotNull())
    total = rows.agg(F.count("*").alias("__all"))
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row x column as one column for each of the given values."""
    return df.where(F.col(row).isNotNull()).groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, exact and within-one agreement and correlation of two ratings."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    exact, near = (F.col(a) == F.col(b)).cast("double"), (F.abs(F.col(a) - F.col(b)) <= 1).cast("double")
    return rows.agg(F.count("*").alias("n"), F.avg(exact).alias("exact"), F.avg(near).alias("within_one"), corr(a, b).alias("r"))


def krippendorff_alpha(df: DataFrame, unit: str, rating: str) -> DataFrame:
    """Nominal Krippendorff alpha of the ratings of each unit (a row a rating); units with one rating don't count."""
    per = df.where(F.col(rating).isNotNull()).groupBy(unit, rating).agg(F.count("*").alias("n"))
    per = per.withColumn("m", F.sum("n").over(Window.partitionBy(unit))).where("m > 1")
    observed = per.agg(F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("o"), F.sum("n").alias("total"))
    marginal = per.groupBy(rating).agg(F.sum("n").alias("n_c")).agg(F.sum(F.col("n_c") * F.col("n_c")).alias("squares"))
    both = observed.crossJoin(marginal)
    expected = (F.col("total") * F.col("total") - F.col("squares")) / (F.col("total") - 1)
    return both.select((1 - F.try_divide(F.col("o"), expected)).alias("alpha"), F.col("total").alias("n_ratings"))


def t_test_1samp(df: DataFrame, contrast: str, value: str, least: int = 5) -> DataFrame:
    """Per contrast: n_people, mean_shift, sd, t, two-sided p and n_moved_down, where at least ``least`` people have a value."""
    rows = df.where(F.col(value).isNotNull()).groupBy(contrast).agg(
        F.count("*").alias("n_people"), F.avg(value).alias("mean_shift"), F.stddev_samp(value).alias("sd"), F.sum((F.col(value) < 0).cast("long")).alias("n_moved_down")
    )
    t = F.try_divide(F.col("mean_shift"), F.col("sd") / F.sqrt(F.col("n_people").cast("double")))
    return rows.where(F.col("n_people") >= least).withColumn("t", t).withColumn("p", t_p("t", "n_people - 1"))


def t_p(t: str, df: str) -> Column:
    """Two-sided p of Student's t with whole degrees of freedom (expressions), by its finite series in powers of the squared cosine of
    atan(t / sqrt(df))."""
    even, c2, terms = f"(({df}) % 2 = 0)", f"(({df}) / (({df}) + {t} * {t}))", f"(({df}) - IF(({df}) % 2 = 0, 0, 1)) div 2"
    step = f"IF({even}, (2 * k - 1) / (2D * k), (2 * k) / (2D * k + 1))"
    total = f"IF({terms} < 1, 0D, aggregate(sequence(1L, greatest(1L, {terms})), named_struct('a', 1D, 's', 0D), (x, k) -> named_struct('a', x.a * {c2} * {step}, 's', x.s + x.a), x -> x.s))"
    sine = f"(abs({t}) / sqrt(({df}) + {t} * {t}))"
    return F.expr(f"1 - IF({even}, {sine} * {total}, 2 / pi() * (atan(abs({t}) / sqrt({df})) + {sine} * sqrt({c2}) * {total}))")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def normal_p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
