"""Random-intercept mixed models by REML, from sufficient statistics that one aggregation gives.

Per group: X'X, X'y, y'y, the row count and the sums of X and y. Only those (a few numbers for each group) reach the driver, where the
profiled likelihood is maximised over the ratio of the variances, zero included.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import normal_p_value


def design(df: DataFrame, factors: list[str], interactions: list[tuple[str, str]] = ()) -> tuple[DataFrame, list[str], dict[str, F.Column]]:
    """Treatment-coded dummy columns: names and expressions, the smallest level of each factor being the base."""
    levels = {f: [r[0] for r in df.where(F.col(f).isNotNull()).select(F.col(f).cast("string")).distinct().orderBy(f).collect()] for f in factors}
    terms = {f"{f}[{v}]": (F.col(f).cast("string") == v).cast("double") for f in factors for v in levels[f][1:]}
    for a, b in interactions:
        terms |= {f"{a}[{x}]:{b}[{y}]": terms[f"{a}[{x}]"] * terms[f"{b}[{y}]"] for x in levels[a][1:] for y in levels[b][1:]}
    return df, ["Intercept", *terms], {"Intercept": F.lit(1.0), **terms}


def sufficient(df: DataFrame, y: str, terms: dict[str, F.Column], group: str) -> list[dict]:
    """Sums over the groups of each size: all that the likelihood needs."""
    names = list(terms)
    rows = df.where(F.col(y).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(y).cast("double").alias("y"), *[t.alias(f"x{i}") for i, t in enumerate(terms.values())])
    rows = rows.na.drop()
    x = [F.col(f"x{i}") for i in range(len(names))]
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(len(x)) for j in range(i + 1)]
    out = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("c"), F.sum("y").alias("t"), *sums, *[F.sum(v * F.col("y")).alias(f"b{i}") for i, v in enumerate(x)])
    # A group's weight depends on its size only, so groups of one size are added up: what is collected grows with the sizes that occur.
    k = len(names)
    s = [F.col(f"a{i}_0") for i in range(k)]
    plain = [c for c in out.columns if c not in ("g", "n")]
    squares = [F.sum(s[i] * s[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i + 1)]
    by_size = out.groupBy("n").agg(F.count("*").alias("m"), *[F.sum(c).alias(c) for c in plain], *squares, *[F.sum(s[i] * F.col("t")).alias(f"st{i}") for i in range(k)], F.sum(F.col("t") * F.col("t")).alias("tt"))
    result = []
    for r in by_size.orderBy("n").collect():
        a, ss = np.zeros((k, k)), np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                a[i, j] = a[j, i] = r[f"a{i}_{j}"]
                ss[i, j] = ss[j, i] = r[f"s{i}_{j}"]
        vector = lambda name: np.array([r[f"{name}{i}"] for i in range(k)])  # noqa: B023, E731
        result.append({"n": r["n"], "m": r["m"], "c": r["c"], "A": a, "b": vector("b"), "ss": ss, "st": vector("st"), "tt": r["tt"]})
    return result


def reml(stats: list[dict]) -> dict:
    """Estimates, standard errors, variances and ICC; the first column of X is the intercept."""
    n, p = sum(s["n"] * s["m"] for s in stats), len(stats[0]["b"])

    def solve(ratio: float):
        a, b, c, logs = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
        for s in stats:
            w = ratio / (1 + s["n"] * ratio)
            a += s["A"] - w * s["ss"]
            b += s["b"] - w * s["st"]
            c += s["c"] - w * s["tt"]
            logs += s["m"] * math.log1p(s["n"] * ratio)
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        sigma2 = max((c - b @ beta) / max(1, n - p), 1e-300)
        return beta, sigma2, a, -0.5 * ((n - p) * math.log(sigma2) + logs + np.linalg.slogdet(a)[1])

    # Golden section over log ratio, and the border at zero.
    low, high, g = -12.0, 8.0, (math.sqrt(5) - 1) / 2
    f = lambda u: solve(math.exp(u))[3]
    x1, x2 = high - g * (high - low), low + g * (high - low)
    f1, f2 = f(x1), f(x2)
    for _ in range(100):
        if f1 < f2:
            low, x1, f1 = x1, x2, f2
            x2 = low + g * (high - low)
            f2 = f(x2)
        else:
            high, x2, f2 = x2, x1, f1
            x1 = high - g * (high - low)
            f1 = f(x1)
    ratio = math.exp((low + high) / 2)
    ratio = ratio if solve(ratio)[3] > solve(0.0)[3] else 0.0
    beta, sigma2, a, _ = solve(ratio)
    se = np.sqrt(np.maximum(np.diag(sigma2 * np.linalg.pinv(a)), 0))
    return {"beta": beta, "se": se, "var_residual": sigma2, "var_group": ratio * sigma2, "icc": ratio / (1 + ratio)}


def mixed_model(df: DataFrame, y: str, factors: list[str], group: str, scope: str = "", interactions: list[tuple[str, str]] = (), least: int = 5, widest: float = 10.0) -> DataFrame:
    """(dv, scope, term, estimate, ci_low, ci_high, p, icc): a row for each term but the intercept whose interval is finite and no wider
    than ``widest``. Under ``least`` groups there are no rows."""
    spark = df.sparkSession
    schema = "dv string, scope string, term string, estimate double, ci_low double, ci_high double, p double, icc double"
    df, names, terms = design(df, factors, interactions)
    stats = sufficient(df, y, terms, group)
    if sum(s["m"] for s in stats) < least:
        return spark.createDataFrame([], schema)
    m = reml(stats)
    rows = []
    for k, name in enumerate(names):
        est, se = float(m["beta"][k]), float(m["se"][k])
        if name != "Intercept" and se > 0 and math.isfinite(se) and 2 * 1.96 * se <= widest:
            rows.append((y, scope, name, est, est - 1.96 * se, est + 1.96 * se, normal_p_value(est / se), float(m["icc"])))
    return spark.createDataFrame(rows, schema)


def variance_parts(df: DataFrame, y: str, group: str) -> DataFrame:
    """Between-group and within-group standard deviation, in one pass over groups."""
    g = df.where(F.col(y).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v"))
    within = F.sqrt(F.try_divide(F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("v"))), F.sum(F.when(F.col("n") > 1, F.col("n") - 1))))
    return g.agg(F.stddev_samp("m").alias("between_sd"), within.alias("within_sd"), F.count("*").alias("n_groups"))
