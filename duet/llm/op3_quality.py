"""Quality rules with risk-controlled thresholds.

Each text gets a few whole-text counts. Of the labelled documents that pass the base rules one of each group of copies takes part
(copies would count one judgement many times, and the binomial law wants independent ones; a copy is told by the least
hash of its five-word shingles, which near copies mostly share). A hash of the id deals them into a half that proposes and a half that
is held out.

For each stratum (``lang``) the proposing half orders all cutoffs of all rules into one sequence, from the one that turns away
the fewest good documents on; the first t cutoffs together are candidate t, so each candidate rejects all that the one
before does. The holdout tests them in this fixed sequence: candidate t is certified while the exact binomial test rejects
that it turns away more than ``risk`` of the stratum's good documents, and the first that fails ends the sequence. A fixed
sequence needs no correction for the number of its steps, so the whole level goes to every step; the level is divided by the number
of strata (Bonferroni). With probability 1 - ``level`` no stratum loses more than ``risk`` of its good documents to the rules. Among the certified
candidates the one with the largest gain (bad minus good share rejected) on the proposing half is used; where none is
certified, as with a holdout that is too small for the test to ever reject (85 good documents at the defaults and four strata), the rules stay off.

Null and empty texts have no words and fail the base rules; texts of any length are counted whole. Labels that are null or
contradict each other, and null ids, take no part. A null stratum is one of its own. Repeated rows are judged alike, one row each. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, col, fields, in_chunks
from .op9_jaccard import shingles

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window which occurs twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    key = ids
    for k in range(1, WINDOW):  # exact: after each word the pairs are numbered anew
        key = key[:-1] * (len(number) + 1) + ids[k:]
        if k < WINDOW - 1 and int(key.max()) > (1 << 62) // (len(number) + 1):
            key = np.unique(key, return_inverse=True)[1]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[at] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    whole = len(text) - int(((raw & 0xC0) == 0x80).sum())
    blank = int(((raw == 32) | ((raw >= 9) & (raw <= 13))).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = int(_IS_SYMBOL[raw].sum())
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    return len(words), whole - blank, symbols, len(lines) - len(set(lines)), repeated_words(words), upper, len(lines)


def features(docs: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stratum, the counts and ``copy`` (equal for copies and most near copies, null without words) of every row."""

    def run(batches):
        for batch, texts in in_chunks(batches, "text"):
            rows = np.array([counts_of(t) for t in texts], np.int64).reshape(len(texts), len(COUNTS))
            h, n = shingles(texts)
            least = np.zeros(len(texts), np.int64)
            least[n > 0] = h.view(np.int64)[(np.cumsum(n) - n)[n > 0]]  # in order within each text
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, i]) for i in range(len(COUNTS))), pa.array(least, mask=n == 0)], ["doc_id", "stratum", *COUNTS, "copy"])

    frame = docs.select(col(id_col).alias("doc_id"), col(stratum).cast("string").alias("stratum"), col(text_col).alias("text"))
    return arrow_map(frame, run, fields(docs, {"doc_id": id_col}, "stratum string, " + ", ".join(f"{c} long" for c in (*COUNTS, "copy"))))


def ratios() -> dict[str, F.Column]:
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {"symbol_ratio": over("n_symbols", "word_chars"), "dup_line_ratio": over("n_dup_lines", "n_lines"), "repeat_ratio": over("n_repeat_words", "n_words"), "upper_ratio": over("n_upper", "word_chars")}


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p): the terms from the largest on down, until they no longer count."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    if k > n * p:
        return 1.0 - _tail(n - k - 1, n, 1 - p)
    return _tail(k, n, p)


def _tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for k up to the mean, where each term down from k is smaller than the one before."""
    if k < 0:
        return 0.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(1.0, total)


def sequence(tables: dict[str, tuple[list[float], np.ndarray, np.ndarray]]) -> list[tuple[str, float]]:
    """The cutoffs of a stratum in the order in which they are tested. tables: of each rule its cutoffs in ascending order, and
    the good and bad documents of the proposing half by how many of the cutoffs their value exceeds."""
    rows = []
    for rule, (cutoffs, good, bad) in tables.items():
        g, b = (np.cumsum(x[::-1])[::-1][1:] for x in (good, bad))  # [i]: documents that cutoff i rejects
        for i, c in enumerate(cutoffs):
            if b[i] * good.sum() > g[i] * bad.sum():  # a larger share of the bad than of the good
                rows.append((int(g[i]), -int(b[i]), RULES.index(rule), -c))
    out: list[tuple[str, float]] = []
    now: dict[str, float] = {}
    for _, _, k, c in sorted(rows):
        rule = RULES[k]
        if -c < now.get(rule, math.inf):
            now[rule] = -c
            out.append((rule, -c))
    return out


def certify(first: dict[tuple[bool, bool], np.ndarray], risk: float, level: float) -> dict:
    """first: (holdout?, good?) to the documents by the first candidate that rejects them (the last place: none does).
    The candidates certified, the one used (0: none), and the test of the last certified one."""
    cum = {k: np.cumsum(v) for k, v in first.items()}
    n_hold, n_good, n_bad = (int(cum[k][-1]) for k in ((True, True), (False, True), (False, False)))
    out = {"holdout": n_hold, "candidates": len(first[True, True]) - 1, "certified": 0, "used": 0, "rejected": 0, "p": 1.0}
    gain = 0.0
    for t in range(1, out["candidates"] + 1):
        k = int(cum[True, True][t - 1])
        p = binomial_cdf(k, n_hold, risk) if n_hold else 1.0
        if p > level:
            break
        out |= {"certified": t, "rejected": k, "p": p}
        g = cum[False, False][t - 1] / max(1, n_bad) - cum[False, True][t - 1] / max(1, n_good)
        if g > gain:
            out["used"], gain = t, g
    return out


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, good, holdout and the rules' values of one labelled document of each group of copies."""
    clear = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).where("a = b")
    known = found.where(~base_failed()).join(clear.select("doc_id", (F.col("a") > 0).alias("good")), "doc_id")
    value = ratios()
    whole = F.struct(F.xxhash64("doc_id").alias("order"), "doc_id", "good", *(value[r].alias(r) for r in RULES))
    one = known.groupBy("stratum", "copy").agg(F.min(whole).alias("x"))
    return one.select("stratum", "x.good", (F.crc32(F.col("x.doc_id").cast("string").cast("binary")) % 2 == 1).alias("holdout"), *(f"x.{r}" for r in RULES))


def certificates(found: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05, steps: int = 100) -> list[dict]:
    """For each stratum the sequence of cutoffs, what of it is certified and used (see ``certify``), and the cutoffs in use by rule.

    From labels(doc_id, quality). Only counts by stratum, rule and step reach the driver.
    """
    spark = found.sparkSession
    scratch = Scratch(spark)
    known = scratch.table(labelled(found, labels), "labelled")
    at = F.array(*(F.lit(i / steps) for i in range(steps + 1)))
    grid = known.where("not holdout").groupBy("stratum").agg(*(F.percentile_approx(r, at, 10_000).alias(r) for r in RULES)).collect()
    if not grid:
        return []
    cutoffs = {(g["stratum"], r): sorted({float(x) for x in g[r]}) for g in grid for r in RULES}
    tall = known.where("not holdout").select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES))).alias("x")).select("stratum", "good", "x.rule", "x.value")
    steps_of = spark.createDataFrame([(s, r, c) for (s, r), c in cutoffs.items()], "stratum string, rule string, cutoffs array<double>")
    counted = tall.join(steps_of, tall.stratum.eqNullSafe(steps_of.stratum) & (tall.rule == steps_of.rule)).select(tall.stratum, tall.rule, "good", F.expr("size(filter(cutoffs, c -> value > c))").alias("step"))
    tables: dict = {g["stratum"]: {r: (cutoffs[g["stratum"], r], *(np.zeros(len(cutoffs[g["stratum"], r]) + 1, np.int64) for _ in "gb")) for r in RULES} for g in grid}
    for x in counted.groupBy("stratum", "rule", "good", "step").count().collect():
        tables[x["stratum"]][x["rule"]][1 if x["good"] else 2][x["step"]] += x["count"]
    orders = {s: sequence(t) for s, t in tables.items()}
    path = spark.createDataFrame([(s, [(t, RULES.index(r), c) for t, (r, c) in enumerate(o)]) for s, o in orders.items()], "stratum string, path array<struct<t:int,rule:int,cutoff:double>>")
    values = known.select("stratum", "good", "holdout", F.array(*RULES).alias("value"))
    first = values.join(path, values.stratum.eqNullSafe(path.stratum)).select(values.stratum, "good", "holdout", F.expr("coalesce(array_min(transform(filter(path, p -> value[p.rule] > p.cutoff), p -> p.t)), size(path))").alias("first"))
    counts = {s: {(h, g): np.zeros(len(o) + 1, np.int64) for h in (True, False) for g in (True, False)} for s, o in orders.items()}
    for x in first.groupBy("stratum", "good", "holdout", "first").count().collect():
        counts[x["stratum"]][x["holdout"], x["good"]][x["first"]] += x["count"]
    scratch.drop()
    out = []
    for s in sorted(orders, key=lambda s: (s is not None, s)):
        got = certify(counts[s], risk, level / len(orders))
        out.append({"stratum": s} | got | {"sequence": orders[s], "cutoffs": dict(orders[s][: got["used"]])})  # of a rule the last, tightest one
    return out


def thresholds(found: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05, steps: int = 100) -> dict[tuple[str | None, str], float]:
    """The cutoffs in use by (stratum, rule)."""
    return {(c["stratum"], r): x for c in certificates(found, labels, risk, level, steps) for r, x in c["cutoffs"].items()}


def judge(found: DataFrame, cutoffs: dict[tuple[str | None, str], float]) -> DataFrame:
    """found with base_failed and kept."""
    value, rejected = ratios(), F.lit(False)
    for (stratum, rule), cut in cutoffs.items():
        rejected = rejected | (F.col("stratum").eqNullSafe(F.lit(stratum)) & (value[rule] > cut))
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = Scratch(spark).table(features(docs), "quality")
    return judge(found, thresholds(found, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
