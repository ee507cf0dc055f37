"""Ordered-row operators: islands, windows, as-of, nearest and range joins, smoothing, interpolation, context.

As-of and nearest joins are a union, one sort and a running last or first value, so they cost n log n in one exchange where
a range join would cost the product of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, key: Column, by: list[str], order: list[str], name: str = "run") -> DataFrame:
    """Number the runs of equal ``key`` (from 0) in each group; null equals null."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 0).when(key.eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn(name, F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__changed")


def gap_islands(df: DataFrame, start: str, end: str, gap: float, by: list[str], order: list[str], name: str = "island") -> DataFrame:
    """Number islands: a new one begins where a start is over ``gap`` after the largest end so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) - top > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def speaker_turns(words: DataFrame, by: list[str], speaker: str, start: str, end: str, order: list[str], gap: float = 1.5, name: str = "turn_index") -> DataFrame:
    """Number turns: a new one begins at a change of speaker, or over ``gap`` after the end of the word before."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) & (F.col(start) - F.lag(end).over(w) <= gap)
    new = F.when(F.row_number().over(w) == 1, 0).when(same, 0).otherwise(1)
    return words.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def speech_regions(words: DataFrame, by: list[str], start: str = "s", end: str = "e", gap: float = 0.35, least: float = 0.2) -> DataFrame:
    """Regions of merged word times of at least ``least`` seconds; words that end before they begin are dropped first."""
    rows = gap_islands(words.where(F.col(end) > F.col(start)), start, end, gap, by, [start, end])
    out = rows.groupBy(*by, "island").agg(F.min(start).alias("start_s"), F.max(end).alias("end_s"))
    return out.where(F.col("end_s") - F.col("start_s") >= least)


def sliding_windows(regions: DataFrame, width: float = 1.5, hop: float = 0.75, least: float = 0.6, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Windows of ``width`` every ``hop`` seconds from each region's start, cut at its end; under ``least`` dropped."""
    size = F.col(end) - F.col(start)
    last = F.when(size <= width, F.when(size >= least, 0)).otherwise(F.floor((size - least) / hop).cast("int"))
    out = regions.withColumn("window_no", F.explode(F.sequence(F.lit(0), last.cast("int")))).where(last.isNotNull())
    begin = F.col(start) + F.col("window_no") * hop
    return out.withColumn("win_start", begin).withColumn("win_end", F.least(begin + width, F.col(end)))


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: dict[str, str], rank: str | None = None) -> DataFrame:
    """left with the values ``take`` ({right column: new name}) of the latest right row at or before its time, else null.

    A right row counts at its own time; of rows at the same time the one with the highest ``rank`` wins.
    """
    values = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    keys = [F.col(k) for k in by]
    a = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("double").alias("__rank"), F.struct(*left.columns).alias("__row"))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), (F.col(rank) if rank else F.lit(None)).cast("double").alias("__rank"), values.alias("__value"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__rank").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__row.*", *[F.col(f"__last.{n}").alias(n) for n in take.values()])


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: dict[str, str], order: str) -> DataFrame:
    """left with the values of the right row nearest in time, a tie going to the earlier; of equal times the lowest ``order``."""
    value = F.struct(F.col(right_time).alias("__at"), *[F.col(c).alias(n) for c, n in take.items()])
    first = right.groupBy(*by, F.col(right_time).alias("__t")).agg(F.min_by(value, F.col(order)).alias("__value")).withColumn("__side", F.lit(0))
    a = left.select(*[F.col(k) for k in by], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    both = a.unionByName(first, allowMissingColumns=True)
    back = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("__p", F.last("__value", ignorenulls=True).over(back)).withColumn("__n", F.first("__value", ignorenulls=True).over(ahead)).where("__side = 1")
    use_next = F.col("__p").isNull() | (F.col("__n").isNotNull() & (F.col("__n.__at") - F.col("__t") < F.col("__t") - F.col("__p.__at")))
    out = both.withColumn("__v", F.when(use_next, F.col("__n")).otherwise(F.col("__p")))
    return out.select("__row.*", *[F.col(f"__v.{n}").alias(n) for n in take.values()])


def char_offsets(df: DataFrame, by: list[str], order: list[str], text: str, start: str = "off_start", end: str = "off_end") -> DataFrame:
    """Where each row's text lies in the group's texts joined by single spaces: [start, end)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)).cast("long")
    return df.withColumn(start, begin).withColumn(end, begin + F.length(text))


def locate_offsets(points: DataFrame, spans: DataFrame, by: list[str], offset: str, start: str = "off_start", end: str = "off_end", take: tuple[str, ...] = ()) -> DataFrame:
    """points with the columns ``take`` of the span that holds their offset; offsets in no span get the group's last span.

    Spans don't overlap, so the span is the latest that starts at or before the offset, if it reaches that far.
    """
    found = asof_backward(points, spans, by, offset, start, {end: "__end", **{c: f"__in_{c}" for c in take}})
    last = spans.groupBy(*by).agg(*[F.max_by(c, F.col(start)).alias(f"__last_{c}") for c in take])
    inside = F.col(offset) < F.col("__end")
    out = found.join(last, by, "left")
    return out.select(*points.columns, *[F.when(inside, F.col(f"__in_{c}")).otherwise(F.col(f"__last_{c}")).alias(c) for c in take])


def majority_smooth(df: DataFrame, label: str, by: list[str], order: list[str], width: int = 5, name: str = "smoothed") -> DataFrame:
    """The commonest label among the ``width`` rows around each row, fewer at the edges; of equals the smallest label."""
    half = width // 2
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn(name, F.mode(F.col(label), deterministic=True).over(w))


def rolling_mean(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "rolled") -> DataFrame:
    """Centred rolling mean whose width grows with the group: an eighth of its rows, between 3 and 9; short at the edges."""
    group, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*order)
    width = F.greatest(F.lit(3), F.least(F.lit(9), F.floor(F.count("*").over(group) / 8))).cast("int")
    out = None
    for w in range(3, 10):
        after = (w - 1) // 2
        mean = F.avg(value).over(ordered.rowsBetween(-(w - 1 - after), after))
        out = F.when(F.col("__width") == w, mean) if out is None else out.when(F.col("__width") == w, mean)
    return df.withColumn("__width", width).withColumn(name, out).drop("__width")


def relative_bins(df: DataFrame, by: list[str], order: list[str], bins: int = 5, name: str = "bin") -> DataFrame:
    """Which of ``bins`` equal parts of its group a row is in, by position."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn(name, F.floor(bins * place / F.count("*").over(Window.partitionBy(*by))).cast("int"))


def context(df: DataFrame, by: list[str], order: list[str], role: str, text: str, reach: int = 2, name: str = "context") -> DataFrame:
    """The rows within ``reach`` of each row, as ``[R] text`` joined by `` || ``; R is the role's first letter."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)
    one = F.concat(F.lit("["), F.upper(F.substring(role, 1, 1)), F.lit("] "), F.col(text))
    return df.withColumn(name, F.array_join(F.collect_list(one).over(w), " || "))


def neighbours(df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(f"prev_{column}", F.lag(column).over(w)).withColumn(f"next_{column}", F.lead(column).over(w))


def interpolate(df: DataFrame, value: str, position: str, by: list[str], name: str = "filled") -> DataFrame:
    """Linear interpolation of a missing value between the nearest known ones; before the first and after the last it stays level."""
    w = Window.partitionBy(*by).orderBy(position)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("x"), F.col(value).cast("double").alias("y")))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn("__a", F.last(known, ignorenulls=True).over(back)).withColumn("__b", F.first(known, ignorenulls=True).over(ahead))
    run = (F.col(position) - F.col("__a.x")) / F.nullif((F.col("__b.x") - F.col("__a.x")).cast("double"), F.lit(0.0))
    between = F.col("__a.y") + coalesce0(run) * (F.col("__b.y") - F.col("__a.y"))
    return out.withColumn(name, F.coalesce(between, F.col("__a.y"), F.col("__b.y"))).drop("__a", "__b")


def coalesce0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def dedupe_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def numbered_ids(df: DataFrame, session: str, order: list[str], name: str = "utt_id", digits: int = 4) -> DataFrame:
    """``<session>_0001`` by position in the session."""
    n = F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("string")
    return df.withColumn(name, F.concat(F.col(session), F.lit("_"), F.when(F.length(n) < digits, F.lpad(n, digits, "0")).otherwise(n)))
