"""Registered queries of the Python operators on data made so that SQL knows the answer: planted errors, times, speakers and variances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align as AL
from ..operators import models as M
from ..sources.tables import table
from ..streaming import turns as ST
from .catalog import query, turns
from .worksheets import _WORDS, words

# Each word of a turn is played by its place, so every word is met once. Of the heard ones every seventh is lost, every seventh is wrong.
def place():
    return F.concat(F.lit("w"), F.col("turn").cast("string"), F.lit("x"), F.col("i").cast("string"))


@query("wer_planted", f"""WITH {_WORDS} SELECT conv_id, role AS speaker_role, CAST(count(*) FILTER (i%7=3 OR i%7=5) AS BIGINT) AS errors, count(*) AS ref_words, round(count(*) FILTER (i%7=3 OR i%7=5)/count(*),6) AS wer
 FROM words GROUP BY ALL""")
def _(spark, d):
    heard = F.when(F.col("i") % 7 == 5, F.concat(F.lit("q"), place())).when(F.col("i") % 7 != 3, place())
    rows = words(spark, d).select("conv_id", F.col("role").alias("speaker_role"), F.struct("turn", "i", place().alias("r"), heard.alias("h")).alias("x"))
    rows = rows.groupBy("conv_id", "speaker_role").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rows = rows.select("conv_id", "speaker_role", F.array_join("x.r", " ").alias("r"), F.array_join("x.h", " ").alias("h"))
    return AL.wer(rows, ["conv_id", "speaker_role"], "r", "h").withColumn("wer", F.round("wer", 6))


# Every fourth word is followed by a noise that no clean text has.
@query("align_planted", f"""WITH {_WORDS}, n AS (SELECT conv_id, turn, row_number() OVER o + sum(CAST(i%4=0 AS INT)) OVER o - CAST(i%4=0 AS INT) AS p FROM words WINDOW o AS (PARTITION BY conv_id ORDER BY turn, i ROWS UNBOUNDED PRECEDING))
 SELECT conv_id, turn, round(min(p)/2.0,4) AS start_s, round(max(p)/2.0+0.3,4) AS end_s, 1.0 AS coverage FROM n GROUP BY ALL""")
def _(spark, d):
    said = words(spark, d).select("conv_id", "turn", "i", place().alias("w"))
    clean = said.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias("text"))
    noise = F.when(F.col("i") % 4 == 0, F.array("w", F.lit("zz"))).otherwise(F.array("w"))
    heard = said.select("conv_id", "turn", "i", F.posexplode(noise).alias("k", "w"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i", "k")) / 2.0
    out = AL.align(clean, heard.select("conv_id", "w", at.alias("s"), (at + 0.3).alias("e")), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", *[F.round(c, 4).alias(c) for c in ("start_s", "end_s", "coverage")])


# A window's speaker is its number modulo three: a direction of its own, with the embedding as noise. Speakers are named by their first window.
@query("speakers_planted", "SELECT vec_id//90 AS session, vec_id, min(vec_id) OVER (PARTITION BY vec_id//90, vec_id%3) AS first_window FROM embeddings")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 90).cast("long").alias("session"), "embedding")
    made = F.transform("embedding", lambda x, k: x.cast("double") * 0.25 + F.when(k == F.col("vec_id") % 3, 1.0).otherwise(0.0))
    out = AL.spectral_speakers(rows.withColumn("v", made), "session", "vec_id", "v")
    return out.select("session", "vec_id", F.min("vec_id").over(Window.partitionBy("session", "speaker")).alias("first_window"))


# Equal groups, with the factor's levels equally often in each: there the restricted likelihood has its greatest value in closed form.
@query("mixed_model_balanced", """WITH e AS (SELECT vec_id AS g, i-1 AS i, embedding[i]::DOUBLE + (vec_id%7)*0.1::DOUBLE AS y FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)),
 s AS (SELECT count(*) AS n, count(DISTINCT g) AS k, avg(y) FILTER (i%2=1)-avg(y) FILTER (i%2=0) AS d, avg(y) AS m FROM e), b AS (SELECT count(*) AS c, avg(y) AS gm FROM e GROUP BY g),
 q AS (SELECT (SELECT sum(c*(gm-m)*(gm-m)) FROM b, s) AS ssb, (SELECT sum((y-m)*(y-m)) FROM e, s) AS sst, n, k, d, n/k AS c FROM s),
 v AS (SELECT *, sst-ssb-n*d*d/4 AS sse, (sst-ssb-n*d*d/4)/(n-k-1) AS mse, ssb/(k-1) AS msb FROM q),
 z AS (SELECT *, CASE WHEN msb>mse THEN mse ELSE (ssb+sse)/(n-2) END AS s2, greatest((msb-mse)/c, 0) AS vg FROM v)
 SELECT 'half[1]' AS term, round(d,5) AS estimate, round(d-1.96*sqrt(4*s2/n),5) AS ci_low, round(d+1.96*sqrt(4*s2/n),5) AS ci_high, round(vg/(vg+s2),5) AS icc FROM z""")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    rows = rows.select("vec_id", (F.col("i") % 2).alias("half"), (F.col("x").cast("double") + (F.col("vec_id") % 7) * F.lit(0.1)).alias("y"))
    out = M.mixed_model(rows, "y", ["half"], "vec_id")
    return out.select("term", *[F.round(c, 5).alias(c) for c in ("estimate", "ci_low", "ci_high", "icc")])


@query("timed_turns", """WITH r AS (SELECT user_id, event_type, epoch_us(ts) AS us, coalesce(CAST(event_id AS VARCHAR),'') AS t FROM events WHERE ts IS NOT NULL),
 l AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR lag(event_type) OVER w IS DISTINCT FROM event_type OR us-lag(us) OVER w>86400000000 THEN 1 ELSE 0 END AS nw FROM r WINDOW w AS (PARTITION BY user_id ORDER BY us, event_type NULLS FIRST, t)),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY us, event_type NULLS FIRST, t ROWS UNBOUNDED PRECEDING) AS turn FROM l)
 SELECT user_id, event_type, make_timestamp(min(us)) AS turn_start, make_timestamp(max(us)) AS turn_end, count(*) AS n, string_agg(t,' ' ORDER BY us, t) AS text FROM g GROUP BY user_id, event_type, turn""")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("t"))
    out = ST.table_turns(rows, "ts", "user_id", "event_type", "t", 86400)
    return out.select("user_id", "event_type", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("turn_start", "turn_end")], "n", "text")
