"""The registered queries by name, each with its DuckDB SQL where SQL can express it.

The study's columns are played by the test tables: ``events`` is the timeline with a measured (``value``) and a text channel
(``props.k``), ``signup`` the excluded topic and ``view`` the base; ``conversations`` are turns (user: participant, assistant:
interviewer); ``documents`` are texts, ``labels`` a human coder; ``customer`` and ``orders`` people and their measures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scorers import KeywordCoder, LexiconSentiment, validate_codes
from ..operators import align as AL
from ..operators import fusion as FU
from ..operators import models as M
from ..operators import reports as R
from ..operators import rollup as RO
from ..operators import stats as S
from ..operators import timeline as TL
from ..operators import turns as TU
from ..schema import WEIGHTS
from ..sources.tables import table
from ..streaming import windows as SW

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BASE, EXCLUDED, OTHERS = "view", "signup", ["click", "error", "purchase"]
CODES = {"A1": ["the", "der"], "A2": ["with", "mit"], "B1": ["this", "das"], "B2": ["from", "von"], "C1": ["what", "was"], "C2": ["is", "ist"]}
POSITIVE, NEGATIVE = ["the", "and", "thing"], ["idiot", "trash", "stupid", "error"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    """The timeline: event_id, user_id, topic, start_s and the measures ac, tx, ar."""
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id", F.col("event_type").alias("topic"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start_s"),
        F.col("value").alias("ac"), F.get_json_object("props", "$.k").try_cast("double").alias("tx"), F.sqrt(F.abs("value")).alias("ar"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    return S.zscore(events(spark, d), {"ac": "ac_z", "tx": "tx_z", "ar": "ar_z"}, ["user_id"])


def fused(spark: SparkSession, d: str) -> DataFrame:
    rows = FU.discord(FU.fuse(scored(spark, d)))
    stance = F.when(F.col("topic") == "error", None).when(F.col("tx_z") < -0.5, "negative").when(F.col("tx_z") > 0.5, "positive").otherwise("neutral")
    return rows.withColumn("stance", stance).withColumn("code", F.concat(F.lit("k"), F.floor(F.col("tx") / 10).cast("string")))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


def coded(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    return RO.explode_codes(KeywordCoder(CODES).apply(docs, "text").select("doc_id", "lang", "source", "code_ids"), "code_ids")


_EV = "ev AS (SELECT event_id, user_id, event_type AS topic, ts, epoch_us(ts)/1e6 AS start_s, value AS ac, TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE) AS tx, sqrt(abs(value)) AS ar FROM events)"
_Z = _EV + ", z AS (SELECT *, " + ", ".join(f"coalesce(({c}-avg({c}) OVER g)/nullif(stddev_samp({c}) OVER g,0),0) AS {c}_z" for c in ("ac", "tx", "ar")) + " FROM ev WINDOW g AS (PARTITION BY user_id))"
_FUSED = _Z + """, fused AS (SELECT *, 0.5*ac_z+0.5*tx_z AS fused_valence, ar_z AS fused_arousal,
 CASE WHEN sign(ac_z)<>sign(tx_z) AND abs(ac_z)>0.5 AND abs(tx_z)>0.5 THEN 1 ELSE 0 END AS discord_flag,
 CASE WHEN topic='error' THEN NULL WHEN tx_z < -0.5 THEN 'negative' WHEN tx_z > 0.5 THEN 'positive' ELSE 'neutral' END AS stance,
 'k' || CAST(CAST(floor(tx/10) AS BIGINT) AS VARCHAR) AS code FROM z)"""
_TOKENS = r"regexp_extract_all(lower(regexp_replace(text, '\[[^\]]*\]|\([^)]*\)', ' ', 'g')), '[a-z0-9'']+')"
_CODED = "coded AS (SELECT doc_id, lang, source, code_id FROM (SELECT doc_id, lang, source, " + _TOKENS + " AS w FROM documents) d, (VALUES " + ", ".join(f"('{c}', {k!r})" for c, k in CODES.items()) + ") AS b(code_id, keys) WHERE list_has_any(w, keys))"


@query("flagship_topic_emotion", f"""WITH {_FUSED} SELECT topic, count(*) AS n, round(avg(fused_valence),4) AS mean_valence, round(avg(fused_arousal),4) AS mean_arousal,
 CAST(sum(discord_flag) AS BIGINT) AS n_discord FROM fused WHERE topic<>'{EXCLUDED}' GROUP BY topic""")
def _(spark, d):
    out = RO.topic_emotion_summary(fused(spark, d), "topic", EXCLUDED)
    return out.select("topic", "n", F.round("mean_valence", 4).alias("mean_valence"), F.round("mean_arousal", 4).alias("mean_arousal"), "n_discord")


@query("within_speaker_z", f"WITH {_Z} SELECT event_id, round(ac_z,5) AS ac_z, round(tx_z,5) AS tx_z, round(ar_z,5) AS ar_z FROM z")
def _(spark, d):
    return scored(spark, d).select("event_id", *[F.round(c, 5).alias(c) for c in ("ac_z", "tx_z", "ar_z")])


@query("fuse_discord_rows", f"""WITH {_FUSED} SELECT event_id, round(fused_valence,5) AS fused_valence, round(fused_arousal,5) AS fused_arousal, discord_flag,
 CASE WHEN discord_flag=0 THEN '' WHEN tx_z>0 THEN 'positive_words_flat_voice' ELSE 'negative_words_bright_voice' END AS discord_type FROM fused""")
def _(spark, d):
    return fused(spark, d).select("event_id", F.round("fused_valence", 5).alias("fused_valence"), F.round("fused_arousal", 5).alias("fused_arousal"), "discord_flag", "discord_type")


@query("fusion_sensitivity", f"""WITH {_Z}, w AS (SELECT unnest({list(WEIGHTS)!r}::DOUBLE[]) AS wa), v AS (SELECT wa, topic, wa*ac_z+(1-wa)*tx_z AS v, 0.5*ac_z+0.5*tx_z AS v0 FROM z CROSS JOIN w),
 r AS (SELECT wa, round(corr(v,v0),4) AS corr_with_default FROM v GROUP BY wa), m AS (SELECT wa, topic, avg(v) AS m FROM v WHERE topic<>'{EXCLUDED}' GROUP BY ALL),
 e AS (SELECT wa, arg_max(topic,m) AS most_positive, arg_min(topic,m) AS most_negative, round(max(m),5) AS max_mean, round(min(m),5) AS min_mean, {", ".join(f"round(max(m) FILTER (topic='{t}'),5) AS mean_{t}" for t in [BASE, *OTHERS])} FROM m GROUP BY wa) SELECT * FROM r JOIN e USING (wa)""")
def _(spark, d):
    out = FU.fusion_sensitivity(scored(spark, d), "topic", EXCLUDED, topics=[BASE, *OTHERS])
    return out.select("wa", F.round("corr_with_default", 4).alias("corr_with_default"), "most_positive", "most_negative", F.round("max_mean", 5).alias("max_mean"), F.round("min_mean", 5).alias("min_mean"), *[F.round(f"mean_{t}", 5).alias(f"mean_{t}") for t in [BASE, *OTHERS]])


@query("topic_level", f"""WITH {_FUSED}, a AS (SELECT user_id, topic, count(*) AS n_utt, sum(tx) AS talk_time_s, round(avg(fused_valence),4) AS mean_valence, round(stddev_samp(fused_valence),4) AS sd_valence,
 round(avg(fused_arousal),4) AS mean_arousal, round(stddev_samp(fused_arousal),4) AS sd_arousal, round(avg(tx_z),4) AS mean_tx_valence, round(CASE WHEN count(stance)>0 THEN count(*) FILTER (stance='negative')/count(*) END,4) AS prop_negative, round(avg(discord_flag),4) AS prop_discord FROM fused GROUP BY ALL),
 c AS (SELECT user_id, topic, code, count(*) AS c FROM fused WHERE code IS NOT NULL GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY c DESC, code) AS n FROM c)
 SELECT a.*, s.dominant_codes FROM a LEFT JOIN (SELECT user_id, topic, string_agg(code,'|' ORDER BY n) AS dominant_codes FROM t WHERE n<=3 GROUP BY ALL) s USING (user_id, topic)""")
def _(spark, d):
    out = RO.topic_level(fused(spark, d), "user_id", "topic", "tx", code="code")
    return out.select("user_id", "topic", "n_utt", "talk_time_s", *[F.round(c, 4).alias(c) for c in ("mean_valence", "sd_valence", "mean_arousal", "sd_arousal", "mean_tx_valence", "prop_negative", "prop_discord")], "dominant_codes")


@query("participant_level", f"""WITH {_FUSED}, a AS (SELECT user_id, count(*) AS n_utt, round(sum(tx)/60,4) AS talk_time_min, round(avg(fused_valence),4) AS overall_mean_valence, round(avg(fused_arousal),4) AS overall_mean_arousal,
 round(quantile_cont(fused_arousal,0.9)-quantile_cont(fused_arousal,0.1),4) AS arousal_range, round(stddev_samp(fused_valence),4) AS valence_sd, round(avg(discord_flag),4) AS prop_discord, count(DISTINCT topic) AS n_topics, count(DISTINCT code) AS n_distinct_codes, round(avg(fused_arousal) FILTER (topic='error')-avg(fused_arousal) FILTER (topic='{BASE}'),4) AS arousal_shift_error FROM fused GROUP BY user_id),
 m AS (SELECT user_id, topic, avg(fused_valence) AS m, avg(abs(fused_valence)) AS s FROM fused WHERE topic<>'{EXCLUDED}' GROUP BY ALL),
 e AS (SELECT user_id, topic AS most_emotional_topic FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, topic) AS n FROM m) WHERE n=1),
 w AS (SELECT user_id, {", ".join(f"round(max(m) FILTER (topic='{o}')-max(m) FILTER (topic='{BASE}'),4) AS shift_{o}_vs_{BASE}" for o in OTHERS)} FROM m GROUP BY user_id)
 SELECT * FROM a LEFT JOIN e USING (user_id) LEFT JOIN w USING (user_id)""")
def _(spark, d):
    out = RO.participant_level(fused(spark, d), "user_id", "topic", "tx", BASE, EXCLUDED, OTHERS, arousal="error")
    keep = ["user_id", "n_utt", "n_topics", "n_distinct_codes", "most_emotional_topic"]
    return out.select(*keep, *[F.round(c, 4).alias(c) for c in out.columns if c not in keep])


_SHIFTS = "w AS (SELECT user_id, " + ", ".join(f"avg(fused_valence) FILTER (topic='{t}') AS {t}" for t in [BASE, *OTHERS]) + " FROM fused GROUP BY user_id), s AS (" + " UNION ALL ".join(f"SELECT '{o}_vs_{BASE}' AS contrast, {o}-{BASE} AS shift FROM w" for o in OTHERS) + ")"


@query("topic_shift_tests", f"""WITH {_FUSED}, {_SHIFTS}, q AS (SELECT contrast, count(*) AS n_people, avg(shift) AS m, stddev_samp(shift) AS sd, avg(shift)/(stddev_samp(shift)/sqrt(count(*))) AS t, count(*)-1 AS v,
 CAST(sum(CAST(shift<0 AS INT)) AS BIGINT) AS n_moved_down FROM s WHERE shift IS NOT NULL GROUP BY contrast HAVING count(*)>=5),
 p AS (SELECT *, abs(t)/sqrt(v+t*t) AS si, v/(v+t*t) AS c2 FROM q)
 SELECT contrast, n_people, round(m,5) AS mean_shift, round(sd,5) AS sd, round(t,4) AS t, n_moved_down, round(1 - CASE WHEN v%2=0
 THEN si*list_sum(list_transform(range(0, v//2), lambda k: exp(lgamma(k+0.5)-lgamma(k+1.0))/sqrt(pi())*pow(c2,k)))
 ELSE 2/pi()*(atan(abs(t)/sqrt(v))+si*sqrt(c2)*coalesce(list_sum(list_transform(range(0, (v-1)//2), lambda k: exp(lgamma(k+1.0)-lgamma(k+1.5))*sqrt(pi())/2*pow(c2,k))),0)) END,6) AS p FROM p""")
def _(spark, d):
    out = RO.topic_shift_tests(fused(spark, d), "user_id", "topic", "fused_valence", BASE, OTHERS)
    return out.select("contrast", "n_people", F.round("mean_shift", 5).alias("mean_shift"), F.round("sd", 5).alias("sd"), F.round("t", 4).alias("t"), "n_moved_down", F.round("p", 6).alias("p"))


@query("code_frequency", f"""WITH {_CODED} SELECT code_id, count(*) AS n_mentions, count(DISTINCT source) AS n_people, round(100*count(DISTINCT source)/(SELECT count(DISTINCT source) FROM documents),4) AS pct_people FROM coded GROUP BY code_id""")
def _(spark, d):
    return RO.code_frequency(coded(spark, d), "source", "code_id", table(spark, d, "documents")).withColumn("pct_people", F.round("pct_people", 4))


@query("code_by_group", f"""WITH {_CODED}, p AS (SELECT lang, count(DISTINCT doc_id) AS pool FROM documents WHERE lang IS NOT NULL GROUP BY lang), s AS (SELECT code_id, lang, count(DISTINCT doc_id) AS said FROM coded GROUP BY ALL),
 g AS (SELECT * FROM (SELECT DISTINCT code_id FROM coded) CROSS JOIN p) SELECT g.code_id, g.lang, pool, coalesce(said,0) AS said, coalesce(said,0) || '/' || pool AS cell FROM g LEFT JOIN s ON s.code_id=g.code_id AND s.lang=g.lang""")
def _(spark, d):
    return RO.code_by_group(coded(spark, d).drop("lang"), table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "code_id", "lang").select("code_id", "lang", "pool", "said", "cell")


@query("asof_backward_topic", f"""WITH {_EV}, b AS (SELECT user_id, start_s, event_id FROM ev WHERE topic='{BASE}'), b1 AS (SELECT user_id, start_s, max(event_id) AS boundary_id FROM b GROUP BY ALL)
 SELECT ev.event_id, b1.boundary_id FROM ev ASOF LEFT JOIN b1 ON ev.user_id=b1.user_id AND ev.start_s>=b1.start_s""")
def _(spark, d):
    e = events(spark, d)
    bounds = e.where(F.col("topic") == BASE)
    return TL.asof_backward(e, bounds, ["user_id"], "start_s", "start_s", {"event_id": "boundary_id"}, rank="event_id").select("event_id", "boundary_id")


@query("nearest_event", f"""WITH {_EV}, l AS (SELECT * FROM ev WHERE topic='purchase'), r AS (SELECT user_id, start_s, min(event_id) AS near_id FROM ev WHERE topic='{BASE}' GROUP BY ALL),
 j AS (SELECT l.event_id, near_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.start_s-l.start_s), r.start_s) AS n FROM l LEFT JOIN r USING (user_id)) SELECT event_id, near_id FROM j WHERE n=1""")
def _(spark, d):
    e = events(spark, d)
    return TL.nearest(e.where("topic = 'purchase'"), e.where(F.col("topic") == BASE), ["user_id"], "start_s", "start_s", {"event_id": "near_id"}, "event_id").select("event_id", "near_id")


_SPANS = "s AS (SELECT conv_id, turn, coalesce(sum(length(text)+1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS a, length(text) AS n FROM conversations)"


@query("range_join_offset", f"""WITH {_SPANS}, p AS (SELECT DISTINCT conv_id, unnest([0, 100, 400, 900, 2000]) AS off FROM conversations)
 SELECT p.conv_id, CAST(p.off AS BIGINT) AS off, coalesce(max(turn) FILTER (off>=a AND off<a+n), max(turn)) AS turn FROM p JOIN s USING (conv_id) GROUP BY ALL""")
def _(spark, d):
    t = turns(spark, d)
    spans = TL.char_offsets(t, ["conv_id"], ["turn"], "text").select("conv_id", "turn", "off_start", "off_end")
    points = t.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 100, 400, 900, 2000)])).alias("off"))
    return TL.locate_offsets(points, spans, ["conv_id"], "off", take=("turn",))


@query("turn_islands", """WITH c AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w = role THEN 0 ELSE 1 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, role, CAST(sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c""")
def _(spark, d):
    return TL.runs(turns(spark, d), F.col("role"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "run")


@query("gap_islands", f"""WITH {_EV}, m AS (SELECT event_id, user_id, start_s, start_s+tx*600 AS end_s, max(start_s+tx*600) OVER (PARTITION BY user_id ORDER BY start_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev),
 n AS (SELECT *, CASE WHEN start_s-top>21600 THEN 1 ELSE 0 END AS nw FROM m), i AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY start_s, event_id) AS BIGINT) AS island FROM n)
 SELECT user_id, island, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM i GROUP BY ALL""")
def _(spark, d):
    e = events(spark, d).withColumn("end_s", F.col("start_s") + F.col("tx") * 600)
    rows = TL.gap_islands(e, "start_s", "end_s", 21600, ["user_id"], ["start_s", "event_id"])
    return rows.groupBy("user_id", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n"))


@query("sliding_windows", f"""WITH {_EV}, r AS (SELECT event_id, tx*0.05 AS n FROM ev), w AS (SELECT event_id, n, unnest(generate_series(0, CASE WHEN n<=1.5 THEN CASE WHEN n>=0.6 THEN 0 ELSE -1 END ELSE CAST(floor((n-0.6)/0.75) AS BIGINT) END)) AS k FROM r)
 SELECT event_id, CAST(k AS BIGINT) AS window_no, round(k*0.75,4) AS win_start, round(least(k*0.75+1.5, n),4) AS win_end FROM w""")
def _(spark, d):
    e = events(spark, d).select("event_id", F.lit(0.0).alias("start_s"), (F.col("tx") * 0.05).alias("end_s"))
    return TL.sliding_windows(e).select("event_id", F.col("window_no").cast("long").alias("window_no"), F.round("win_start", 4).alias("win_start"), F.round("win_end", 4).alias("win_end"))


@query("units_concat", """WITH c AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w = role THEN 0 ELSE 1 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c) SELECT conv_id, run, role, min(turn) AS first_turn, count(*) AS n_rows, string_agg(text,' ' ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role""")
def _(spark, d):
    return TU.concat_runs(turns(spark, d), ["conv_id"], "role", "turn")


@query("majority_smoothing", f"""WITH {_EV}, o AS (SELECT user_id, event_id, topic, row_number() OVER (PARTITION BY user_id ORDER BY start_s, event_id) AS rn FROM ev),
 j AS (SELECT a.event_id, b.topic AS smoothed, count(*) AS c FROM o a JOIN o b ON a.user_id=b.user_id AND b.rn BETWEEN a.rn-2 AND a.rn+2 GROUP BY ALL)
 SELECT event_id, smoothed FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY c DESC, smoothed) AS n FROM j) WHERE n=1""")
def _(spark, d):
    return TL.majority_smooth(events(spark, d), "topic", ["user_id"], ["start_s", "event_id"]).select("event_id", "smoothed")


@query("rolling_mean_adaptive", f"""WITH {_EV}, c AS (SELECT *, greatest(3, least(9, count(*) OVER (PARTITION BY user_id)//8)) AS w FROM ev) SELECT event_id, round(CASE w {" ".join(f"WHEN {w} THEN avg(ac) OVER (o ROWS BETWEEN {w - 1 - (w - 1) // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING)" for w in range(3, 10))} END,5) AS rolled
 FROM c WINDOW o AS (PARTITION BY user_id ORDER BY start_s, event_id)""")
def _(spark, d):
    return TL.rolling_mean(events(spark, d), "ac", ["user_id"], ["start_s", "event_id"]).select("event_id", F.round("rolled", 5).alias("rolled"))


@query("arc_bins_ci", f"""WITH {_FUSED}, b AS (SELECT *, CAST((5*(row_number() OVER (PARTITION BY user_id, topic ORDER BY start_s, event_id)-1))//count(*) OVER (PARTITION BY user_id, topic) AS INT) AS bin FROM fused WHERE topic<>'{EXCLUDED}'),
 p AS (SELECT topic, bin, user_id, avg(fused_valence) AS m FROM b GROUP BY ALL) SELECT topic, bin, count(*) AS n_people, round(avg(m),5) AS mean, round(avg(m)-1.96*stddev_samp(m)/sqrt(count(*)),5) AS ci_low, round(avg(m)+1.96*stddev_samp(m)/sqrt(count(*)),5) AS ci_high
 FROM p GROUP BY ALL HAVING count(*)>=5""")
def _(spark, d):
    rows = TL.relative_bins(fused(spark, d).where(F.col("topic") != EXCLUDED), ["user_id", "topic"], ["start_s", "event_id"])
    out = RO.arc(rows, "user_id", "topic", "bin", "fused_valence")
    return out.select("topic", "bin", "n_people", *[F.round(c, 5).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query("context_window", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
 SELECT a.conv_id, a.turn, string_agg('[' || upper(substr(b.role,1,1)) || '] ' || b.text, ' || ' ORDER BY b.rn) AS context FROM r a JOIN r b ON a.conv_id=b.conv_id AND b.rn BETWEEN a.rn-2 AND a.rn+2 GROUP BY a.conv_id, a.turn""")
def _(spark, d):
    return TL.context(turns(spark, d), ["conv_id"], ["turn"], "role", "text").select("conv_id", "turn", "context")


@query("lag_lead_prev_next", "SELECT conv_id, turn, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM conversations WHERE role='user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    return TL.neighbours(turns(spark, d).where("role = 'user'"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "prev_text", "next_text")


@query("interpolate_anchors", f"""WITH {_EV}, o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start_s, event_id) AS pos, CASE WHEN topic='{BASE}' THEN ac END AS v FROM ev),
 p AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS pa, min(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM o),
 q AS (SELECT p.*, a.v AS va, b.v AS vb FROM p LEFT JOIN o a ON a.user_id=p.user_id AND a.pos=p.pa LEFT JOIN o b ON b.user_id=p.user_id AND b.pos=p.pb)
 SELECT event_id, round(coalesce(va+coalesce((pos-pa)/nullif(CAST(pb-pa AS DOUBLE),0),0)*(vb-va), va, vb),8) AS filled FROM q""")
def _(spark, d):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("start_s", "event_id")).cast("long")
    rows = events(spark, d).withColumn("pos", pos).withColumn("v", F.when(F.col("topic") == BASE, F.col("ac")))
    return TL.interpolate(rows, "v", "pos", ["user_id"]).select("event_id", F.round("filled", 8).alias("filled"))


@query("role_assignment", """WITH f AS (SELECT conv_id, arg_min(role, turn) FILTER (text LIKE '% with %') AS slate_spk, arg_min(role, turn) FILTER (text LIKE '% what %') AS consent_spk FROM conversations GROUP BY conv_id),
 q AS (SELECT conv_id, role, avg(CAST(contains(text,'?') AS INT)) AS rate FROM conversations GROUP BY ALL), m AS (SELECT conv_id, role AS asker FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rate DESC, role) AS n FROM q) WHERE n=1),
 r AS (SELECT f.*, coalesce(slate_spk, asker) AS interviewer FROM f JOIN m USING (conv_id)) SELECT r.conv_id, slate_spk, consent_spk, interviewer, round(rate,4) AS question_rate, consent_spk IS NULL OR consent_spk<>interviewer AS consent_agrees
 FROM r LEFT JOIN q ON q.conv_id=r.conv_id AND q.role=r.interviewer""")
def _(spark, d):
    out = TU.assign_roles(turns(spark, d), "conv_id", "role", "turn", "text", slate=" with ", consent=" what ")
    return out.select("conv_id", "slate_spk", "consent_spk", "interviewer", F.round("question_rate", 4).alias("question_rate"), "consent_agrees")


_SPOKEN = """spoken AS (SELECT conv_id, turn, role, CASE WHEN conv_id%3=0 THEN 'my study ID is PN-0O' || conv_id || '8 ok' WHEN conv_id%3=1 THEN 'study iv is P p.m. ' || conv_id ELSE 'PIN ' || conv_id END AS text FROM conversations)"""


@query("id_recovery", f"""WITH {_SPOKEN}, e AS (SELECT conv_id, role, turn, CASE WHEN regexp_matches(text, '(?i)study\\s*(?:id|iv|i\\.\\s*d\\.?)|i consent to participat') THEN nullif(regexp_extract(text, '(?i)\\b' || '{T.PREFIX}' || '{T.BODY}', 1),'') END AS a,
 nullif(regexp_extract(text, '(?i)study\\s*(?:id|iv)\\s*(?:is\\s*)?(?:' || '{T.PREFIX}' || ')?' || '{T.BODY}', 1),'') AS b FROM spoken),
 n AS (SELECT *, regexp_replace(translate(a,'Oo','00'),'[^0-9]','','g') AS da, regexp_replace(translate(b,'Oo','00'),'[^0-9]','','g') AS db FROM e),
 f AS (SELECT conv_id, role, arg_min(da,turn) FILTER (length(da)>0) AS da, arg_min(db,turn) FILTER (length(db)>0) AS db FROM n GROUP BY ALL)
 SELECT conv_id, role, 'PN' || lpad(substr(coalesce(da,db),1,3),3,'0') AS participant_id, CASE WHEN da IS NOT NULL THEN length(da)>3 ELSE true END AS id_needs_review FROM f WHERE da IS NOT NULL OR db IS NOT NULL""")
def _(spark, d):
    n = F.col("conv_id").cast("string")
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("my study ID is PN-0O"), n, F.lit("8 ok"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("study iv is P p.m. "), n)).otherwise(F.concat(F.lit("PIN "), n))
    return TU.recover_ids(turns(spark, d).select("conv_id", "turn", "role", said.alias("text")), "conv_id", "role", "turn", "text")


@query("deidentify", f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{T.EMAIL}', '[EMAIL]', 'g'), '{T.PHONE}', '[PHONE]', 'g')) AS redacted_md5 FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(T.redact(F.col("text")), "utf-8")).alias("redacted_md5"))


@query("tokenise_word_stats", f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_distinct, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def _(spark, d):
    w = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"), F.length("text").cast("long").alias("n_chars"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), "n_chars")


@query("sentence_split_chop", r"""WITH s AS (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x<>'')) AS s FROM conversations),
 w AS (SELECT conv_id, turn, string_split_regex(s, '\s+') AS w FROM s), c AS (SELECT conv_id, turn, w, unnest(generate_series(0, (len(w)-1)//45)) AS k FROM w)
 SELECT conv_id, turn, count(*) AS n_units, CAST(max(least(45, len(w)-45*k)) AS BIGINT) AS longest FROM c GROUP BY ALL""")
def _(spark, d):
    rows = T.sentences(turns(spark, d), "text")
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_units"), F.max(F.size(F.split("sentence", " "))).cast("long").alias("longest"))


_CUES = [("one", [" with ", " for "]), ("two", [" what ", " that "]), ("three", [" from ", " this "]), ("four", [" was ", " are "])]


def _cue_sql() -> str:
    """One step for each section: offset and end of the earliest cue after the end of the one before."""
    sql = "WITH st0 AS (SELECT conv_id, string_agg(t,' ' ORDER BY turn) AS s, 0 AS f FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\b(the )?(EU|E\\.?D\\.?|AD|EV|ADE)\\b', '\\1ED', 'g'), '\\s+', ' ', 'g')) AS t FROM conversations) WHERE length(t)>0 GROUP BY conv_id)"
    for k, (_, cues) in enumerate(_CUES):
        at = [f"nullif(strpos(lower(substr(s,f+1)),'{c}'),0)" for c in cues]
        n = " ".join(f"WHEN {a}=least({', '.join(at)}) THEN {len(c)}" for a, c in zip(at, cues))
        sql += f", st{k + 1} AS (SELECT * EXCLUDE (f), CASE WHEN m IS NULL THEN f ELSE f+m-1+ln END AS f FROM (SELECT * EXCLUDE (at_, ln_), at_ AS m, f+at_-1 AS off{k}, ln_ AS ln FROM (SELECT *, least({', '.join(at)}) AS at_, CASE {n} END AS ln_ FROM (SELECT {'* EXCLUDE (m, ln)' if k else '*'} FROM st{k}))))"
    return sql + " " + " UNION ALL ".join(f"SELECT conv_id, {k} AS rank, '{name}' AS topic, CAST(off{k} AS BIGINT) AS char_offset FROM st{len(_CUES)} WHERE off{k} IS NOT NULL" for k, (name, _) in enumerate(_CUES))


@query("ordered_cue_segments", _cue_sql())
def _(spark, d):
    return TU.topic_boundaries(turns(spark, d), "conv_id", "turn", "text", _CUES).select("conv_id", "rank", "topic", F.col("offset").cast("long").alias("char_offset"))


@query("wer_by_role")
def _(spark, d):
    rows = turns(spark, d)
    heard = F.regexp_replace(F.regexp_replace("text", r"\bthe\b", "a"), r"\bto \b", "")
    joined = TU.concat_runs(rows.withColumn("all", F.lit(1)).withColumn("pair", F.struct("text")).select("conv_id", "turn", "role", "text"), ["conv_id", "role"], "role", "turn")
    return AL.wer(joined.withColumn("heard", heard).groupBy("conv_id", F.col("role").alias("speaker_role")).agg(F.first("text").alias("text"), F.first("heard").alias("heard")), ["conv_id", "speaker_role"], "text", "heard").withColumn("wer", F.round("wer", 6))


@query("align_times")
def _(spark, d):
    rows = turns(spark, d)
    words = rows.select("conv_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("i", "w"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")) / 3.0
    spoken = words.select("conv_id", "w", at.alias("s"), (at + 0.3).alias("e")).where("hash(w) % 10 <> 0")
    return AL.align(rows.select("conv_id", "turn", "text"), spoken, "conv_id", "turn", "text").select("conv_id", "turn", *[F.round(c, 4).alias(c) for c in ("start_s", "end_s", "coverage")])


_BINS = _FUSED + ", q AS (SELECT quantile_cont(fused_valence,1/3) AS q1, quantile_cont(fused_valence,2/3) AS q2 FROM fused), b AS (SELECT fused.*, CASE WHEN fused_valence<=q1 THEN 'low' WHEN fused_valence<=q2 THEN 'mid' ELSE 'high' END AS val_bin FROM fused, q)"
_STRATA = _BINS + ", k AS (SELECT *, md5(CAST(event_id AS VARCHAR) || '-7') AS h FROM b), p AS (SELECT greatest(1, 400//count(*)) AS per FROM (SELECT DISTINCT topic, val_bin FROM b)), st AS (SELECT k.* FROM (SELECT *, row_number() OVER (PARTITION BY topic, val_bin ORDER BY h, event_id) AS n FROM k) k, p WHERE n<=per)"


@query("quantile_bins", f"WITH {_BINS} SELECT topic, val_bin, count(*) AS n FROM b GROUP BY ALL")
def _(spark, d):
    return S.quantile_bins(fused(spark, d), "fused_valence").groupBy("topic", "val_bin").agg(F.count("*").alias("n"))


@query("stratified_sample", f"WITH {_STRATA} SELECT event_id, topic, val_bin FROM st")
def _(spark, d):
    rows = S.quantile_bins(fused(spark, d), "fused_valence")
    return FU.stratified_sample(rows, ["topic", "val_bin"], 400, "event_id").select("event_id", "topic", "val_bin")


@query("forced_sample", f"""WITH {_STRATA}, fo AS (SELECT *, md5(CAST(event_id AS VARCHAR) || '-11') AS h2 FROM b WHERE discord_flag=1 AND event_id%10=0),
 ot AS (SELECT event_id, topic, discord_flag, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || '-11'), event_id) AS r FROM st WHERE event_id NOT IN (SELECT event_id FROM fo))
 SELECT event_id, topic, discord_flag FROM fo UNION ALL SELECT event_id, topic, discord_flag FROM ot WHERE r<=greatest(400,(SELECT count(*) FROM fo))-(SELECT count(*) FROM fo)""")
def _(spark, d):
    rows = S.quantile_bins(fused(spark, d), "fused_valence")
    forced = rows.where("discord_flag = 1")
    return FU.forced_sample(FU.stratified_sample(rows, ["topic", "val_bin"], 400, "event_id"), forced, 400, "event_id").select("event_id", "topic", "discord_flag")


@query("crosstab_flags", "SELECT quality, count(*) FILTER (toxic=0) AS toxic_0, count(*) FILTER (toxic=1) AS toxic_1 FROM labels WHERE quality IS NOT NULL GROUP BY quality")
def _(spark, d):
    return S.crosstab(table(spark, d, "labels"), "quality", "toxic", [0, 1]).withColumnsRenamed({"0": "toxic_0", "1": "toxic_1"})


@query("agreement_rates", "SELECT count(*) AS n, round(avg(CAST(quality=1-toxic AS INT)),5) AS exact, round(avg(CAST(abs(quality-(1-toxic))<=1 AS INT)),5) AS within_one, round(corr(quality, 1-toxic),5) AS r FROM labels")
def _(spark, d):
    rows = table(spark, d, "labels").withColumn("clean", 1 - F.col("toxic"))
    return S.agreement(rows, "quality", "clean").select("n", *[F.round(c, 5).alias(c) for c in ("exact", "within_one", "r")])


@query("corr_checks", """WITH p AS (SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, 'positive' AS expected, round(corr(l_quantity, l_extendedprice),4) AS r, count(*) AS n FROM lineitem
 UNION ALL SELECT 'l_discount', 'l_tax', 'either', round(corr(l_discount, l_tax),4), count(*) FROM lineitem UNION ALL SELECT 'l_quantity', 'neg_price', 'positive', round(corr(l_quantity, -l_extendedprice),4), count(*) FROM lineitem)
 SELECT *, CASE WHEN expected<>'positive' OR r>0 THEN 'OK' ELSE 'CHECK ALIGNMENT' END AS verdict FROM p""")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("neg_price", -F.col("l_extendedprice"))
    out = R.corr_checks(rows, [("l_quantity", "l_extendedprice", "positive"), ("l_discount", "l_tax", "either"), ("l_quantity", "neg_price", "positive")])
    return out.select("x", "y", "expected", F.round("r", 4).alias("r"), "n", "verdict")


@query("describe_iqr", " UNION ALL ".join(f"SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}),4) AS mean, round(stddev_samp({c}),4) AS sd, min({c})::DOUBLE AS min, round(quantile_cont({c},0.25),4) AS q25, round(quantile_cont({c},0.5),4) AS q50, round(quantile_cont({c},0.75),4) AS q75, max({c})::DOUBLE AS max, round(quantile_cont({c},0.75)-quantile_cont({c},0.25),4) AS iqr FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(spark, d):
    out = S.describe_iqr(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "q25", "q50", "q75", "iqr")})


@query("top_k_worst", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def _(spark, d):
    return R.top_k(table(spark, d, "orders"), "o_totalprice", 5, "o_orderkey", largest=False).select("o_orderkey", "o_totalprice")


@query("reconcile_ids", """SELECT 'only_left' AS status, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'only_right', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)
 UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""")
def _(spark, d):
    return RO.reconcile(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("status", "n")


@query("demographic_normalise", """SELECT g AS occupation_group, count(*) AS n, count(*)>=5 AS testable FROM (SELECT CASE trim(c_mktsegment) WHEN 'BUILDING' THEN 'trade' WHEN 'MACHINERY' THEN 'industry' WHEN 'AUTOMOBILE' THEN 'industry' ELSE CASE WHEN trim(c_mktsegment)<>'' THEN 'other' END END AS g FROM customer) WHERE g IS NOT NULL GROUP BY g""")
def _(spark, d):
    rows = R.pool_groups(table(spark, d, "customer"), "c_mktsegment", {"BUILDING": "trade", "MACHINERY": "industry", "AUTOMOBILE": "industry"}, "other", "occupation_group")
    return R.group_counts(rows, "occupation_group")


@query("compare_reference", f"""WITH {_CODED}, f AS (SELECT code_id, 100*count(DISTINCT source)/(SELECT count(DISTINCT source) FROM documents) AS pct FROM coded GROUP BY code_id), r AS (SELECT * FROM (VALUES ('A1',100.0),('A2',20.0),('B1',55.0),('C9',40.0)) AS t(code_id, ref_pct)),
 j AS (SELECT r.code_id, CAST(ref_pct AS DOUBLE) AS ref_pct, coalesce(pct,0.0) AS pct FROM r LEFT JOIN f USING (code_id)) SELECT code_id, ref_pct, round(pct,4) AS pct, row_number() OVER (ORDER BY pct DESC, code_id) AS rank, round(pct-ref_pct,4) AS gap, pct-ref_pct < -25 AS alarm, pct=0 AS absent FROM j""")
def _(spark, d):
    found = RO.code_frequency(coded(spark, d), "source", "code_id", table(spark, d, "documents")).select("code_id", F.col("pct_people").alias("pct"))
    reference = spark.createDataFrame([("A1", 100.0), ("A2", 20.0), ("B1", 55.0), ("C9", 40.0)], "code_id string, ref_pct double")
    out = RO.compare_reference(found, reference, "code_id", "pct", "ref_pct")
    return out.select("code_id", "ref_pct", F.round("pct", 4).alias("pct"), "rank", F.round("gap", 4).alias("gap"), "alarm", "absent")


@query("speaker_share_minor", """WITH s AS (SELECT conv_id, role, sum(length(text)) AS a FROM conversations WHERE role<>'assistant' GROUP BY ALL), t AS (SELECT *, a/sum(a) OVER (PARTITION BY conv_id) AS share FROM s)
 SELECT conv_id, role, CAST(a AS BIGINT) AS amount, round(share,5) AS share FROM t WHERE share<0.3""")
def _(spark, d):
    rows = turns(spark, d).withColumn("n", F.length("text").cast("long"))
    return TU.minor_speakers(rows, "conv_id", "role", "n", "assistant", 0.3).select("conv_id", "role", "amount", F.round("share", 5).alias("share"))


@query("cosine_affinity_topk", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x,x))+1e-9 AS n FROM e),
 p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_dot_product(a.x,b.x)/(a.n*b.n) AS c FROM u a JOIN u b ON a.label=b.label AND a.vec_id<>b.vec_id)
 SELECT label, a, b, round(c,5) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c,9) DESC, b) AS rank FROM p) WHERE rank<=3""")
def _(spark, d):
    e = AL.unit_vectors(table(spark, d, "embeddings"), "embedding")
    return R.cosine_topk(e, "label", "vec_id", "unit").withColumn("cosine", F.round("cosine", 5))


@query("spectral_speakers")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("session", F.floor(F.col("vec_id") / 100).cast("long"))
    return AL.spectral_speakers(e, "session", "vec_id", "embedding")


_LEX = "list_transform(string_split_regex(lower(text), '\\s+'), lambda x: regexp_replace(x, '[.,!?]+$', ''))"


@query("sentiment_stance", f"""WITH w AS (SELECT doc_id, text, exp(least(len(list_filter(w, lambda x: list_contains({NEGATIVE!r}, x))),20)) AS a, exp(least(len(list_filter(w, lambda x: list_contains({POSITIVE!r}, x))),20)) AS b FROM (SELECT doc_id, text, {_LEX} AS w FROM documents)),
 p AS (SELECT doc_id, a/(a+b+exp(1)) AS n, exp(1)/(a+b+exp(1)) AS u, b/(a+b+exp(1)) AS p FROM w WHERE trim(text)<>'')
 SELECT doc_id, round(p-n,5) AS tx_valence, CASE WHEN n>=u AND n>=p THEN 'negative' WHEN u>=p THEN 'neutral' ELSE 'positive' END AS tx_emotion_label, CASE WHEN greatest(n,u,p)<0.5 THEN 'mixed' WHEN n>=u AND n>=p THEN 'negative' WHEN u>=p THEN 'neutral' ELSE 'positive' END AS tx_stance FROM p""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").where(F.trim("text") != "")
    return LexiconSentiment(POSITIVE, NEGATIVE).apply(docs, "text").select("doc_id", F.round("tx_valence", 5).alias("tx_valence"), "tx_emotion_label", "tx_stance")


@query("llm_output_validate", """SELECT 'u' || doc_id AS utt_id, CASE WHEN doc_id%2=0 THEN 'A1' ELSE '' END AS code_ids, CASE WHEN doc_id%2=0 THEN 1 ELSE 0 END AS n_codes, CASE WHEN doc_id%3=0 THEN 'positive' ELSE 'neutral' END AS llm_stance,
 CASE WHEN doc_id%5=0 THEN NULL ELSE 'abc' END AS key_phrase, doc_id%5<>0 AS phrase_ok, CASE WHEN doc_id%2=0 THEN 'high' ELSE 'medium' END AS code_confidence FROM documents WHERE doc_id%7<>0""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    item = F.concat(
        F.lit('```json\nHere: [{"utt_id": "u'), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""), F.lit('", "topics": ["Z9"'), F.when(F.col("doc_id") % 2 == 0, ', "A1"').otherwise(""),
        F.lit('], "stance": "'), F.when(F.col("doc_id") % 3 == 0, "positive").otherwise("angry"), F.lit('", "key_phrase": "'), F.when(F.col("doc_id") % 5 == 0, "zzz").otherwise("abc"), F.lit('"'), F.when(F.col("doc_id") % 2 == 0, ', "confidence": "high"').otherwise(""), F.lit("}]\n```"),
    )
    valid = docs.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("utt_id"), F.lit("so abc then").alias("text"))
    return validate_codes(docs.select(item.alias("reply")), "reply", valid, ["A1", "B1"], "text")


@query("mixed_model_terms")
def _(spark, d):
    out = M.mixed_model(fused(spark, d).where(F.col("topic") != EXCLUDED), "fused_valence", ["topic"], "user_id", "within")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("log_price", F.log("o_totalprice"))
    out = out.unionByName(M.mixed_model(o, "log_price", ["c_mktsegment"], "o_custkey", "between"))
    return out.withColumns({c: F.round(c, 5) for c in ("estimate", "ci_low", "ci_high", "p", "icc")})


@query("variance_parts", f"""WITH {_FUSED}, g AS (SELECT user_id, count(*) AS n, avg(fused_valence) AS m, var_samp(fused_valence) AS v FROM fused GROUP BY user_id)
 SELECT round(stddev_samp(m),5) AS between_sd, round(sqrt(sum((n-1)*v) FILTER (n>1)/sum(n-1) FILTER (n>1)),5) AS within_sd, count(*) AS n_groups FROM g""")
def _(spark, d):
    return M.variance_parts(fused(spark, d), "fused_valence", "user_id").select(F.round("between_sd", 5).alias("between_sd"), F.round("within_sd", 5).alias("within_sd"), "n_groups")


@query("audio_qc_frames", """WITH q AS (SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_extendedprice) AS mx, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice,0.1) AS q1, quantile_cont(l_extendedprice,0.95) AS q9 FROM lineitem GROUP BY ALL)
 SELECT q.l_returnflag, q.l_linestatus, n, round(10*log10(mx),4) AS peak_db, round(10*log10(mean),4) AS rms_db, round(10*log10(q9)-10*log10(q1),4) AS snr_est_db, round((SELECT avg(CAST(l.l_extendedprice>=q1*pow(10,1.2) AS INT)) FROM lineitem l WHERE l.l_returnflag=q.l_returnflag AND l.l_linestatus=q.l_linestatus),4) AS speech_frac FROM q""")
def _(spark, d):
    out = R.frame_percentiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("peak_db", "rms_db", "snr_est_db", "speech_frac")})


@query("rollup_levels", f"WITH {_FUSED} SELECT user_id, topic, count(*) AS n, round(avg(fused_valence),5) AS mean, CAST(grouping(user_id, topic) AS BIGINT) AS level FROM fused GROUP BY ROLLUP (user_id, topic)")
def _(spark, d):
    return RO.rollup_levels(fused(spark, d), ["user_id", "topic"], "fused_valence").withColumn("mean", F.round("mean", 5))


@query("tumbling_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = SW.tumbling(e, "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("session_windows", """WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM l) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, i""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return SW.sessions(e, "ts", "6 hours", ["user_id"], [F.count("*").alias("n")]).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("turn_chunks", """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS p, count(*) OVER (PARTITION BY conv_id)-1 AS last FROM conversations), c AS (SELECT *, p//3 AS chunk, last//3 AS lc FROM r)
 SELECT conv_id, turn, chunk, true AS is_target FROM c UNION ALL SELECT conv_id, turn, chunk+1, false FROM c WHERE p%3>=1 AND chunk+1<=lc UNION ALL SELECT conv_id, turn, chunk-1, false FROM c WHERE p%3<1 AND chunk>=1""")
def _(spark, d):
    return TU.turn_chunks(turns(spark, d), ["conv_id"], ["turn"], size=3).select("conv_id", "turn", "chunk", "is_target")


@query("stance_shares", f"""WITH {_FUSED}, e AS (SELECT user_id, stance, count(*) AS c FROM fused WHERE stance IS NOT NULL GROUP BY ALL), o AS (SELECT *, c/sum(c) OVER (PARTITION BY user_id) AS own FROM e)
 SELECT stance, round(sum(c)/(SELECT sum(c) FROM e),5) AS pooled, round(sum(own)/(SELECT count(DISTINCT user_id) FROM e),5) AS per_person FROM o GROUP BY stance""")
def _(spark, d):
    out = RO.stance_shares(fused(spark, d), "user_id", "stance")
    return out.select("stance", F.round("pooled", 5).alias("pooled"), F.round("per_person", 5).alias("per_person"))


@query("case_people", f"""WITH {_FUSED}, s AS (SELECT user_id, count(*) AS n, stddev_samp(fused_valence) AS sd FROM fused GROUP BY user_id HAVING count(*)>=25)
 SELECT user_id, n, round(sd,5) AS sd, 'most_variable' AS "case" FROM (SELECT * FROM s ORDER BY sd DESC, user_id LIMIT 2) UNION ALL SELECT user_id, n, round(sd,5), 'least_variable' FROM (SELECT * FROM s ORDER BY sd, user_id LIMIT 1)""")
def _(spark, d):
    return RO.case_people(fused(spark, d), "user_id", "fused_valence").withColumn("sd", F.round("sd", 5))


@query("value_shares", "SELECT lang AS value, count(*) AS n, round(count(*)/sum(count(*)) OVER (),6) AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def _(spark, d):
    return S.value_counts(table(spark, d, "documents"), "lang").withColumn("share", F.round("share", 6))


@query("krippendorff_alpha", """WITH r AS (SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, 1-toxic FROM labels), p AS (SELECT doc_id, v, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS m FROM p),
 o AS (SELECT sum(n*(m-n)/(m-1)) AS o, sum(n) AS t FROM m WHERE m>1), c AS (SELECT sum(k*k) AS s FROM (SELECT v, sum(n) AS k FROM m WHERE m>1 GROUP BY v)) SELECT round(1-o/((t*t-s)/(t-1)),6) AS alpha, CAST(t AS BIGINT) AS n_ratings FROM o, c""")
def _(spark, d):
    rows = table(spark, d, "labels")
    both = rows.select("doc_id", F.col("quality").alias("v")).unionByName(rows.select("doc_id", (1 - F.col("toxic")).alias("v")))
    return S.krippendorff_alpha(both, "doc_id", "v").withColumn("alpha", F.round("alpha", 6))


from . import dimensions, planted, views, worksheets  # noqa: E402,F401  they register their queries
