"""Further registered queries: worksheets, words to units, samples for raters, figure frames, intake and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scorers as SC
from ..functions import text as T
from ..operators import fusion as FU
from ..operators import reports as R
from ..operators import rollup as RO
from ..operators import stats as S
from ..operators import timeline as TL
from ..operators import turns as TU
from ..sources import tables as ST
from ..sources.documents import device_label
from ..sources.tables import table
from .catalog import _CODED, _EV, _FUSED, _STRATA, EXCLUDED, coded, events, fused, query, turns

# Words of the conversations with times: three a second, each lasting 0.3 s, a pause of 2 s before every tenth turn's words.
_WORDS = r"""words AS (SELECT conv_id, turn, role, w, CAST(i AS BIGINT) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i)/3.0 + 2*turn AS s FROM
 (SELECT conv_id, turn, role, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT *, string_split_regex(text, '\s+') AS x FROM conversations)))"""


def words(spark, d):
    from pyspark.sql import Window

    rows = turns(spark, d).select("conv_id", "turn", "role", F.posexplode(F.split("text", r"\s+")).alias("i", "w"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")) / 3.0 + 2 * F.col("turn")
    return rows.withColumn("s", at).withColumn("e", F.col("s") + 0.3)


@query("speech_regions", f"""WITH {_WORDS}, m AS (SELECT *, s+0.3 AS e, max(s+0.3) OVER (PARTITION BY conv_id ORDER BY s, s+0.3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM words),
 i AS (SELECT *, CAST(sum(CASE WHEN s-top>0.35 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY s, e) AS BIGINT) AS island FROM m)
 SELECT conv_id, island, round(min(s),4) AS start_s, round(max(e),4) AS end_s FROM i GROUP BY ALL HAVING max(e)-min(s)>=0.2""")
def _(spark, d):
    out = TL.speech_regions(words(spark, d), ["conv_id"])
    return out.select("conv_id", "island", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"))


@query("speaker_turns", f"""WITH {_WORDS}, m AS (SELECT *, CASE WHEN lag(role) OVER o IS NULL THEN 0 WHEN lag(role) OVER o=role AND s-(lag(s) OVER o+0.3)<=1.5 THEN 0 ELSE 1 END AS nw FROM words WINDOW o AS (PARTITION BY conv_id ORDER BY s, i)),
 t AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY conv_id ORDER BY s, i) AS BIGINT) AS turn_index FROM m) SELECT conv_id, turn_index, any_value(role) AS role, count(*) AS n_words FROM t GROUP BY conv_id, turn_index""")
def _(spark, d):
    out = TL.speaker_turns(words(spark, d), ["conv_id"], "role", "s", "e", ["s", "i"])
    return out.groupBy("conv_id", "turn_index").agg(F.first("role").alias("role"), F.count("*").alias("n_words"))


@query("build_units", f"""WITH {_WORDS}, k AS (SELECT *, CASE WHEN lag(role) OVER o IS NULL OR (lag(role) OVER o=role AND lag(turn//2) OVER o=turn//2) THEN 0 ELSE 1 END AS nw FROM words WINDOW o AS (PARTITION BY conv_id ORDER BY s, i)),
 u AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY conv_id ORDER BY s, i) AS BIGINT) AS unit FROM k) SELECT conv_id, unit, any_value(role) AS role, round(min(s),4) AS start_s, md5(trim(string_agg(w,'' ORDER BY s, i))) AS text_md5 FROM u GROUP BY conv_id, unit HAVING trim(string_agg(w,''))<>''""")
def _(spark, d):
    rows = words(spark, d).withColumn("seg", F.floor(F.col("turn") / 2))
    out = TU.build_units(rows, ["conv_id"], ["role", "seg"], ["s", "i"])
    return out.select("conv_id", "unit", "role", F.round("start_s", 4).alias("start_s"), F.md5(F.encode("text", "utf-8")).alias("text_md5"))


@query("backchannel_flags", "SELECT conv_id, turn, CASE WHEN length(text)/15.0 < 1.0 OR len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x<>'')) < 3 THEN 1 ELSE 0 END AS is_backchannel FROM conversations")
def _(spark, d):
    rows = turns(spark, d).withColumn("duration_s", F.length("text") / 15.0).withColumn("n_words", T.n_words(F.trim("text")))
    return rows.select("conv_id", "turn", FU.backchannel().alias("is_backchannel"))


@query("analysable_rows", f"WITH {_EV} SELECT topic, count(*) AS n FROM ev WHERE user_id%3<>0 AND tx>=10 GROUP BY topic")
def _(spark, d):
    rows = events(spark, d).withColumn("speaker_role", F.when(F.col("user_id") % 3 == 0, "interviewer").otherwise("participant")).withColumn("is_backchannel", (F.col("tx") < 10).cast("int"))
    return rows.where(FU.analysable()).groupBy("topic").agg(F.count("*").alias("n"))


@query("numbered_ids", "SELECT conv_id, turn, 'C' || conv_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 4, '0') AS utt_id FROM conversations")
def _(spark, d):
    rows = turns(spark, d).withColumn("session", F.concat(F.lit("C"), F.col("conv_id").cast("string")))
    return TL.numbered_ids(rows, "session", ["turn"]).select("conv_id", "turn", "utt_id")


@query("dedupe_first", f"WITH {_EV} SELECT user_id, topic, arg_min(event_id, (start_s, event_id)) AS event_id FROM ev GROUP BY ALL")
def _(spark, d):
    return TL.dedupe_first(events(spark, d), ["user_id", "topic"], ["start_s", "event_id"]).select("user_id", "topic", "event_id")


@query("sentences_to_turns", f"""WITH {_WORDS} SELECT conv_id, turn, min(i) AS first_word, count(*) AS n_sentences, md5(string_agg(w,' ' ORDER BY s, i)) AS text_md5, min(CASE WHEN length(w)<3 THEN 1 ELSE 0 END) AS is_backchannel FROM words GROUP BY ALL""")
def _(spark, d):
    rows = words(spark, d).withColumn("i", F.col("i").cast("long")).withColumn("b", F.when(F.length("w") < 3, 1).otherwise(0))
    out = TU.sentences_to_turns(rows, ["conv_id", "turn"], "s", "i", "w", "b")
    return out.select("conv_id", "turn", F.col("i").alias("first_word"), "n_sentences", F.md5(F.encode("w", "utf-8")).alias("text_md5"), F.col("b").alias("is_backchannel"))


@query("annotation_sample", f"""WITH {_STRATA.replace("PARTITION BY topic, val_bin", "PARTITION BY lane, topic, val_bin").replace("DISTINCT topic, val_bin", "DISTINCT lane, topic, val_bin").replace("b AS (SELECT fused.*", "b AS (SELECT user_id%2 AS lane, fused.*")}, fo AS (SELECT event_id FROM b WHERE discord_flag=1),
 ot AS (SELECT event_id, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || '-7'), event_id) AS r FROM st WHERE event_id NOT IN (SELECT event_id FROM fo)), s AS (SELECT event_id FROM fo UNION ALL SELECT event_id FROM ot WHERE r<=greatest(400,(SELECT count(*) FROM fo))-(SELECT count(*) FROM fo))
 SELECT event_id, '' AS rater1_valence, '' AS consensus FROM s""")
def _(spark, d):
    rows = fused(spark, d).withColumn("lane", F.col("user_id") % 2)
    return FU.annotation_sample(rows, "lane", "topic", "fused_valence", "discord_flag", "event_id").select("event_id", "rater1_valence", "consensus")


@query("listening_sheet", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, conv_id*1000+turn AS k, length(text) AS n FROM conversations), t AS (SELECT * FROM r ORDER BY n DESC, k LIMIT 30)
 SELECT t.conv_id, t.turn, md5(string_agg('[' || upper(substr(b.role,1,1)) || '] ' || b.text, ' || ' ORDER BY b.rn)) AS context_md5, '' AS heard_emotion FROM t JOIN r b ON t.conv_id=b.conv_id AND b.rn BETWEEN t.rn-2 AND t.rn+2 GROUP BY t.conv_id, t.turn""")
def _(spark, d):
    rows = turns(spark, d).withColumn("n", F.length("text")).withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    out = R.listening_sheet(rows, ["conv_id"], ["turn"], "role", "text", "n", "k")
    return out.select("conv_id", "turn", F.md5(F.encode("context", "utf-8")).alias("context_md5"), "heard_emotion")


@query("scheme_compare", f"""WITH {_FUSED}, s AS (SELECT CAST(round_even(ac_z,0) AS INT) AS a, CAST(round_even(tx_z,0) AS INT) AS b FROM fused) SELECT count(*) AS n, round(avg(CAST(a=b AS INT)),5) AS exact, round(avg(CAST(abs(a-b)<=1 AS INT)),5) AS within_one, round(corr(a,b),5) AS r FROM s""")
def _(spark, d):
    rows = fused(spark, d).withColumn("a", F.rint("ac_z").cast("int")).withColumn("b", F.rint("tx_z").cast("int"))
    return R.scheme_compare(rows, "a", "b", "discord_flag", "stance")["agreement"].select("n", *[F.round(c, 5).alias(c) for c in ("exact", "within_one", "r")])


@query("repeat_consistency", "SELECT count(*) AS n, round(avg(CAST(a.quality=b.toxic AS INT)),5) AS exact, round(avg(CAST(abs(a.quality-b.toxic)<=1 AS INT)),5) AS within_one, round(corr(a.quality,b.toxic),5) AS r FROM labels a JOIN labels b ON a.doc_id=b.doc_id")
def _(spark, d):
    rows = table(spark, d, "labels")
    out = R.repeat_consistency(rows.select("doc_id", F.col("quality").alias("x")), rows.select("doc_id", F.col("toxic").alias("x")), "doc_id", "x")
    return out.select("n", *[F.round(c, 5).alias(c) for c in ("exact", "within_one", "r")])


@query("rating_clip", "SELECT doc_id, CAST(greatest(-2, least(2, doc_id%9-4)) AS INT) AS llm_valence, CAST(greatest(0, least(2, doc_id%5-1)) AS INT) AS llm_arousal, coalesce(CASE WHEN doc_id%3=0 THEN false END, true) AS llm_agree FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", (i % 9 - 4).alias("llm_valence"), (i % 5 - 1).alias("llm_arousal"), F.when(i % 3 == 0, False).alias("llm_agree"), F.lit("because").alias("llm_reasoning"))
    return SC.clip_ratings(rows).drop("llm_reasoning")


@query("theme_prevalence", f"WITH {_CODED} SELECT code_id, count(*) AS n_mentions, count(DISTINCT source) AS n_people, round(100*count(DISTINCT source)/(SELECT count(DISTINCT source) FROM coded),4) AS pct_people FROM coded GROUP BY code_id HAVING count(DISTINCT source)>=2")
def _(spark, d):
    return RO.theme_prevalence(coded(spark, d), "source", "code_id").withColumn("pct_people", F.round("pct_people", 4))


@query("topic_means_people", f"WITH {_FUSED} SELECT topic, round(avg(fused_valence),4) AS mean_tone, round(avg(fused_arousal),4) AS mean_energy, count(DISTINCT user_id) AS n_people FROM fused WHERE topic<>'{EXCLUDED}' GROUP BY topic")
def _(spark, d):
    rows = fused(spark, d).where(F.col("topic") != EXCLUDED)
    return rows.groupBy("topic").agg(F.round(F.avg("fused_valence"), 4).alias("mean_tone"), F.round(F.avg("fused_arousal"), 4).alias("mean_energy"), F.count_distinct("user_id").alias("n_people"))


@query("discord_limits", f"WITH {_FUSED} SELECT discord_flag, count(*) AS n, round(quantile_cont(greatest(abs(ac_z),abs(tx_z)),0.99),4) AS p99 FROM fused GROUP BY discord_flag HAVING count(*)>=20")
def _(spark, d):
    rows = fused(spark, d).groupBy("discord_flag").agg(F.count("*").alias("n"))
    top = S.group_quantiles(fused(spark, d).withColumn("top", F.greatest(F.abs("ac_z"), F.abs("tx_z"))), ["discord_flag"], "top", [0.99])
    return rows.where("n >= 20").join(F.broadcast(top), "discord_flag").select("discord_flag", "n", F.round(F.col("q")[0], 4).alias("p99"))


@query("shift_by_group", f"""WITH {_FUSED}, m AS (SELECT user_id, avg(fused_valence) FILTER (topic='purchase')-avg(fused_valence) FILTER (topic='view') AS shift FROM fused GROUP BY user_id),
 g AS (SELECT m.shift, c.c_mktsegment FROM m JOIN customer c ON c.c_custkey=m.user_id WHERE shift IS NOT NULL AND c_mktsegment IS NOT NULL) SELECT c_mktsegment, count(*) AS n_people, round(avg(shift),4) AS mean_shift FROM g GROUP BY c_mktsegment""")
def _(spark, d):
    shift = RO.topic_shifts(fused(spark, d), "user_id", "topic", "fused_valence", "view", ["purchase"])
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    rows = shift.join(people, "user_id").na.drop(subset=["shift", "c_mktsegment"])
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n_people"), F.round(F.avg("shift"), 4).alias("mean_shift"))


@query("incremental_intake", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, d):
    return ST.unprocessed(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("sessions_without_codes", f"WITH {_CODED} SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM coded")
def _(spark, d):
    marks = coded(spark, d).select("doc_id", F.col("code_id").alias("code_ids"))
    return SC.sessions_without_codes(marks, table(spark, d, "documents"), "doc_id")


@query("device_labels", "SELECT lower(l_shipmode) || '_' || l_linenumber || '_' || '2ch' AS recording_device, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode, l_linenumber FROM lineitem) GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.lower("l_returnflag").alias("codec"), F.col("l_linenumber").alias("rate"), F.lit(2).alias("channels"))
    return rows.groupBy(device_label("codec", "rate", "channels").alias("recording_device")).agg(F.count("*").alias("n"))


@query("weighted_rates", "SELECT o_orderpriority, round(sum(o_totalprice*(o_orderkey%7))/sum(CASE WHEN o_totalprice IS NOT NULL THEN o_orderkey%7 END),4) AS weighted FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    rows = table(spark, d, "orders").withColumn("w", F.col("o_orderkey") % 7)
    return rows.groupBy("o_orderpriority").agg(F.round(S.weighted_mean("o_totalprice", "w"), 4).alias("weighted"))


@query("demographic_fields", """SELECT c_custkey, 'PN' || lpad(substr(regexp_replace(c_name,'[^0-9]','','g'),-3),3,'0') AS participant_id, CAST(nullif(regexp_extract(CAST(c_acctbal AS VARCHAR),'(\\d+)',1),'') AS DOUBLE) AS years, CASE WHEN c_mktsegment='BUILDING' THEN 1 ELSE 0 END AS area_x,
 c_nationkey=3 AS direct_peer_contact FROM customer""")
def _(spark, d):
    rows = table(spark, d, "customer").withColumn("digits", F.expr("right(regexp_replace(c_name, '[^0-9]', ''), 3)")).withColumn("x", F.when(F.col("c_mktsegment") == "BUILDING", "y").otherwise("n")).withColumn("contact", F.when(F.col("c_nationkey") == 3, " Yes ").otherwise("no"))
    return R.normalise_demographics(rows, "digits", "c_mktsegment", {"c_acctbal": "years"}, ["x"], "contact").select("c_custkey", "participant_id", "years", "area_x", "direct_peer_contact")


@query("gazetteer_admission", """WITH n AS (SELECT DISTINCT lower(p) AS name FROM (SELECT unnest(string_split(p_name,' ')) AS p FROM part) WHERE regexp_full_match(p,'[A-Za-z]+') AND length(p)>=3), c AS (SELECT DISTINCT lower(unnest(regexp_extract_all(upper(p_type[1]) || p_type[2:], '\\b[A-Z][A-Za-z]+\\b'))) AS name FROM part)
 SELECT name FROM n WHERE name IN (SELECT name FROM c) AND name NOT IN ('okay','yeah','thanks','nurse','doctor','triage','the','and')""")
def _(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.explode(F.split("p_name", " ")).alias("name"))
    corpus = part.select(F.concat(F.upper(F.substring("p_type", 1, 1)), F.expr("substring(p_type, 2)")).alias("t"))
    return T.admit_names(names, corpus, "t")
