"""Registered queries of joins to dimensions, lookups, relabelling, prompts, and de-identification by a gazetteer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scorers as SC
from ..functions import text as T
from ..operators import fusion as FU
from ..operators import reports as R
from ..operators import rollup as RO
from ..operators import turns as TU
from ..sources import tables as ST
from ..sources.tables import table
from .catalog import _CODED, _EV, _FUSED, _Z, BASE, CODES, EXCLUDED, OTHERS, coded, events, fused, query, scored, turns
from .worksheets import _WORDS, words


@query("participant_dimensions", f"""WITH {_FUSED}, p AS (SELECT user_id, count(*) AS n_utt, round(avg(fused_valence),4) AS overall_mean_valence FROM fused GROUP BY user_id)
 SELECT p.*, c_mktsegment AS occupation, c_nationkey, n_name AS nation FROM p LEFT JOIN customer ON c_custkey=user_id LEFT JOIN nation ON n_nationkey=c_nationkey""")
def _(spark, d):
    people = RO.participant_level(fused(spark, d), "user_id", "topic", "tx", BASE, EXCLUDED, OTHERS).select("user_id", "n_utt", F.round("overall_mean_valence", 4).alias("overall_mean_valence"))
    demo = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("occupation"), "c_nationkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return RO.attach(RO.attach(people, demo, "user_id", ["occupation", "c_nationkey"]), nation, "c_nationkey", ["nation"])


@query("codes_to_sentences", rf"""WITH {_WORDS}, c AS (SELECT conv_id, turn, CASE WHEN turn%2=0 THEN 'A1|' || role ELSE role END AS code_ids FROM conversations WHERE turn%3<>2)
 SELECT w.conv_id, w.turn, w.i, c.code_ids FROM words w LEFT JOIN c ON c.conv_id=w.conv_id AND c.turn=w.turn""")
def _(spark, d):
    t = turns(spark, d).where("turn % 3 <> 2").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("A1|"), "role")).otherwise(F.col("role")).alias("code_ids"))
    return TU.codes_to_sentences(words(spark, d).select("conv_id", "turn", F.col("i").cast("long").alias("i")), t, ["conv_id", "turn"])


@query("file_lookup", "SELECT 'matched' AS status, count(*) AS n FROM orders JOIN customer ON c_custkey=o_custkey UNION ALL SELECT 'unmatched', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    matched, rest = ST.lookup(table(spark, d, "customer"), orders, "c_custkey")
    part = lambda x, name: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("status"), "n")
    return part(matched, "matched").unionByName(part(rest, "unmatched"))


@query("unassigned_speakers", f"""WITH {_EV}, s AS (SELECT user_id, topic, sum(tx) AS a FROM ev WHERE topic<>'{EXCLUDED}' GROUP BY ALL), m AS (SELECT user_id, topic FROM (SELECT *, a/nullif(sum(a) OVER (PARTITION BY user_id),0) AS share FROM s) WHERE share<0.2 AND NOT (topic='error' AND user_id%2=0))
 SELECT ev.event_id, CASE WHEN m.topic IS NOT NULL THEN 'unassigned' ELSE 'participant' END AS speaker_role FROM ev LEFT JOIN m ON m.user_id=ev.user_id AND m.topic=ev.topic""")
def _(spark, d):
    e = events(spark, d).withColumn("speaker_role", F.lit("participant"))
    known = e.where("topic = 'error' and user_id % 2 = 0")  # those play the speakers with an id
    return TU.unassign_minor(e, "user_id", "topic", "tx", EXCLUDED, known, least=0.2).select("event_id", "speaker_role")


@query("capped_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '-3'), doc_id LIMIT 150")
def _(spark, d):
    return FU.capped_sample(table(spark, d, "documents").select("doc_id"), 150, "doc_id")


@query("reference_rows", "SELECT l_returnflag, max(l_quantity) AS max_pct, min(l_shipmode) AS top_row FROM (SELECT l_returnflag, l_quantity, l_linestatus || l_linenumber AS l_shipmode, max(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) WHERE l_quantity=m GROUP BY l_returnflag")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("label"))
    return RO.reference_rows(rows, "l_returnflag", "l_quantity", "label")


@query("mostly_positive", f"WITH {_FUSED}, o AS (SELECT user_id, avg(CAST(stance='positive' AS INT)) AS own FROM fused WHERE stance IS NOT NULL GROUP BY user_id) SELECT count(*) FILTER (own>0.3) AS n_mostly, count(*) AS n_people FROM o")
def _(spark, d):
    return RO.mostly_positive(fused(spark, d), "user_id", "stance", least=0.3)


@query("low_coverage", f"WITH {_WORDS} SELECT conv_id, turn, round(avg(CAST(length(w)>=3 AS INT)),6) AS coverage FROM words GROUP BY ALL HAVING avg(CAST(length(w)>=3 AS INT))<0.6")
def _(spark, d):
    rows = words(spark, d).groupBy("conv_id", "turn").agg(F.avg((F.length("w") >= 3).cast("double")).alias("coverage"))
    return R.low_coverage(rows).withColumn("coverage", F.round("coverage", 6))


@query("clock_times", "SELECT event_id, printf('%02d:%02d:%05.2f', CAST(floor(s/3600) AS BIGINT), CAST(floor(s/60) AS BIGINT)%60, s-60*floor(s/60)) AS at FROM (SELECT event_id, (event_id%40000)*0.25::DOUBLE AS s FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.hms((F.col("event_id") % 40000) * F.lit(0.25)).alias("at"))


@query("prompt_text", f"WITH {_Z} SELECT event_id, 'Topic: ' || coalesce(topic,'n/a') || '; voice ' || printf('%+.1f', ac_z) || ', words ' || coalesce(CASE WHEN topic<>'error' THEN printf('%+.1f', tx_z) END,'n/a') || '.' AS prompt FROM z")
def _(spark, d):
    rows = scored(spark, d).withColumn("tx_z", F.when(F.col("topic") != "error", F.col("tx_z")))
    return rows.select("event_id", SC.render("Topic: {topic}; voice {ac_z:%+.1f}, words {tx_z:%+.1f}.").alias("prompt"))


# A word of address, between a full stop and a comma, plays the spoken name.
_ADDRESS = r"[.] ([A-Z][a-z]{2,}), "
_PLAIN = ", ".join(f"'{w}'" for w in T.NOT_NAMES)


@query("deidentify_names", rf"""WITH n AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{_ADDRESS}', 1))) AS name FROM documents), g AS (SELECT name FROM n WHERE name NOT IN ({_PLAIN})),
 p AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS x FROM documents), w AS (SELECT DISTINCT doc_id, lower(unnest(x)) AS name FROM p),
 o AS (SELECT doc_id, list(name) AS names FROM w WHERE name IN (SELECT name FROM g) GROUP BY doc_id)
 SELECT p.doc_id, md5(CASE WHEN names IS NULL THEN text ELSE array_to_string(list_transform(x, lambda y: CASE WHEN list_contains(names, lower(y)) THEN '[NAME]' ELSE y END), '') END) AS redacted_md5, names IS NOT NULL AS has_names FROM p LEFT JOIN o ON o.doc_id=p.doc_id""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    names = T.admit_names(T.collect_names(docs, "text", _ADDRESS), docs, "text")
    out = T.redact_names(docs.withColumn("was", F.col("text")), "doc_id", "text", names)
    return out.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("redacted_md5"), (F.col("text") != F.col("was")).alias("has_names"))


@query("code_labels", f"WITH {_CODED} SELECT code_id, lang, count(*) AS n FROM coded GROUP BY ALL")
def _(spark, d):
    rows = ST.landing(coded(spark, d), {"code": "code_id", "absent": "never"})
    return rows.groupBy(*ST.present(rows, ["lang", "code_id", "missing"])).agg(F.count("*").alias("n")).where(F.col("code_id").isin(*CODES))
