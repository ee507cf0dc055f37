"""Words to units and turns; speaker roles, spoken ids, speaking shares, topic segments, and chunks for a coder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .timeline import runs


def build_units(words: DataFrame, by: list[str], keys: list[str], order: list[str], word: str = "w", start: str = "s", end: str = "e") -> DataFrame:
    """Units: runs of equal keys, their words put together in order; units without text are dropped."""
    numbered = runs(words, F.struct(*keys), by, order, "unit")
    place = F.struct(*order, F.col(word).alias("__w"))
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["__w"]), ""))
    out = numbered.groupBy(*by, "unit", *keys).agg(F.min(start).alias("start_s"), F.max(end).alias("end_s"), text.alias("text"))
    return out.where(F.col("text") != "")


def concat_runs(turns: DataFrame, by: list[str], key: str, order: str, text: str = "text", sep: str = " ") -> DataFrame:
    """Neighbouring rows of one speaker as one: first position, rows, and texts in order."""
    numbered = runs(turns, F.col(key), by, [order], "run")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), sep)
    return numbered.groupBy(*by, "run", key).agg(F.min(order).alias("first_turn"), F.count("*").alias("n_rows"), joined.alias("text"))


def speaker_shares(df: DataFrame, session: str, speaker: str, amount: str) -> DataFrame:
    total = df.groupBy(session, speaker).agg(F.sum(amount).alias("amount"))
    return total.withColumn("share", F.try_divide(F.col("amount").cast("double"), F.sum("amount").over(Window.partitionBy(session)).cast("double")))


def minor_speakers(df: DataFrame, session: str, speaker: str, amount: str, interviewer: str, least: float = 0.02) -> DataFrame:
    """Speakers with under ``least`` of the speech that isn't the interviewer's."""
    return speaker_shares(df.where(F.col(speaker) != interviewer), session, speaker, amount).where(F.col("share") < least)


def unassign_minor(df: DataFrame, session: str, speaker: str, amount: str, interviewer: str, known: DataFrame, role: str = "speaker_role", least: float = 0.02) -> DataFrame:
    """The rows with ``role`` set to ``unassigned`` for minor speakers that aren't among the ``known`` (session, speaker), those with an id."""
    minor = minor_speakers(df, session, speaker, amount, interviewer, least).select(session, speaker).join(known.select(session, speaker).distinct(), [session, speaker], "left_anti")
    out = df.join(minor.withColumn("__minor", F.lit(True)), [session, speaker], "left")
    return out.withColumn(role, F.when(F.col("__minor"), "unassigned").otherwise(F.col(role))).drop("__minor")


def assign_roles(turns: DataFrame, session: str, speaker: str, order: str, text: str, slate: str = T.SLATE, consent: str = T.CONSENT) -> DataFrame:
    """A row for each session: first speaker of the slate, of consent, the interviewer and its question rate.

    The interviewer is who reads the slate first, else who asks most: the highest share of turns with a question mark,
    of equals the smallest speaker. ``consent_agrees`` tells that consent isn't given by the interviewer.
    """
    first = lambda p: F.min(F.when(F.col(text).rlike(p), F.struct(F.col(order).alias("o"), F.col(speaker).alias("s"))))
    cues = turns.groupBy(session).agg(first(slate)["s"].alias("slate_spk"), first(consent)["s"].alias("consent_spk"))
    rate = turns.groupBy(session, speaker).agg(F.avg(F.contains(F.col(text), F.lit("?")).cast("double")).alias("rate"))
    most = rate.groupBy(session).agg(F.min(F.struct((-F.col("rate")).alias("k"), F.col(speaker).alias("s")))["s"].alias("asker"))
    out = cues.join(most, session).withColumn("interviewer", F.coalesce("slate_spk", "asker"))
    own = rate.select(F.col(session), F.col(speaker).alias("interviewer"), F.col("rate").alias("question_rate"))
    out = out.join(own, [session, "interviewer"], "left")
    return out.withColumn("consent_agrees", F.col("consent_spk").isNull() | (F.col("consent_spk") != F.col("interviewer"))).drop("asker")


def recover_ids(turns: DataFrame, session: str, speaker: str, order: str, text: str) -> DataFrame:
    """(session, speaker, participant_id, id_needs_review): strict ids in turns with consent first, else loose ones."""
    strict = F.when(F.col(text).rlike(T.CONSENT), F.nullif(F.regexp_extract(text, T.STUDY_ID, 1), F.lit("")))
    loose = F.nullif(F.regexp_extract(text, T.LOOSE_ID, 1), F.lit(""))
    pick = lambda body: F.min(F.when(T.norm_id(body).isNotNull(), F.struct(F.col(order).alias("o"), T.norm_id(body).alias("pid"), T.id_is_suspect(body).alias("odd"))))
    out = turns.groupBy(session, speaker).agg(pick(strict).alias("a"), pick(loose).alias("b")).where("a is not null or b is not null")
    return out.select(session, speaker, F.coalesce("a.pid", "b.pid").alias("participant_id"), F.when(F.col("a").isNotNull(), F.col("a.odd")).otherwise(True).alias("id_needs_review"))


def topic_boundaries(turns: DataFrame, session: str, order: str, text: str, sections: list[tuple[str, list[str]]]) -> DataFrame:
    """(session, topic, offset): each section's earliest cue in the session's stream, after the end of the section's before.

    The stream is the session's texts joined by spaces. Of several patterns the earliest match counts, of equal starts the
    pattern named first; a section without a match is skipped and the search goes on from where it was.
    """
    stream = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), T.normalise(F.col(text)).alias("t")))), lambda x: x["t"]), " ")
    out = turns.where(F.length(T.normalise(F.col(text))) > 0).groupBy(session).agg(stream.alias("stream")).withColumn("from", F.lit(0))
    for k, (_, patterns) in enumerate(sections):
        rest = F.substring(F.col("stream"), F.col("from") + 1, F.length("stream"))
        hits = [F.struct(F.regexp_instr(F.col("__rest"), F.lit("(?i)" + p)).alias("at"), F.lit(i).alias("i"), F.length(F.regexp_substr(F.col("__rest"), F.lit("(?i)" + p))).alias("n")) for i, p in enumerate(patterns)]
        out = out.withColumn("__rest", rest).withColumn("__best", F.array_min(F.filter(F.array(*hits), lambda x: x["at"] > 0)))
        out = out.withColumn(f"__at{k}", F.when(F.col("__best").isNotNull(), F.col("from") + F.col("__best.at") - 1))
        out = out.withColumn("from", F.when(F.col("__best").isNotNull(), F.col(f"__at{k}") + F.col("__best.n")).otherwise(F.col("from")))
    found = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(name).alias("topic"), F.col(f"__at{k}").alias("offset")) for k, (name, _) in enumerate(sections)])
    return out.select(session, F.explode(found).alias("x")).where("x.offset is not null").select(session, "x.rank", "x.topic", "x.offset")


def turn_chunks(turns: DataFrame, by: list[str], order: list[str], size: int = 45, before: int = 2, after: int = 1) -> DataFrame:
    """Chunks of ``size`` turns, with the neighbours of each chunk as context rows."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    rows = turns.withColumn("__p", place).withColumn("chunk", F.floor(F.col("__p") / size).cast("long"))
    n = F.max("__p").over(Window.partitionBy(*by))
    rows = rows.withColumn("__last", F.floor(n / size).cast("long"))
    near = F.array(F.lit(0), *([F.when(F.col("__p") % size >= size - before, 1)] if before else []), *([F.when(F.col("__p") % size < after, -1)] if after else []))
    spread = rows.withColumn("__d", F.explode(F.array_compact(near)))
    out = spread.withColumn("chunk", F.col("chunk") + F.col("__d")).where("chunk between 0 and __last")
    return out.withColumn("is_target", F.col("__d") == 0).drop("__d", "__p", "__last")


def sentences_to_turns(df: DataFrame, by: list[str], start: str, utt: str, text: str, flag: str) -> DataFrame:
    """One row a turn: first id, joined text, and the backchannel flag where all of its sentences have it."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(utt).alias("u"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    return df.groupBy(*by).agg(F.min(F.struct(F.col(start).alias("s"), F.col(utt).alias("u")))["u"].alias(utt), joined.alias(text), F.min(flag).alias(flag), F.count("*").alias("n_sentences"))


def codes_to_sentences(sentences: DataFrame, coded: DataFrame, by: list[str]) -> DataFrame:
    """Every sentence with the codes of its turn; sentences of turns without codes keep nulls."""
    return sentences.join(coded, by, "left")
