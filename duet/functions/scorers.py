"""Pluggable scorers: what an external model would add to a table, with deterministic stand-ins made of built-ins.

A scorer takes a DataFrame and a text column and returns the DataFrame with its own columns added.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STANCES
from ..sources.tables import exists
from .text import tokens


class Scorer(Protocol):
    def apply(self, df: DataFrame, text: str) -> DataFrame: ...


class LexiconSentiment:
    """Counts of positive and negative words to a softmax over three classes, valence, label and stance; blank text gives null."""

    def __init__(self, positive: list[str], negative: list[str]) -> None:
        self.positive, self.negative = positive, negative

    def apply(self, df: DataFrame, text: str) -> DataFrame:
        words = F.transform(F.split(F.lower(F.col(text)), r"\s+"), lambda w: F.regexp_replace(w, r"[.,!?]+$", ""))
        hits = lambda all, lexicon: F.size(F.filter(all, lambda w: w.isin(*lexicon))).cast("double")
        both = F.transform(F.array(words), lambda all: F.array(hits(all, self.negative), hits(all, self.positive)))[0]  # words once for both counts
        out = df.withColumn("__hits", both).withColumn("__neg", F.col("__hits")[0]).withColumn("__pos", F.col("__hits")[1]).drop("__hits")
        top = F.greatest("__neg", "__pos", F.lit(1.0))  # taken off before exp, so that no number of hits overflows
        out = out.withColumns({"__neg": F.exp(F.col("__neg") - top), "__pos": F.exp(F.col("__pos") - top), "__neu": F.exp(1.0 - top)})
        total = F.col("__neg") + F.col("__pos") + F.col("__neu")
        blank = F.col(text).isNull() | (F.trim(text) == "")
        out = out.withColumns({"tx_p_negative": F.when(~blank, F.col("__neg") / total), "tx_p_neutral": F.when(~blank, F.col("__neu") / total), "tx_p_positive": F.when(~blank, F.col("__pos") / total)})
        return out.withColumns({"tx_valence": F.col("tx_p_positive") - F.col("tx_p_negative"), "tx_emotion_label": top_class(), "tx_stance": stance()}).drop("__neg", "__pos", "__neu")


def top_class() -> Column:
    """The likeliest class; of equals the one named first (negative, neutral, positive)."""
    n, u, p = F.col("tx_p_negative"), F.col("tx_p_neutral"), F.col("tx_p_positive")
    return F.when(n.isNull(), None).when((n >= u) & (n >= p), "negative").when(u >= p, "neutral").otherwise("positive")


def stance(least: float = 0.5) -> Column:
    """The likeliest class, or ``mixed`` where it has less than ``least``."""
    top = F.greatest("tx_p_negative", "tx_p_neutral", "tx_p_positive")
    return F.when(top.isNull(), None).when(top < least, "mixed").otherwise(top_class())


class KeywordCoder:
    """Codes whose keywords a text has, joined by ``|`` in the codebook's order, their names and number."""

    def __init__(self, codebook: dict[str, list[str]], names: dict[str, str] | None = None) -> None:
        self.codebook, self.names = codebook, names or {}

    def apply(self, df: DataFrame, text: str) -> DataFrame:
        # The words are bound once in a lambda: as a column they would be copied into each code and each filter that is pushed down.
        found = lambda w: F.array_compact(F.array(*[F.when(F.arrays_overlap(w, F.array(*map(F.lit, keys))), F.lit(code)) for code, keys in self.codebook.items()]))
        df = df.withColumn("__marks", F.transform(F.array(tokens(F.col(text))), found)[0])
        marks = F.col("__marks")
        named = F.transform(marks, lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k in self.codebook for x in (k, self.names.get(k, k))]), c), c))
        return df.withColumns({"code_ids": F.array_join(marks, "|"), "code_names": F.array_join(named, "|"), "n_codes": F.size(marks)}).drop("__marks")


class ModelScorer:
    """Any Python model on batches of texts: ``load`` once per task, ``predict`` from texts to a frame of the named columns.

    ``workers`` bounds how many batches run at once, as for a metered service.
    """

    def __init__(self, load: Callable[[], object], predict: Callable[[object, pd.Series], pd.DataFrame], schema: str, workers: int | None = None) -> None:
        self.load, self.predict, self.schema, self.workers = load, predict, schema, workers

    def apply(self, df: DataFrame, text: str) -> DataFrame:
        load, predict = self.load, self.predict

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for f in frames:
                yield pd.concat([f.reset_index(drop=True), predict(model, f[text]).reset_index(drop=True)], axis=1)

        rows = df.repartition(self.workers) if self.workers else df
        old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return rows.mapInPandas(run, f"{old}, {self.schema}")


REPLY = "array<struct<utt_id:string,topics:array<string>,stance:string,key_phrase:string,confidence:string>>"


def parse_reply(reply: Column) -> Column:
    """The JSON array in a coder's reply: code fences off, from the first bracket to the last; null if it can't be read."""
    bare = F.regexp_replace(reply, r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), REPLY)


def render(template: str, missing: str = "n/a") -> Column:
    """A prompt: ``{column}`` is replaced by the column's text, ``{column:%+.1f}`` by its number in that format, null by ``missing``."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)(?::(%[^}]+))?\}", template):
        value = F.format_string(m[2], F.col(m[1])) if m[2] else F.col(m[1]).cast("string")
        out += [F.lit(template[at : m.start()]), F.when(F.col(m[1]).isNotNull(), value).otherwise(missing)]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def call_coder(chunks: DataFrame, prompt: str, call: Callable[[str], str], cache: str, attempts: int = 4, wait: float = 2.0, workers: int = 2, streak: int = 3, most: float = 0.1) -> DataFrame:
    """The chunks with ``reply``, from a service that is slow, metered and fails at times.

    Replies are kept in the table ``cache`` under the prompt's hash, so a run only asks for what no run before got. A call
    that raises is made again, after ``wait`` seconds and then twice as long each time. A worker whose last ``streak`` chunks all failed
    asks no more. The run is refused, its replies kept, if over ``most`` of the asked chunks have none. ``workers`` tasks ask at once.
    """
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    keyed = chunks.withColumn("chunk_key", F.sha2(F.col(prompt).cast("binary"), 256))
    got = lambda: spark.read.parquet(cache).where("reply is not null").select("chunk_key", "reply").dropDuplicates(["chunk_key"])
    todo = keyed.where(F.col(prompt).isNotNull()).select("chunk_key", F.col(prompt).alias("prompt")).dropDuplicates(["chunk_key"])
    todo = todo.join(got(), "chunk_key", "left_anti") if exists(spark, cache) else todo

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        missed = 0
        for f in frames:
            replies, errors = [], []
            for text in f["prompt"]:
                reply, error = None, "not asked"
                for i in range(attempts if missed < streak else 0):
                    if i:
                        time.sleep(wait * 2 ** (i - 1))
                    try:
                        reply, error = call(text), None
                        break
                    except Exception as e:
                        error = str(e)
                missed = 0 if error is None else missed + 1
                replies.append(reply)
                errors.append(error)
            yield pd.DataFrame({"chunk_key": f["chunk_key"], "reply": replies, "error": errors})

    asked = todo.repartition(workers).mapInPandas(run, "chunk_key string, reply string, error string").withColumn("run", F.lit(name))
    asked.write.mode("append").parquet(cache)
    this = spark.read.parquet(cache).where(F.col("run") == name).agg(F.count("*").alias("asked"), F.count_if(F.col("reply").isNull()).alias("failed")).first()
    guard_failures(this.failed, this.asked, most)
    return keyed.join(got(), "chunk_key", "left")


def validate_codes(replies: DataFrame, reply: str, valid: DataFrame, codes: list[str], text: str) -> DataFrame:
    """A row for each valid item of the replies: known id, known codes only, a known stance or ``neutral``, and a key phrase of
    at most 200 characters that the utterance contains, else null with ``phrase_ok`` false. ``valid``: utt_id and ``text``."""
    items = replies.select(F.explode(parse_reply(F.col(reply))).alias("x")).select("x.*")
    out = items.join(valid, "utt_id").withColumn("topics", F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda t: t.isin(*codes)))
    phrase = F.substring(F.coalesce("key_phrase", F.lit("")), 1, 200)
    ok = F.contains(F.col(text), phrase)
    known = F.coalesce(F.col("stance").isin(*STANCES), F.lit(False))
    return out.select(
        "utt_id", F.array_join("topics", "|").alias("code_ids"), F.size("topics").alias("n_codes"), F.when(known, F.col("stance")).otherwise("neutral").alias("llm_stance"),
        F.when(ok, phrase).alias("key_phrase"), ok.alias("phrase_ok"), F.coalesce("confidence", F.lit("medium")).alias("code_confidence"),
    )


def clip_ratings(df: DataFrame) -> DataFrame:
    """Ratings of a second fusion scheme, kept in range; agreement is assumed where it isn't given."""
    clip = lambda c, a, b: F.greatest(F.lit(a), F.least(F.lit(b), F.rint(c).cast("int")))
    return df.withColumns({"llm_valence": clip("llm_valence", -2, 2), "llm_arousal": clip("llm_arousal", 0, 2), "llm_agree": F.coalesce("llm_agree", F.lit(True)), "llm_reasoning": F.substring("llm_reasoning", 1, 300)})


def guard_failures(failed: int, chunks: int, most: float = 0.1) -> None:
    """Stop where more than ``most`` of the chunks failed."""
    if chunks and failed > most * chunks:
        raise RuntimeError(f"{failed} of {chunks} chunks failed")


def sessions_without_codes(coded: DataFrame, sessions: DataFrame, session: str) -> DataFrame:
    return sessions.select(session).distinct().join(coded.where("code_ids <> '' and code_ids is not null").select(session), session, "left_anti")
