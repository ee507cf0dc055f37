"""Semi-structured inputs: a Markdown codebook, transcripts as lines with speaker headings, WAV audio."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: a code's heading line.
CODE = r"(?m)^###\s+(\w\d{1,2})\s+`([a-z_]+)`\s*[—-]\s*(.+)$"


def codebook(spark: SparkSession, path: str) -> DataFrame:
    return parse_codebook(spark.read.text(path, wholetext=True), "value")


def parse_codebook(df: DataFrame, text: str, longest: int = 230) -> DataFrame:
    """code_id, slug, label, domain, definition: the definition is the text below the heading up to a blank line, heading or example."""
    section = df.select(F.explode(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n## ")).alias("sec"))
    section = section.withColumn("domain", F.trim(F.regexp_extract("sec", r"^([^\n]*)", 1)))
    block = section.select("domain", F.explode(F.split(F.concat(F.lit("\n"), F.col("sec")), r"\n(?=### )")).alias("block"))
    block = block.where(F.col("block").rlike(CODE))
    body = F.regexp_replace(F.regexp_replace("block", r"^[^\n]*\n+", ""), r"(?s)(?:\n[ \t]*\n|\n?[ \t]*(?:##|- \*)).*$", "")
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    return block.select(*[F.trim(F.regexp_extract("block", CODE, k)).alias(n) for k, n in ((1, "code_id"), (2, "slug"), (3, "label"))], "domain", F.substring(flat, 1, longest).alias("definition"))


def transcript_turns(lines: DataFrame, document: str, line_no: str, text: str, heading: str = r"^\s*(Interviewer|Participant[^:]*|PN[-\s]?\d+)\s*:?\s*$") -> DataFrame:
    """Turns of a transcript given as lines: a heading names the speaker of the lines after it. Lines before a heading are left out.

    The role comes from the heading's words, so an unnumbered participant is a participant without an id.
    """
    w = Window.partitionBy(document).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col(text).rlike("(?i)" + heading)
    label = F.trim(F.regexp_replace(F.col(text), r":\s*$", ""))
    rows = lines.withColumn("turn_index", F.sum(is_head.cast("int")).over(w) - 1).withColumn("speaker_label", F.last(F.when(is_head, label), ignorenulls=True).over(w))
    rows = rows.where(~is_head & (F.col("turn_index") >= 0) & (F.trim(text) != ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("o"), F.trim(text).alias("t")))), lambda x: x["t"]), " ")
    out = rows.groupBy(document, "turn_index", "speaker_label").agg(joined.alias("text"))
    digits = F.regexp_extract("speaker_label", r"(?i)pn[-\s]?(\d+)", 1)
    role = F.when(F.col("speaker_label").rlike("(?i)^interviewer"), "interviewer").otherwise("participant")
    return out.withColumn("speaker_role", role).withColumn("participant_id", F.when(digits != "", F.concat(F.lit("PN"), F.lpad(digits, 3, "0"))))


def audio_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """Audio files with session numbers by position of the sorted name, and date and time from the name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    n = F.row_number().over(Window.orderBy("path"))  # a row for each file of a study
    return files.withColumn("source_file", name).withColumn("session_id", F.format_string("S%02d", n)).withColumn("interview_date", F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).withColumn("interview_time", F.regexp_replace(F.nullif(F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}_(\d{4})", 1), F.lit("")), r"(\d\d)(\d\d)", "$1:$2"))


def frame_measures(samples: np.ndarray, rate: int, frame_s: float = 0.02) -> dict:
    """Peak and RMS level, clipped share, signal-to-noise estimate and speech share of one channel in -1..1."""
    if not len(samples):
        return {"peak_dbfs": None, "rms_dbfs": None, "clip_ratio": None, "snr_est_db": None, "speech_frac": None}
    n = max(1, int(rate * frame_s))
    whole = samples[: len(samples) // n * n].reshape(-1, n)
    power = (whole**2).mean(1) if len(whole) else np.array([(samples**2).mean()])
    low, high = (max(float(x), 1e-12) for x in np.quantile(power, [0.1, 0.95]))
    level = lambda x: float(20 * np.log10(max(x, 1e-12)))
    return {"peak_dbfs": level(float(np.abs(samples).max())), "rms_dbfs": level(float(np.sqrt((samples**2).mean()))), "clip_ratio": float((np.abs(samples) >= 0.999).mean()), "snr_est_db": float(10 * np.log10(high / low)), "speech_frac": float((power >= low * 10**1.2).mean())}


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(samples [frames, channels] in -1..1, rate) of 16-bit PCM."""
    with wave.open(io.BytesIO(data)) as w:
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return x / 32768.0, w.getframerate()


def audio_qc(files: DataFrame) -> DataFrame:
    """Quality measures of each file (columns session_id, content), and the correlation of the channels where there are two."""

    def run(frames):
        for f in frames:
            rows = []
            for sid, data in zip(f["session_id"], f["content"]):
                x, rate = decode_wav(data)
                both = x.shape[1] == 2 and len(x) > 1 and x[:, 0].std() > 0 and x[:, 1].std() > 0
                rows.append({"session_id": sid, "duration_min": len(x) / rate / 60, "lr_corr": float(np.corrcoef(x[:, 0], x[:, 1])[0, 1]) if both else None, **frame_measures(x.mean(1), rate)})
            yield pd.DataFrame(rows, columns=["session_id", "duration_min", "peak_dbfs", "rms_dbfs", "clip_ratio", "snr_est_db", "speech_frac", "lr_corr"])

    return files.select("session_id", "content").mapInPandas(run, "session_id string, duration_min double, peak_dbfs double, rms_dbfs double, clip_ratio double, snr_est_db double, speech_frac double, lr_corr double")


def device_label(codec: str, rate: str, channels: str):
    """``codec_rate_Nch``"""
    return F.concat_ws("_", F.col(codec), F.col(rate).cast("string"), F.concat(F.col(channels).cast("string"), F.lit("ch")))
