"""Acoustic measures of utterances cut from their session's recording: voice measures and three emotion dimensions.

The voice measures are computed here from frames of 40 ms every 10 ms. The dimensions come from any regressor (samples, rate) to
(arousal, dominance, valence), with a stand-in made of loudness, pitch and its movement.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.documents import decode_wav

#: The measures' names.
VOICE = ("f0_mean", "f0_p20", "f0_p80", "f0_cv", "loudness_mean", "loudness_p80", "jitter", "shimmer", "hnr", "voiced_per_s", "voiced_seg_len", "unvoiced_seg_len")
DIMENSIONS = ("ac_arousal", "ac_dominance", "ac_valence")

Regressor = Callable[[np.ndarray, int], tuple[float, float, float]]


def frames(x: np.ndarray, rate: int, length: float = 0.04, hop: float = 0.01) -> np.ndarray:
    n, step = int(rate * length), max(1, int(rate * hop))
    return np.lib.stride_tricks.sliding_window_view(x, n)[::step] if len(x) >= n else np.zeros((0, n))


def pitch(rows: np.ndarray, rate: int, low: float = 60.0, high: float = 400.0, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, periodicity 0..1) of each frame, by the first strong peak of its normalised autocorrelation."""
    n = rows.shape[1] if len(rows) else 1
    a, b = max(1, int(rate / high)), min(n - 2, int(rate / low))
    hz, strength = np.zeros(len(rows)), np.zeros(len(rows))
    if b <= a:
        return hz, strength
    size = 1 << (2 * n - 1).bit_length()
    for k in range(0, len(rows), block):
        part = rows[k : k + block] - rows[k : k + block].mean(1, keepdims=True)
        auto = np.fft.irfft(np.abs(np.fft.rfft(part, size)) ** 2, size)[:, :n]
        ahead = np.cumsum(part**2, axis=1)
        lag = np.arange(n)
        energy = np.sqrt(np.maximum(ahead[:, n - 1 - lag] * (ahead[:, -1:] - np.where(lag, ahead[:, lag - 1], 0.0)), 1e-18))
        r = np.clip(auto / energy, -1.0, 1.0)[:, a - 1 : b + 2]
        inner = r[:, 1:-1]
        peak = (inner >= r[:, :-2]) & (inner > r[:, 2:])
        top = np.where(peak, inner, -1.0).max(1)
        first = (peak & (inner >= 0.95 * top[:, None])).argmax(1)  # multiples of the period are as strong, the first is the period
        i = np.arange(len(part))
        y0, y1, y2 = r[i, first], r[i, first + 1], r[i, first + 2]
        bend = y0 - 2 * y1 + y2
        shift = np.where(np.abs(bend) > 1e-12, 0.5 * (y0 - y2) / np.where(np.abs(bend) > 1e-12, bend, 1.0), 0.0)
        found = top > 0
        hz[k : k + block] = np.where(found, rate / (first + a + np.clip(shift, -0.5, 0.5)), 0.0)
        strength[k : k + block] = np.where(found, top, 0.0)
    return hz, strength


def run_lengths(flag: np.ndarray) -> np.ndarray:
    """Lengths of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return edge[1::2] - edge[::2]


def voice_measures(x: np.ndarray, rate: int, hop: float = 0.01, voiced_from: float = 0.5, silence: float = 1e-4) -> dict[str, float | None]:
    """The twelve measures. Pitch is in semitones above 27.5 Hz, its spread relative; loudness is the power law of the level;
    jitter is relative, shimmer and hnr are in dB; segments are in seconds. What needs voice is null where there is none."""
    rows = frames(x, rate, hop=hop)
    out: dict[str, float | None] = dict.fromkeys(VOICE)
    if not len(rows):
        return out
    level = np.sqrt((rows**2).mean(1))
    hz, strength = pitch(rows, rate)
    voiced = (strength >= voiced_from) & (level >= silence)
    loud = level**0.6
    out |= {"loudness_mean": float(loud.mean()), "loudness_p80": float(np.quantile(loud, 0.8))}
    said, still = run_lengths(voiced), run_lengths(~voiced)
    out |= {"voiced_per_s": len(said) / (len(x) / rate), "voiced_seg_len": float(said.mean() * hop) if len(said) else 0.0, "unvoiced_seg_len": float(still.mean() * hop) if len(still) else 0.0}
    if voiced.any():
        tone = 12 * np.log2(hz[voiced] / 27.5)
        sure = np.clip(strength[voiced], 0.0, 1 - 1e-6)
        out |= {"f0_mean": float(tone.mean()), "f0_p20": float(np.quantile(tone, 0.2)), "f0_p80": float(np.quantile(tone, 0.8)), "f0_cv": float(tone.std() / tone.mean()) if tone.mean() else None}
        out["hnr"] = float((10 * np.log10(sure / (1 - sure))).mean())
        pair = voiced[1:] & voiced[:-1]
        if pair.any():
            period, top = 1 / np.maximum(hz, 1e-9), np.maximum(np.abs(rows).max(1), 1e-9)
            out["jitter"] = float(np.abs(np.diff(period))[pair].mean() / period[voiced].mean())
            out["shimmer"] = float(np.abs(20 * np.diff(np.log10(top)))[pair].mean())
    return out


def plain_regressor(x: np.ndarray, rate: int) -> tuple[float, float, float]:
    """Stand-in for a model: louder and higher is more aroused, louder and lower more dominant, livelier pitch brighter. All in 0..1."""
    m = voice_measures(x, rate)
    squash = lambda v: 1 / (1 + math.exp(-v))
    loud, tone, move = (m["loudness_mean"] or 0.0) * 8 - 2, ((m["f0_mean"] or 32.0) - 32) / 8, ((m["f0_cv"] or 0.05) - 0.05) * 10
    return squash(loud + tone), squash(loud - tone), squash(move + tone / 2)


def acoustic_scores(utterances: DataFrame, files: DataFrame, session: str = "session_id", unit: str = "utt_id", start: str = "start_s", end: str = "end_s", content: str = "content", least: float = 0.30, regress: Regressor = plain_regressor) -> DataFrame:
    """(session, unit) with the voice measures, ``egemaps_ok`` and the dimensions, a row for each utterance.

    ``files``: one row a session with its WAV bytes; a recording goes to one task, once, and is decoded there once. An utterance of under
    ``least`` seconds of audio, one beyond the recording's end, one without times and one without a recording have nulls. A
    recording that can't be read gives ``egemaps_ok`` 0. Columns of other tables are joined by the unit.
    """
    names = [*VOICE, "egemaps_ok", *DIMENSIONS]

    def score(x: np.ndarray, rate: int) -> dict:
        if len(x) < least * rate:
            return {}
        return {**voice_measures(x, rate), "egemaps_ok": 1, **dict(zip(DIMENSIONS, map(float, regress(x, rate))))}

    def run(key: tuple, u: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = [{} for _ in range(len(u))]
        data = next((d for d in f["c"] if d is not None), None)
        if data is not None and len(u):
            try:
                x, rate = decode_wav(bytes(data))
            except Exception:  # a damaged recording is a result, not a failed job
                rows = [{"egemaps_ok": 0} for _ in rows]
            else:
                x = x.mean(1)
                at = u[["a", "b"]].to_numpy(float)
                rows = [score(x[max(int(a * rate), 0) : max(int(b * rate), 0)], rate) if np.isfinite(a + b) else {} for a, b in at]
        out = pd.DataFrame(rows, columns=names, index=range(len(u))).astype({n: "float64" for n in names})
        out["egemaps_ok"] = out["egemaps_ok"].astype("Int32")
        out.insert(0, unit, u["u"].to_numpy())
        out.insert(0, session, key[0])
        return out

    types = {k: utterances.schema[k].dataType.simpleString() for k in (session, unit)}
    schema = ", ".join([f"`{k}` {t}" for k, t in types.items()] + [f"{n} {'int' if n == 'egemaps_ok' else 'double'}" for n in names])
    u = utterances.selectExpr(f"`{session}` as s", f"`{unit}` as u", f"cast(`{start}` as double) as a", f"cast(`{end}` as double) as b")
    f = files.selectExpr(f"`{session}` as s", f"`{content}` as c")
    return u.groupBy("s").cogroup(f.groupBy("s")).applyInPandas(run, schema)
