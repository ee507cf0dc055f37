"""Toxicity: a linear-chain conditional random field over the tokens of a text.

Training. The labelled sample is dealt by a hash of the id: of every ``PARTS`` parts one is kept for calibration, the others fit the field.
Documents have labels, tokens have none, so tokens are labelled from the documents': per-class document frequencies of token
features (the word, its first three to eight characters) give the features that mark toxic documents; a token of a
toxic document with such a feature is labelled toxic, every other token clean. The field has a weight for each feature, a bias
and the transitions, fitted to these tags by gradient ascent on their conditional likelihood, over whole texts.

Scoring. Forward-backward over the whole chain of a text gives the strongest toxic marginal and the expected number of toxic tokens
among those with known features; a logistic calibration, fitted on the part that the field hasn't seen, turns both into the score. Only words are
looked at: labels, lang, source and ids are never inputs. Tokens with a marginal of at least one half are the offending spans.

Tokens without a known feature differ in nothing, so a stretch of them is one power of the transition matrix (two
by two, by its eigenvalues): the messages are exact for the whole chain, and the work grows with the tokens that have features.

The sample takes at most ``PER_CLASS`` labelled ids of each class, in the order of a hash of the id, with one text for each id (the least of repeated ones), and whole; ids with
crc32 mod 3 equal to 1 are held out. The model has at most ``MAX_FEATURES`` features. Null and empty texts get the score of a
text without known features, texts of any length are one chain. Repeated rows score alike; without labels of both classes every score is the
calibrated prior 0. An empty table gives no rows. Other columns, whatever their names and types, are ignored, and kept by ``keep``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, col, fields, in_chunks

#: Labelled ids of each class that training may use, and features that the model may have; one part of ``PARTS`` calibrates.
PER_CLASS, MAX_FEATURES, PARTS = 4000, 4096, 4
THRESHOLD = 0.7
_EDGE = re.compile(rb"^[^a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff]+$")


def token_features(raw: bytes) -> list[str]:
    w = _EDGE.sub(b"", raw.lower()).decode("utf-8", "replace")
    if not w:
        return []
    return ["w:" + w] + [f"p{k}:{w[:k]}" for k in range(3, 9) if len(w) > k]


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """text, toxic, calibrate of a bounded number of labelled ids; the ids are few and broadcast, so no other text is shuffled."""
    clear = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("b")).where("toxic = b").select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = clear.where("toxic > 0").orderBy(*order).limit(per_class).unionByName(clear.where("toxic <= 0").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return rows.select("text", (F.col("toxic") > 0).alias("toxic"), (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(PARTS)) == 0).alias("calibrate"))


def frequencies(rows: DataFrame) -> DataFrame:
    """feature, documents of each class that have it; each task adds up its own before the shuffle."""

    def run(batches):
        seen = {True: Counter(), False: Counter()}
        for batch, texts in in_chunks(batches, "text"):
            for t, toxic in zip(texts, batch.column(1).to_pylist()):
                seen[toxic].update({f for w in set(t.split()) for f in token_features(w)})
                seen[toxic]["#docs"] += 1
        names = list(seen[True].keys() | seen[False].keys())
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([seen[c][x] for x in part], pa.int64()) for c in (True, False))], ["feature", "a", "b"])

    return arrow_map(rows, run, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def select_features(counts: DataFrame, limit: int = MAX_FEATURES, least: int = 3, odds: float = 2.5) -> dict[str, int]:
    """The features with the highest smoothed log odds of toxic documents; at most ``limit`` rows reach the driver."""
    total = counts.where("feature = '#docs'").select("a", "b").collect()
    if not total or not total[0]["a"] or not total[0]["b"]:
        return {}
    a, b = total[0]["a"], total[0]["b"]
    score = F.log((F.col("a") + 0.5) / (a + 1.0)) - F.log((F.col("b") + 0.5) / (b + 1.0))
    rows = counts.where((F.col("feature") != "#docs") & (F.col("a") >= least)).withColumn("odds", score).where(F.col("odds") >= odds).orderBy(F.desc("odds"), "feature").limit(limit).collect()
    return {r["feature"]: i for i, r in enumerate(rows)}


class Tagger:
    """Tokens to feature sets, remembered by word."""

    def __init__(self, features: dict[str, int], keep: int = 500_000) -> None:
        self.features, self.keep = features, keep
        self.kind: dict[tuple[int, ...], int] = {(): 0}
        self.seen: dict[bytes, int] = {}

    def events(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of tokens; places of the tokens with known features; their kinds."""
        words = text.split()
        new = set(words).difference(self.seen)
        if len(self.seen) + len(new) > self.keep:
            self.seen, new = {}, set(words)
        for w in new:
            ids = tuple(i for f in token_features(w) if (i := self.features.get(f)) is not None)
            self.seen[w] = self.kind.setdefault(ids, len(self.kind)) if ids else 0
        kinds = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(kinds)
        return len(words), at, kinds[at]

    def weights(self, w: np.ndarray) -> np.ndarray:
        """Summed feature weight of each kind."""
        return np.array([w[list(k)].sum() if k else 0.0 for k in self.kind])


class Steps:
    """Powers of the matrix of one step over a token without features, by its eigenvalues; scaled by the larger one's power."""

    def __init__(self, trans: np.ndarray, bias: float) -> None:
        self.start = np.array([1.0, np.exp(bias)])
        self.one = np.exp(trans) * self.start[None, :]
        (a, b), (c, d) = self.one.tolist()
        root = float(np.sqrt((a - d) ** 2 + 4 * b * c))
        self.top, low = (a + d + root) / 2, (a + d - root) / 2
        self.ratio = low / self.top
        eye = np.eye(2)
        self.p1, self.p2 = (self.one - low * eye) / root, (self.top * eye - self.one) / root

    def ahead(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each row vector times the n-th power."""
        return rows @ self.p1 + (self.ratio**n)[:, None] * (rows @ self.p2)

    def back(self, columns: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th power times each column vector."""
        return columns @ self.p1.T + (self.ratio**n)[:, None] * (columns @ self.p2.T)

    def taken(self, rows: np.ndarray, columns: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected transitions [2, 2] of all stretches of n steps between the vectors, and the odds of each stretch's
        first tag [stretch, 2], unscaled."""
        whole = self.back(columns, n)
        z = (rows * whole).sum(1)
        rest = np.maximum(n - 1, 0)
        k11, k22 = n, np.where(n > 0, n * self.ratio**rest, 0.0)
        mixed = (1 - self.ratio**n) / (1 - self.ratio)
        l1, l2, r1, r2 = rows @ self.p1, rows @ self.p2, columns @ self.p1.T, columns @ self.p2.T
        pairs = np.zeros((2, 2))
        for left, right, k in ((l1, r1, k11), (l2, r2, k22), (l1, r2, mixed), (l2, r1, mixed)):
            pairs += np.einsum("si,sj,s->ij", left, right, k / z)
        return pairs * self.one / self.top, rows * whole / z[:, None]


def chain(n: np.ndarray, count: np.ndarray, at: np.ndarray, weight: np.ndarray, trans: np.ndarray, bias: float, pairs: bool = False) -> tuple:
    """Forward-backward over whole texts of n tokens, of which ``count`` have features: at the places ``at`` (ascending in
    each text, texts end to end), with the summed weights ``weight`` of the toxic tag besides the bias.

    Returns the toxic marginals at these places and, if asked for, the expected transitions [2, 2] and toxic tokens of all texts.
    """
    steps = Steps(trans, bias)
    first = np.cumsum(count) - count
    odds = np.exp(np.clip(weight, -300, 300))
    gap = np.diff(at, prepend=0)
    lead = first[count > 0]
    gap[lead] = at[lead]
    forward, backward = np.ones((len(at), 2)), np.ones((len(at), 2))
    # Place by place, the texts with the most places first, so that those with a k-th place are a stretch.
    order = np.argsort(-count, kind="stable")
    start, many = first[order], count[order]
    live = np.searchsorted(-many, -np.arange(int(count.max(initial=0))), side="left")
    now = np.broadcast_to(steps.start, (len(n), 2))
    for k, m in enumerate(live.tolist()):
        i = start[:m] + k
        now = steps.ahead(now[:m], gap[i])
        now[:, 1] *= odds[i]
        now /= now.sum(1, keepdims=True)
        forward[i] = now
    has = np.flatnonzero(many)
    tail = n[order][has] - 1 - at[start[has] + many[has] - 1]
    backward[start[has] + many[has] - 1] = steps.back(np.ones((len(has), 2)), tail)
    for k in range(len(live) - 1, 0, -1):
        i = start[: live[k]] + k
        now = backward[i] * np.stack([np.ones(len(i)), odds[i]], 1)
        now /= now.sum(1, keepdims=True)
        backward[i - 1] = steps.back(now, gap[i])
    both = forward * backward
    marginal = both[:, 1] / both.sum(1)
    if not pairs:
        return (marginal,)
    into = backward * np.stack([np.ones(len(at)), odds], 1)
    into /= into.sum(1, keepdims=True)
    left = np.append(np.zeros((1, 2)), forward[:-1], 0) if len(at) else forward
    left[lead] = steps.start
    taken, head = steps.taken(left, into, gap)
    toxic = float(head[lead, 1].sum())
    last = lead + count[count > 0] - 1
    rest = (n - 1)[count > 0] - at[last]
    more, _ = steps.taken(forward[last], np.ones((len(last), 2)), rest)
    none = n[(count == 0) & (n > 0)]
    plain, head = steps.taken(np.broadcast_to(steps.start, (len(none), 2)), np.ones((len(none), 2)), none - 1)
    taken = taken + more + plain
    return marginal, taken, toxic + float(head[:, 1].sum()) + float(taken[:, 1].sum())


class Sample:
    """Training texts: classes, tokens, places with features, and the features of each place, in flat arrays."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: (r["n"], r["toxic"], r["at"], r["kinds"]))  # an order of the content's own
        self.toxic = np.array([r["toxic"] for r in rows], bool)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.count = np.array([len(r["at"]) for r in rows], np.int64)
        self.at = np.array([p for r in rows for p in r["at"]], np.int64)
        names: dict[str, int] = {}
        self.kind = np.array([names.setdefault(k, len(names)) for r in rows for k in r["kinds"]], np.int64)
        lists = [np.array(k.split(), np.int64) for k in names]
        self.size = np.array([len(x) for x in lists], np.int64)
        self.feature = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(lists)), self.size)

    def weights(self, w: np.ndarray) -> np.ndarray:
        """Summed feature weight of each place."""
        return np.bincount(self.owner, weights=w[self.feature], minlength=len(self.size))[self.kind]

    def by_feature(self, x: np.ndarray, n: int) -> np.ndarray:
        """x, a figure of each place, summed by feature."""
        kind = np.bincount(self.kind, weights=x, minlength=len(self.size))
        return np.bincount(self.feature, weights=kind[self.owner], minlength=n)


def training_rows(rows: DataFrame, features: dict[str, int]) -> list:
    """Per sampled text: class, part, tokens, places with features and what they have; a row for each sampled id."""

    def run(batches):
        tagger = Tagger(features)
        for batch, texts in in_chunks(batches, "text"):
            got = [tagger.events(t) for t in texts]
            names = [" ".join(map(str, k)) for k in tagger.kind]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([n for n, _, _ in got], pa.int64()), pa.array([a.tolist() for _, a, _ in got], pa.list_(pa.int64())), pa.array([[names[x] for x in k.tolist()] for _, _, k in got], pa.list_(pa.string()))], ["toxic", "calibrate", "n", "at", "kinds"])

    return arrow_map(rows, run, "toxic boolean, calibrate boolean, n long, at array<long>, kinds array<string>").collect()


def fit(rows: list, n_features: int, rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> dict:
    """Weights, bias, transitions and calibration. rows: what training_rows gives, in any order."""
    s = Sample([r for r in rows if not r["calibrate"]])
    tags = np.repeat(s.toxic, s.count)  # a place of a toxic text is toxic, all other tokens are clean
    gold_feature, gold_bias = s.by_feature(tags.astype(float), n_features), float(tags.sum())
    text = np.repeat(np.arange(len(s.n)), s.count)
    first = np.cumsum(s.count) - s.count
    has = s.count > 0
    ends = int((s.toxic[has] & (s.at[(first + s.count - 1)[has]] == s.n[has] - 1)).sum())
    starts = int((s.toxic[has] & (s.at[first[has]] == 0)).sum())
    stay = float((tags[1:] & tags[:-1] & (np.diff(s.at) == 1) & (text[1:] == text[:-1])).sum())
    away, into = gold_bias - stay - ends, gold_bias - stay - starts
    total = float(np.maximum(s.n - 1, 0).sum())
    gold_pairs = np.array([[total - stay - away - into, into], [away, stay]])
    w, bias, trans = np.zeros(n_features), -2.0, np.zeros((2, 2))
    n = float(max(1, len(s.n)))
    mom, sq = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    for step in range(1, rounds + 1):
        marginal, pairs, toxic = chain(s.n, s.count, s.at, s.weights(w), trans, bias, pairs=True)
        grads = [(gold_feature - s.by_feature(marginal, n_features)) / n - decay * w, (gold_bias - toxic) / n - decay * bias, (gold_pairs - pairs) / n - decay * trans]
        new = []
        for k, (x, g) in enumerate(zip((w, bias, trans), grads)):
            mom[k] = 0.9 * mom[k] + 0.1 * g
            sq[k] = 0.99 * sq[k] + 0.01 * g * g
            new.append(x + rate * (mom[k] / (1 - 0.9**step)) / (np.sqrt(sq[k] / (1 - 0.99**step)) + 1e-8))
        w, bias, trans = new[0], float(new[1]), new[2]
    model = {"w": w, "bias": bias, "trans": trans}
    unseen = Sample([r for r in rows if r["calibrate"]])
    if not len(unseen.toxic) or unseen.toxic.min() == unseen.toxic.max():  # too few to spare any
        unseen = Sample(rows)
    x, _ = summarise(model, unseen.n, unseen.count, unseen.at, unseen.weights(w))
    return model | {"calibration": _logistic(x, unseen.toxic.astype(float))}


def summarise(model: dict, n: np.ndarray, count: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the log odds of the strongest marginal and the log of one plus the expected number of toxic tokens at
    the places; then the marginals at the places."""
    (p,) = chain(n, count, at, weight, model["trans"], model["bias"])
    top, total = np.zeros(len(n)), np.bincount(np.repeat(np.arange(len(n)), count), weights=p, minlength=len(n))
    has = count > 0
    if has.any():
        top[has] = np.maximum.reduceat(p, (np.cumsum(count) - count)[has])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log1p(total)], 1), p


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps, intercept last; classes weigh as they occur."""
    if not len(x) or y.min() == y.max():
        return np.array([0.0, 0.0, -20.0])
    a = np.hstack([x, np.ones((len(x), 1))])
    c = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(3)
        c = c + np.clip(np.linalg.solve(h, a.T @ (y - p) - 0.1 * c), -5, 5)
    return c


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(sample(docs, labels, per_class), "sample")
    features = select_features(frequencies(rows.where("not calibrate").select("text", "toxic")))
    found = training_rows(rows, features)
    scratch.drop()
    return fit(found, len(features)) | {"features": features}


def _scored(model: dict, texts: list[bytes], tagger: Tagger) -> tuple[np.ndarray, list]:
    got = [tagger.events(t) for t in texts]
    weight = tagger.weights(model["w"])
    count = np.array([len(at) for _, at, _ in got], np.int64)
    at = np.concatenate([a for _, a, _ in got])
    x, p = summarise(model, np.array([n for n, _, _ in got], np.int64), count, at, weight[np.concatenate([k for _, _, k in got])])
    c = model["calibration"]
    score = 1 / (1 + np.exp(-np.clip(x @ c[:2] + c[2], -30, 30)))
    edge = np.cumsum(count)[:-1]
    return score, list(zip(np.split(at, edge), np.split(p, edge)))


def spans_of(text: bytes, at: np.ndarray, p: np.ndarray) -> list[dict]:
    """Character offsets of the tokens with a marginal of at least one half."""
    bad = {int(a): float(x) for a, x in zip(at, p) if x >= 0.5}
    if not bad:
        return []
    out, s = [], text.decode("utf-8", "replace")
    for i, hit in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", s)):
        if i in bad:
            out.append({"start": hit.start(), "end": hit.end(), "marginal": bad[i]})
    return out


def score(docs: DataFrame, model: dict, keep: list[str], threshold: float = THRESHOLD, spans: bool = False, clean_only: bool = False, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, then score, predicted, n_toxic_tokens and, if asked for, the offending spans; ``clean_only``: the
    columns ``keep`` of the rows that aren't predicted toxic. Own columns may have any names, these among them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        tagger = Tagger(sent.value["features"])
        for batch, texts in in_chunks(batches, "__text"):
            value, found = _scored(sent.value, texts, tagger)
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array([int((p >= 0.5).sum()) for _, p in found], pa.int64())]
            names = [*(f"k{i}" for i in range(len(keep))), "score", "predicted", "n_toxic_tokens"]
            if spans:
                columns.append(pa.array([spans_of(t, a, p) for t, (a, p) in zip(texts, found)], span_type))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    names = {f"k{i}": c for i, c in enumerate(keep)}
    frame = docs.select(*[col(c).alias(k) for k, c in names.items()], col(text_col).alias("__text"))
    out = arrow_map(frame, run, fields(docs, names, "score double, predicted int, n_toxic_tokens long", *(["spans array<struct<start:long,end:long,marginal:double>>"] if spans else [])))
    return out.where(out["predicted"] == 0).select(*names).toDF(*keep) if clean_only else out.toDF(*keep, *out.columns[len(keep) :])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_toxic_tokens")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels), docs.columns, clean_only=True)
