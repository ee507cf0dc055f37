"""Micro fixtures for edges: ties, gaps, missing values, enclosed intervals, and known statistics."""

import datetime
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from duet.functions import scorers
from duet.functions import text as T
from duet.operators import align, fusion, models, reports, rollup, stats, timeline, turns
from duet.plans import catalog, pipeline
from duet.sources import documents, tables


def test_zscore_edges(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("c", 9.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.x): r.z for r in stats.zscore(df, {"x": "z"}, ["g"]).collect()}
    assert got["b", 5.0] == got["c", 9.0] == got["a", None] == 0
    assert got["a", 1.0] == pytest.approx(-math.sqrt(0.5))
    assert stats.zscore(df, {"x": "z"}, ["g"], missing="null").where("x is null").first().z is None


def test_zscore_mean_zero_sd_one(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.sin(F.col("id")).alias("x"))
    for r in stats.zscore(df, {"x": "z"}, ["g"]).groupBy("g").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect():
        assert abs(r.m) < 1e-12 and r.s == pytest.approx(1)


def test_gap_edges_and_enclosed_word(spark):
    words = [(0.0, 1.0), (0.2, 0.4), (1.34, 2.0), (2.36, 2.5), (5.0, 5.1)]
    df = spark.createDataFrame([("s", a, b) for a, b in words], "k string, s double, e double")
    got = [(r.start_s, r.end_s) for r in timeline.speech_regions(df, ["k"]).orderBy("start_s").collect()]
    assert got == [(0.0, 2.0)]  # 2.36-2.5 and 5.0-5.1 are too short
    turn = timeline.speaker_turns(df.withColumn("p", F.lit(1)), ["k"], "p", "s", "e", ["s"], gap=1.5)
    assert [r.turn_index for r in turn.orderBy("s").collect()] == [0, 0, 0, 0, 1]


def test_asof_ties_and_nearest_ties(spark):
    left = spark.createDataFrame([("k", 5.0), ("k", 0.5)], "k string, t double")
    right = spark.createDataFrame([("k", 5.0, 1, "x"), ("k", 5.0, 2, "y"), ("k", 7.0, 3, "z")], "k string, at double, r int, v string")
    got = {r.t: r.v for r in timeline.asof_backward(left, right, ["k"], "t", "at", {"v": "v"}, rank="r").collect()}
    assert got == {5.0: "y", 0.5: None}
    left = spark.createDataFrame([("k", 6.0)], "k string, t double")
    assert timeline.nearest(left, right, ["k"], "t", "at", {"v": "v"}, "r").first().v == "x"


def test_sliding_windows(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.0, 0.6), (0.0, 3.0)], "start_s double, end_s double")
    got = sorted((r.end_s, r.win_start, r.win_end) for r in timeline.sliding_windows(df).collect())
    assert got == [(0.6, 0.0, 0.6), (3.0, 0.0, 1.5), (3.0, 0.75, 2.25), (3.0, 1.5, 3.0), (3.0, 2.25, 3.0)]


@pytest.mark.parametrize("n,width", [(25, 3), (34, 4), (80, 9)])
def test_rolling_width(spark, n, width):
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id"), F.col("id").cast("double").alias("x"))
    got = [r.rolled for r in timeline.rolling_mean(df, "x", ["g"], ["id"]).orderBy("id").collect()]
    after = (width - 1) // 2
    want = [np.mean(range(max(0, i - (width - 1 - after)), min(n, i + after + 1))) for i in range(n)]
    assert got == pytest.approx(want)


def test_discord_is_strict(spark):
    df = spark.createDataFrame([(0.5, -0.6), (0.51, -0.6), (-0.6, 0.7), (0.6, 0.7)], "ac_z double, tx_z double")
    got = {(r.ac_z, r.tx_z): (r.discord_flag, r.discord_type) for r in fusion.discord(df).collect()}
    assert got == {(0.5, -0.6): (0, ""), (0.51, -0.6): (1, "negative_words_bright_voice"), (-0.6, 0.7): (1, "positive_words_flat_voice"), (0.6, 0.7): (0, "")}


def test_prop_negative_counts_all_rows(spark):
    df = spark.createDataFrame([("a", "negative"), ("a", None), ("b", None)], "g string, stance string")
    assert {r.g: r.p for r in df.groupBy("g").agg(rollup.prop_negative().alias("p")).collect()} == {"a": 0.5, "b": None}


def test_label_strings(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "A1"), (4, "A1|B2")], "i int, c string")
    assert sorted((r.i, r.code_id) for r in rollup.explode_codes(df, "c").collect()) == [(3, "A1"), (4, "A1"), (4, "B2")]


@pytest.mark.parametrize("said,want,odd", [
    ("my study ID is PN-012", "PN012", False), ("P p.m. 004, study id", "PN004", False), ("study iv P-N-O-21", "PN021", False),
    ("PIN 032 i consent to participate", "PN032", False), ("study id PN00128", "PN001", True), ("my study ID is 045", "PN045", True),
])
def test_spoken_ids(spark, said, want, odd):
    df = spark.createDataFrame([(1, 1, 1, said)], "s int, spk int, o int, t string")
    r = turns.recover_ids(df, "s", "spk", "o", "t").first()
    assert (r.participant_id, r.id_needs_review) == (want, odd)


def test_cue_search_orders_sections(spark):
    said = ["we talk of services and challenges later", "now the first question, please describe your experience here", "the next few questions are on", "services in the EU", "next section is challenges"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "s int, o int, t string")
    got = turns.topic_boundaries(df, "s", "o", "t", T.SECTIONS).orderBy("rank").collect()
    assert [r.topic for r in got] == ["experiences", "services", "challenges"]
    assert got[0].offset < got[1].offset < got[2].offset


def test_sentence_chop_and_tokens(spark):
    df = spark.createDataFrame([("One two. Three? " + " ".join(["w"] * 50),)], "t string")
    assert [len(r.sentence.split()) for r in T.sentences(df, "t").orderBy("sentence_no").collect()] == [2, 1, 45, 5]
    got = spark.createDataFrame([("It's [laughs] (sic) OK-now 3x",)], "t string").select(T.tokens(F.col("t")).alias("w")).first().w
    assert got == ["it's", "ok", "now", "3x"]


def test_redaction(spark):
    df = spark.createDataFrame([("Call Anneke at +1 416 555 0101 or a.b@c.org; Banneker stays",)], "t string")
    assert df.select(T.redact(F.col("t"), ["Anneke"]).alias("x")).first().x == "Call [NAME] at [PHONE] or [EMAIL]; Banneker stays"
    df = spark.createDataFrame([("Ann Lee came", [(1, 2), (4, 5)])], "t string, s array<struct<start:int,end:int>>")
    assert T.redact_spans(df, "t", "s").first().t == "[NAME] came"
    assert T.hide("Ann Lee came by, said Bo-Li’s aunt.", [(1, 2), (4, 5), (22, 24)], "#") == "# came by, said # aunt."
    assert T.hide("Ann, then Bo", [(10, 12), (0, 3), (1, 2)], "#") == "#, then #" and T.hide("none", [], "#") == "none"


def test_wer_and_alignment(spark):
    assert align.edit_counts("a b c d".split(), "a x c".split()) == (2, 4)
    times, share = align.align_words(list("abcd"), list("abcd"), [0, 1, 2, 3], [1, 2, 3, 4])
    assert share == 1 and times == [(0, 1), (1, 2), (2, 3), (3, 4)]
    times, share = align.align_words(list("axd"), list("abcd"), [0, 1, 2, 3], [1, 2, 3, 4])
    assert times[1] == (2, 3) and share == pytest.approx(2 / 3)
    assert align.align_words(["q"], ["r"], [0], [1]) == (None, 0.0)


def test_spectral_clusters():
    rng = np.random.default_rng(1)
    a = np.vstack([rng.normal(c, 0.05, (12, 8)) for c in np.eye(8)[:3] * 3])
    labels = align.spectral_labels(a)
    assert len(set(labels)) == 3 and all(len(set(labels[i : i + 12])) == 1 for i in (0, 12, 24))
    assert set(align.spectral_labels(a[:3])) == {0}


def test_reml_matches_balanced_anova(spark):
    rng = np.random.default_rng(3)
    groups, per = 12, 9
    y = rng.normal(0, 1, groups)[:, None] + rng.normal(0, 0.7, (groups, per)) + 2
    df = spark.createDataFrame([(g, float(v)) for g in range(groups) for v in y[g]], "g int, y double")
    stats_ = models.sufficient(df, "y", {"Intercept": F.lit(1.0)}, "g")
    m = models.reml(stats_)
    within = y.var(axis=1, ddof=1).mean()
    between = per * y.mean(axis=1).var(ddof=1)
    assert m["var_residual"] == pytest.approx(within, rel=1e-4)
    assert m["var_group"] == pytest.approx((between - within) / per, rel=1e-4)
    assert m["beta"][0] == pytest.approx(y.mean())


def test_p_values():
    assert stats.t_p_value(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_p_value(0, 5) == pytest.approx(1)


def test_p_column_equals_p_value(spark):
    rows = [(t, n) for n in (2, 3, 4, 5, 8, 33, 151, 1000) for t in (0.0, -0.3, 1.7, 4.5)]
    for r in spark.createDataFrame(rows, "t double, n long").withColumn("p", stats.t_p("t", "n - 1")).collect():
        assert r.p == pytest.approx(stats.t_p_value(r.t, r.n - 1), abs=1e-12)
    assert stats.normal_p_value(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_corr_without_spread_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(stats.corr("a", "b").alias("r")).first().r is None
    checks = reports.corr_checks(df, [("a", "b", "positive")]).first()
    assert checks.verdict == "CHECK ALIGNMENT" and checks.r is None


def test_guards():
    with pytest.raises(RuntimeError):
        scorers.guard_failures(2, 10)
    scorers.guard_failures(1, 10)
    with pytest.raises(ValueError):
        rollup.require_coverage(8, 10)


def test_scorer_stance(spark):
    df = spark.createDataFrame([("good good",), ("",), ("plain",), ("good bad",)], "t string")
    got = {r.t: (r.tx_stance, r.tx_valence) for r in scorers.LexiconSentiment(["good"], ["bad"]).apply(df, "t").collect()}
    assert got[""] == (None, None) and got["good good"][0] == "positive" and got["good bad"][1] == 0 and got["plain"][0] == "neutral" or got["plain"][0] == "mixed"


def test_scorer_has_no_cap_on_hits(spark):
    texts = ["bad " * 21 + "good " * 318, "bad " * 59 + "good " * 30, "bad " * 25 + "good " * 25, "good " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.tx_emotion_label, r.tx_stance, r.tx_valence) for r in scorers.LexiconSentiment(["good"], ["bad"]).apply(df, "t").collect()}
    assert got[0] == ("positive", "positive", 1.0) and got[3] == ("positive", "positive", 1.0)
    assert got[1][:2] == ("negative", "negative") and got[1][2] == pytest.approx(-1, abs=1e-9)
    assert got[2] == ("negative", "mixed", 0.0)  # a true tie


def test_codebook(spark):
    page = "# Book\n\n## Domain A — Care\n\n### A1 `builds_trust` — Builds trust\nMakes people\nfeel safe.\n\n- *x*\n### A2 `listens` — Listens\nHears.\n## Domain B — Flow\n### B1 `speed` — Faster\nQuick work.\n"
    got = documents.parse_codebook(spark.createDataFrame([(page,)], "v string"), "v").orderBy("code_id").collect()
    assert [(r.code_id, r.slug, r.label, r.definition) for r in got] == [("A1", "builds_trust", "Builds trust", "Makes people feel safe."), ("A2", "listens", "Listens", "Hears."), ("B1", "speed", "Faster", "Quick work.")]
    assert got[2].domain.startswith("Domain B")


def test_transcript_headings(spark):
    lines = ["title", "Interviewer:", "Hello", "there", "Participant 1", "Hi", "PN-7:", "Yes"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, n int, t string")
    got = documents.transcript_turns(df, "doc", "n", "t").orderBy("turn_index").collect()
    assert [(r.speaker_role, r.participant_id, r.text) for r in got] == [("interviewer", None, "Hello there"), ("participant", None, "Hi"), ("participant", "PN007", "Yes")]


def test_wav_measures(spark, tmp_path):
    import wave

    t = np.arange(16000) / 16000
    x = (np.sin(2 * np.pi * 220 * t) * np.where(t < 0.5, 0.001, 0.5) * 32767).astype("<i2")
    with wave.open(str(tmp_path / "2024-01-02_0930.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000), w.writeframes(x.tobytes())
    files = documents.audio_files(spark, str(tmp_path))
    r = files.first()
    assert (r.session_id, r.interview_date, r.interview_time) == ("S01", "2024-01-02", "09:30")
    q = documents.audio_qc(files).first()
    assert q.duration_min == pytest.approx(1 / 60) and q.snr_est_db > 40 and q.speech_frac == pytest.approx(0.5, abs=0.02) and q.lr_corr is None


def test_csv_round_trip_and_intake(spark, tmp_path):
    df = spark.createDataFrame([("u1", "a,\"b\""), ("u2", None)], "k string, t string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), "k string, t string").collect())) == [("u1", 'a,"b"'), ("u2", None)]
    assert [r.k for r in tables.unprocessed(df, df.limit(0), ["k"]).orderBy("k").collect()] == ["u1", "u2"]


def test_stream_equals_batch(spark, tmp_path):
    from duet.streaming import windows

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.file_stream(spark, str(tmp_path / "in"), src.schema), "ts", "1 day", ["event_type"], [F.count("*").alias("n")], late="400 days")
    q = stream.writeStream.format("memory").queryName("tumble").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windows.tumbling(src, "ts", "1 day", ["event_type"], [F.count("*").alias("n")])
    assert sorted(map(tuple, spark.table("tumble").collect())) == sorted(map(tuple, batch.collect()))


def test_pipeline_selection():
    stages = [(n, lambda t, n=n: n.upper()) for n in "abc"]
    assert [n for n, _ in pipeline.select_stages(stages, start="b")] == ["b", "c"]
    assert [n for n, _ in pipeline.select_stages(stages, only=["a", "c"], skip=["a"])] == ["c"]
    bad = [("a", lambda t: 1 / 0), ("b", lambda t: t["x"] + 1)]
    out, failed = pipeline.run(bad, {"x": 1})
    assert out["b"] == 2 and "a" in failed
    with pytest.raises(ZeroDivisionError):
        pipeline.run(bad, {"x": 1}, hard=("a",))


def test_reconcile_and_reference(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {r.status: r.n for r in rollup.reconcile(a, b, "k").collect()} == {"only_left": 1, "only_right": 1, "both": 1}


def test_group_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], 100), "c": np.array([5.0]), "d": rng.exponential(size=64) * 1e6}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("e", None)], "g string, x double")
    got = {r.g: r.q for r in stats.group_quantiles(df, ["g"], "x", [0.0, 0.1, 1 / 3, 0.99], bins=16).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g] == pytest.approx(np.quantile(x, [0.0, 0.1, 1 / 3, 0.99]).tolist())
    binned = stats.quantile_bins(df.where("g = 'b'"), "x").groupBy("val_bin").count().collect()
    assert {r.val_bin: r["count"] for r in binned} == {"low": 100, "mid": 100}


def test_quantile_bins_compute_the_column_once_for_all_rounds(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def measure(i):
        seen.add(1)
        return float(i * 7919 % 5003) ** 3

    rows = spark.range(5000).withColumn("x", measure("id"))
    binned = stats.quantile_bins(rows, "x")
    assert seen.value == 5000  # each round computed it anew
    x = np.array([float(i * 7919 % 5003) ** 3 for i in range(5000)])
    want = np.searchsorted(np.quantile(x, [1 / 3, 2 / 3]), x)
    assert [r.val_bin for r in binned.orderBy("id").collect()] == [("low", "mid", "high")[k] for k in want]


def test_forced_sample_below_and_above_the_target(spark):
    rows = spark.createDataFrame([(i, i % 2, int(i < 6)) for i in range(40)], "i long, g int, discord_flag int")
    sampled = fusion.stratified_sample(rows, ["g"], 10, "i")
    others = {r.i for r in sampled.where("discord_flag = 0").collect()}
    for target, n in ((8, 2), (6, 0), (3, 0)):  # six forced rows: room for others, none, and more forced rows than the target
        got = [r.i for r in fusion.forced_sample(sampled, rows.where("discord_flag = 1"), target, "i").collect()]
        assert len(got) == len(set(got)) == 6 + n
        assert set(range(6)) <= set(got) and set(got) - set(range(6)) <= others


def test_forced_sample_query_takes_every_discordant_row(spark):
    folder = "/root/testdata/sf0.001"
    rows = catalog.fused(spark, folder)
    want = {r.event_id for r in rows.where("discord_flag = 1").collect()}
    got = {r.event_id: r.discord_flag for r in catalog.QUERIES["forced_sample"](spark, folder).collect()}
    assert {i for i, flag in got.items() if flag == 1} == want
    sampled = {r.event_id for r in catalog.QUERIES["stratified_sample"](spark, folder).collect()}
    assert set(got) - want <= sampled
    assert len(got) == max(len(want), min(400, len(want | sampled)))


def test_csv_files_begin_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("u1", "é"), ("u2", "b")], "k string, t string").repartition(2)
    tables.write_csv(df, str(tmp_path / "c"))
    files = list((tmp_path / "c").glob("*.csv"))
    assert files and all(f.read_bytes().startswith(b"\xef\xbb\xbfk,t\n") for f in files)


def test_restricted_columns_are_written_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, shown string, secret string")
    tables.write_restricted(df, ["secret"], "k", str(tmp_path / "public"), str(tmp_path / "private"))
    assert spark.read.parquet(str(tmp_path / "public")).columns == ["k", "shown"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "private")).collect())) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        tables.write_restricted(df, ["secret"], "k", str(tmp_path / "public"), str(tmp_path / "public" / "private"))


def test_landing_and_present(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, em_x int, em_y int")
    assert tables.landing(df, {"a": "id", "q": "r"}, "_z", ("em_x", "no")).columns == ["id", "em_x_z", "em_y"]
    assert tables.present(df, ["a", "q"]) == ["a"] and tables.present(df, ["a"], ("em_",)) == ["a", "em_x", "em_y"] and tables.present(df) == []


def test_lookup_reports_files_without_a_match(spark):
    files = spark.createDataFrame([("f1", "a"), ("f2", "z"), ("f3", None)], "f string, k string")
    matched, rest = tables.lookup(files, spark.createDataFrame([("a", "S01")], "k string, s string"), "k")
    assert [(r.f, r.s) for r in matched.collect()] == [("f1", "S01")] and sorted(r.f for r in rest.collect()) == ["f2", "f3"]


def test_names_are_hidden_in_two_passes(spark):
    said = [(1, "my name is Bo Änne and José knows ANNE; banne stays"), (2, None), (3, ""), (None, "Anne's aunt Joanne, anne_2"), (1, "okay Anne")]
    df = spark.createDataFrame(said, "k int, t string")
    assert [r.name for r in T.collect_names(df, "t").collect()] == ["Bo"]  # the cue's letters are plain
    names = spark.createDataFrame([("Anne",), ("anne",), ("Bo",), ("José",)], "name string")
    got = {(r.k, r.t) for r in T.redact_names(df, "k", "t", names).collect()}
    assert got == {(1, "my name is [NAME] Änne and [NAME] knows [NAME]; banne stays"), (2, None), (3, ""), (None, "[NAME]'s aunt Joanne, anne_2"), (1, "okay [NAME]")}
    assert {r.t for r in T.redact_names(df, "k", "t", names.limit(0)).collect()} == {t for _, t in said}


def test_names_of_a_long_text_are_looked_up_by_hash(spark):
    spell = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    n = 60_000  # names in one text; searched one by one for each piece, billions of comparisons
    df = spark.createDataFrame([(1, " ".join(spell(i).capitalize() for i in range(n)) + ", 'zzzz'"), (2, "Aaaa aaab? zzzz"), (3, None)], "k int, t string")
    names = spark.range(n).select(F.concat(*[F.char(97 + F.floor(F.col("id") / 26**k) % 26) for k in range(4)]).alias("name"))
    began = time.time()
    got = {r.k: r.t for r in T.redact_names(df, "k", "t", names).collect()}
    assert time.time() - began < 15
    assert got == {1: " ".join(["[NAME]"] * n) + ", 'zzzz'", 2: "[NAME] [NAME]? zzzz", 3: None}


def test_minor_speakers_without_an_id_are_unassigned(spark):
    rows = [("s", "iv", 500), ("s", "p", 990), ("s", "x", 5), ("s", "y", 5), ("q", "iv", 1), ("q", "p", 1)]
    df = spark.createDataFrame(rows, "s string, spk string, n int").withColumn("speaker_role", F.lit("participant"))
    got = {(r.s, r.spk): r.speaker_role for r in turns.unassign_minor(df, "s", "spk", "n", "iv", df.where("spk = 'y'")).collect()}
    assert {k for k, v in got.items() if v == "unassigned"} == {("s", "x")} and len(got) == 6


def test_reference_rows_ties_and_dimension_repeats(spark):
    ref = spark.createDataFrame([("A", 50.0, "y"), ("A", 50.0, "x"), ("A", 10.0, "a"), ("B", 5.0, "b")], "c string, p double, l string")
    assert sorted(map(tuple, rollup.reference_rows(ref, "c", "p", "l").collect())) == [("A", 50.0, "x"), ("B", 5.0, "b")]
    rows, dim = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1, "b"), (1, "a"), (None, "n")], "k int, v string")
    assert sorted(((r.k, r.v) for r in rollup.attach(rows, dim, "k", ["v"]).collect()), key=repr) == [(1, "a"), (2, None), (None, None)]


def test_prompts_and_own_functions(spark):
    from duet.plans import views

    df = spark.createDataFrame([("a", 1.26), (None, None), ("{x}", -0.5)], "t string, z double")
    got = [r.p for r in df.select(scorers.render("[{t}] {z:%+.1f}!").alias("p")).collect()]
    assert got == ["[a] +1.3!", "[n/a] n/a!", "[{x}] -0.5!"]
    views.register_function(spark, "twice_of", lambda x: x * 2, "double")
    assert spark.sql("SELECT twice_of(1.5D) AS y").first().y == 3.0


def test_coder_keeps_replies_and_asks_again_only_for_the_rest(spark, tmp_path):
    asked, down, cache = tmp_path / "asked", tmp_path / "down", str(tmp_path / "cache")
    chunks = spark.createDataFrame([(i, f"p{i % 8}") for i in range(10)], "i int, prompt string").unionByName(spark.createDataFrame([(99, None)], "i int, prompt string"))

    def call(text):
        with open(asked, "a") as f:
            f.write(text + "\n")
        if text == "p3" and down.exists():
            raise OSError("busy")
        return text.upper()

    down.touch()
    with pytest.raises(RuntimeError):
        scorers.call_coder(chunks, "prompt", call, cache, attempts=2, wait=0.01)
    lines = asked.read_text().split()
    assert lines.count("p3") == 2 and sorted(lines) == sorted([f"p{i}" for i in range(8)] + ["p3"])  # one call a prompt, a retry for the failing
    down.unlink()
    got = {r.i: r.reply for r in scorers.call_coder(chunks, "prompt", call, cache, wait=0.01).collect()}
    assert got == {99: None, **{i: f"P{i % 8}" for i in range(10)}}
    assert asked.read_text().split() == lines + ["p3"]


def test_coder_stops_after_a_streak_of_failures(spark, tmp_path):
    asked = tmp_path / "asked"

    def call(text):
        with open(asked, "a") as f:
            f.write(text + "\n")
        raise OSError("throttled")

    chunks = spark.createDataFrame([(f"p{i}",) for i in range(30)], "prompt string")
    with pytest.raises(RuntimeError):
        scorers.call_coder(chunks, "prompt", call, str(tmp_path / "cache"), attempts=1, workers=1)
    assert len(asked.read_text().split()) == 3


def test_nearest_by_cosine_is_exact_over_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    x[1::9] = x[0]  # ties
    x /= np.linalg.norm(x, axis=1)[:, None]
    groups = ["g" if i < 70 else "h" if i < 89 else "one" for i in range(90)]
    df = spark.createDataFrame([(g, i, v.tolist()) for i, (g, v) in enumerate(zip(groups, x))] + [(None, 90, x[0].tolist()), ("h", 91, None)], "g string, i long, unit array<double>")
    got = sorted((r.g, r.a, r["rank"], r.b) for r in reports.cosine_topk(df, "g", "i", "unit", 4, block=16).collect())
    want = []
    for i in range(90):
        near = sorted((-round(float(x[i] @ x[j]), 9), j) for j in range(90) if j != i and groups[j] == groups[i])[:4]
        want += [(groups[i], i, n + 1, j) for n, (_, j) in enumerate(near)]
    assert got == sorted(want)
    assert reports.cosine_topk(df.limit(0), "g", "i", "unit").count() == 0


def _wav(x, rate=16000):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate), w.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_acoustic_scores_of_planted_tones(spark):
    from duet.functions import acoustic

    t = np.arange(16000) / 16000
    # a second of a low quiet tone, one of a high loud tone, one of silence
    x = np.concatenate([0.05 * np.sin(2 * np.pi * 110 * t), 0.5 * np.sin(2 * np.pi * 220 * t), np.zeros(16000)])
    files = spark.createDataFrame([("s1", _wav(x)), ("s2", b"no sound"), ("s4", None)], "session_id string, content binary")
    utterances = [("s1", "low", 0.0, 1.0), ("s1", "high", 1.0, 2.0), ("s1", "still", 2.0, 3.0), ("s1", "short", 0.0, 0.29), ("s1", "beyond", 9.0, 10.0), ("s1", "untimed", None, 1.0),
                  ("s2", "damaged", 0.0, 1.0), ("s3", "absent", 0.0, 1.0), ("s4", "empty", 0.0, 1.0)]
    u = spark.createDataFrame(utterances, "session_id string, utt_id string, start_s double, end_s double")
    got = {r.utt_id: r for r in acoustic.acoustic_scores(u, files).collect()}
    assert len(got) == len(utterances)
    assert got["low"].f0_mean == pytest.approx(24, abs=0.05) and got["high"].f0_mean == pytest.approx(36, abs=0.05)
    assert got["high"].loudness_mean > got["low"].loudness_mean and got["high"].ac_arousal > got["low"].ac_arousal
    assert got["high"].jitter < 0.01 and got["high"].shimmer < 0.2 and got["high"].hnr > 20 and got["high"].voiced_per_s == 1
    assert got["still"].f0_mean is None and got["still"].voiced_per_s == 0 and got["still"].egemaps_ok == 1
    for name in ("short", "beyond", "untimed", "absent", "empty"):
        assert got[name].egemaps_ok is None and got[name].ac_valence is None and got[name].loudness_mean is None
    assert got["damaged"].egemaps_ok == 0 and got["damaged"].f0_mean is None
    assert all(0 <= got[n][c] <= 1 for n in ("low", "high", "still") for c in acoustic.DIMENSIONS)
    assert acoustic.acoustic_scores(u.limit(0), files).count() == 0


def test_streamed_turns_equal_the_tables(spark, tmp_path):
    from duet.streaming import turns, windows

    import random

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    pick = random.Random(5)
    rows = [(k % 3, at(k * 7 + pick.random()), pick.choice(["a", "a", "b", None]), pick.choice([f"t{k}", None])) for k in range(120)]
    rows.append((0, at(100_000), "z", "end"))  # moves the watermark past all turns
    schema = "session long, ts timestamp, who string, text string"
    for k, part in enumerate([rows[:60:2] + rows[45:60:2], rows[1:44:2] + rows[60:], []]):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = turns.stream_turns(windows.file_stream(spark, str(tmp_path / "in"), schema, files=1), "ts", "session", "who", "text", 30.0, "1 hour")
    q = stream.writeStream.format("memory").queryName("turns_out").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert q.exception() is None
    sent = spark.createDataFrame([r for part in [rows[:60:2] + rows[45:60:2], rows[1:44:2] + rows[60:]] for r in part], schema)
    want = turns.table_turns(sent, "ts", "session", "who", "text", 30.0).where("who is null or who <> 'z'")
    assert sorted(map(repr, spark.table("turns_out").collect())) == sorted(map(repr, want.collect()))


def test_entry_hides_only_the_absent_package(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    class Block:
        def __init__(self, name):
            self.name = name

        def find_spec(self, name, path=None, target=None):
            if name == self.name:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    def load(name):
        import duet

        with monkeypatch.context() as patch:
            for m in [m for m in sys.modules if m in ("corpus_pipeline", "__spark_entry__") or m.startswith("duet.llm")]:
                patch.delitem(sys.modules, m)
            patch.delattr(duet, "llm", raising=False)
            patch.setattr(sys, "meta_path", [Block(name), *sys.meta_path])
            return importlib.import_module("__spark_entry__")

    found = importlib.util.find_spec("corpus_pipeline") is not None
    without = load("corpus_pipeline")
    assert not [q for q in without.queries() if q.startswith("op")] and len(without.queries()) == len(entry.catalog.QUERIES)
    if found:
        with pytest.raises(ModuleNotFoundError):
            load("duet.llm.common")
