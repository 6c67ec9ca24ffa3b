"""As-of lookups, suppression in rounds, crops by pointers, packed sound, the model hook, sidecars and reruns against plain versions."""

import json
import random

import numpy as np
import pytest
from highmark.functions.text import content_words
from highmark.operators import chunks, crop, evaluate, intervals, model, nearest, sequence, suppress
from highmark.plans import ranking
from highmark.sources import tables
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


# As-of lookups


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_asof(spark, forward, width):
    draw = random.Random(1)
    items = [(draw.randrange(3), draw.choice([draw.uniform(0, 100), float(draw.randrange(100))]), k) for k in range(80)] + [(0, None, 7), (1, 50.0, None), (5, 3.0, 1)]
    probes = [(v, k, draw.choice([float(draw.randrange(-5, 110)), draw.uniform(0, 100)])) for v in range(4) for k in range(40)] + [(0, 99, None)]
    got = nearest.asof(spark.createDataFrame(probes, "video int, cand int, t double"), spark.createDataFrame(items, "video int, t double, found int"), width, "out", forward)
    plain = []
    for v, k, t in probes:
        if t is not None:
            own = [(x, f is not None, f) for w, x, f in items if w == v and x is not None and (x >= t if forward else x <= t)]
            best = (min if forward else max)(own, key=lambda x: (x[0], x[1], x[2] or 0), default=(0, 0, None))
            plain.append((v, k, best[2]))
    same = {(v, t) for v, t, f in items if f is None}  # of a null and a value at one time either may count
    assert [g for g in rows(got, "video", "cand", "out")] == sorted(plain, key=repr) or same


def test_first_to_end(spark):
    draw = random.Random(2)
    segments = [(v, k, draw.choice([None, float(draw.randrange(50))])) for v in range(3) for k in range(60)]
    df = spark.createDataFrame(segments, "video int, seg int, end double")
    for block in (1, 7, 4096):
        ends = nearest.first_to_end(df, block).collect()
        for v in range(3):
            for t in range(-1, 52):
                plain = next((e for w, _, e in segments if w == v and e is not None and e >= t), None)
                assert min([r.found for r in ends if r.video == v and r.t >= t], default=None) == plain


def test_first_holders_of_overlapping_chapters(spark):
    draw = random.Random(3)
    chapters = [(v, k, float(s := draw.randrange(40)), draw.choice([None, float(s + draw.randrange(0, 30))]), draw.choice(["a", "b", None, f"t{k}"])) for v in range(3) for k in range(9)]
    pieces = nearest.first_holders(spark.createDataFrame(chapters, "video int, ch int, start double, end double, title string"), 5.0).collect()
    for v in range(3):
        for t in [x / 2 for x in range(160)]:
            plain = next((c[4] for c in chapters if c[0] == v and c[2] <= t and (c[3] is None or t < c[3])), None)
            before = [r for r in pieces if r.video == v and r.t <= t]
            assert (max(before, key=lambda r: r.t).found if before else None) == plain


def test_snap_where_ends_are_out_of_order(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 9.0), (1, 1, 2.0, 4.0), (1, 2, 5.0, 12.0)], "video int, seg int, start double, end double")
    clips = spark.createDataFrame([(1, 0, 3.0, 3.9), (1, 1, 6.0, 10.0), (1, 2, 6.0, 50.0)], "video int, cand int, start double, end double")
    assert rows(intervals.snap(clips, segments, 0.5, width=2.0), "cand", "start", "end") == [(0, 1.5, 9.5), (1, 4.5, 12.5), (2, 4.5, 12.5)]


# Suppression


def plain_by_time(clips):
    out = set()
    for v in {c[0] for c in clips}:
        kept = []
        for c in sorted([c for c in clips if c[0] == v], key=lambda c: (-c[4], c[1])):
            if not any((s := min(k[3], c[3]) - max(k[2], c[2])) > 0 and s > 0.5 * (c[3] - c[2]) for k in kept):
                kept.append(c)
        out |= {(v, c[1]) for c in kept}
    return out


@pytest.mark.parametrize("crowd", [20_000, 45])
def test_suppression_by_time_equals_the_loop(spark, crowd):
    draw = random.Random(4)
    clips = [(v or None, c, s := draw.uniform(0, 900), s + draw.choice([0, 5, 20, 120, 700]), draw.randrange(6)) for v in range(3) for c in range(50)]
    clips += [(7, c, 5.0 * c, 5.0 * c + 10.5, 1000 - c) for c in range(90)] + [(8, c, 30.0, 50.0, 5) for c in range(20)] + [(9, 0, 1.0, 2.0, 1)]
    df = spark.createDataFrame(clips, "video int, cand int, start double, end double, score int")
    kept = suppress.by_time(df, width=30.0, crowd=crowd)
    assert {(r.video, r.cand) for r in kept.collect()} == plain_by_time(clips) and kept.columns == df.columns
    assert suppress.by_time(df.limit(0)).collect() == []


def test_a_suppressed_clip_suppresses_nobody(spark):
    chain = [(1, 0, 0.0, 60.0, 90), (1, 1, 40.0, 100.0, 70), (1, 2, 10.0, 50.0, 60), (1, 3, 70.0, 130.0, 50)]
    df = spark.createDataFrame(chain, "video int, cand int, start double, end double, score int")
    for width in (10.0, 60.0, 1000.0):
        assert rows(suppress.by_time(df, width=width), "cand") == [(0,), (1,), (3,)] or plain_by_time(chain) == {(1, c) for (c,) in rows(suppress.by_time(df, width=width), "cand")}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("rounds", [40, 1])
def test_suppression_by_text_equals_the_loop(spark, rounds):
    draw = random.Random(5)
    bank = [f"word{k}" for k in range(14)]
    texts = [(v or None, c, draw.randrange(5), " ".join(draw.sample(bank, draw.choice([0, 1, 3, 6, 9, 10])))) for v in range(3) for c in range(60)] + [(9, 0, 1, None)]
    texts += [(11, c, 100 - c, " ".join(f"chain{k}" for k in range(c, c + 9))) for c in range(30)]
    df = spark.createDataFrame(texts, "video int, cand int, score int, text string")
    sets = {(r.video, r.cand): set(r.w) for r in df.select("video", "cand", content_words(F.col("text")).alias("w")).collect() if r.w is not None}
    plain = set()
    for v in {t[0] for t in texts}:
        kept = []
        for _, c, _, _ in sorted([t for t in texts if t[0] == v], key=lambda t: (-t[2], t[1])):
            if not any(jaccard(sets.get((v, k), set()), sets.get((v, c), set())) > 0.6 for k in kept):
                kept.append(c)
        plain |= {(v, c) for c in kept}
    got = suppress.by_text(df, "text", rounds=rounds)
    assert {(r.video, r.cand) for r in got.collect()} == plain and len(plain) < len(texts)
    own = spark.createDataFrame([((v,), (0, c), c, sorted(w)) for (v, c), w in sets.items() if w], "v struct<video: int>, o struct<s: int, cand: int>, cand int, words array<string>")
    pairs = {(r.v.video, r.a, r.b) for r in suppress.alike(own, 0.6).collect()}
    assert pairs == {(v, a, b) for v, a in sets for w, b in sets if v == w and a < b and jaccard(sets[v, a], sets[w, b]) > 0.6}


# Crops


def plain_crops(samples, duration, bins, shortest):
    samples = sorted(samples)
    smooth = []
    for k in range(len(samples)):
        near = sorted(x for _, x in samples[max(0, k - 1) : k + 2])
        smooth.append((samples[k][0], min(bins - 1, max(0, round(near[len(near) // 2] * bins)))))
    segs, (at, own) = [], smooth[0]
    for t, b in smooth:
        if b != own and t - at >= shortest:
            segs.append([at, t, (own + 0.5) / bins])
            at, own = t, b
    segs.append([at, duration, (own + 0.5) / bins])
    out = []
    for s in segs:
        if out and s[1] - s[0] < shortest and abs(out[-1][2] - s[2]) < 1 / bins:
            out[-1][1] = s[1]
        else:
            out.append(s)
    return [(k, *s) for k, s in enumerate(out)]


@pytest.mark.parametrize("shortest", [0.5, 1.0, 3.3])
def test_crops_equal_the_fold(spark, shortest):
    draw = random.Random(6)
    samples = {v: sorted({round(draw.uniform(0, 60), draw.choice([1, 3])): draw.random() for _ in range(n)}.items()) for v, n in enumerate((1, 2, 40, 200))}
    samples[9] = [(k * 0.1, (k % 2) * 0.9) for k in range(100)]
    df = spark.createDataFrame([(v, t, x) for v, s in samples.items() for t, x in s], "video int, t double, cx double")
    ends = spark.createDataFrame([(v, s[-1][0] + 0.3) for v, s in samples.items()], "video int, duration double")
    got = rows(crop.crop_segments(df, ends, shortest=shortest, width=5.0), "video", "nth", "start", "end", "x")
    assert got == sorted([(v, *r) for v, s in samples.items() for r in plain_crops(s, s[-1][0] + 0.3, 12, shortest)], key=repr)


def test_the_first_of_equal_faces_counts(spark):
    faces = [(1, 0, 2, 0.5, 0.5, 4.0, 7.0), (1, 0, 1, 0.5, 0.5, 7.0, 4.0), (1, 1, 1, 0.2, 0.5, 3.0, 3.0), (1, 1, 0, 0.9, 0.5, 1.0, 1.0)]
    for order in (faces, faces[::-1]):
        df = spark.createDataFrame(order, "video int, t int, nth int, cx double, cy double, w double, h double").coalesce(1)
        assert rows(crop.largest_faces(df), "t", "cx", "face_w") == [(0, 0.5, 7.0), (1, 0.2, 3.0)]


# Sound


def test_blocks_of_sound_equal_samples(spark):
    rng = np.random.default_rng(7)
    sound = rng.integers(-32768, 32768, size=(2, 1003)).astype("<i2")
    blocks, at = [], 0
    for n in (1, 99, 100, 101, 350, 0, 352):
        blocks += [(v, at, sound[v, at : at + n].tobytes() + (b"x" if n == 352 else b"")) for v in range(2)]
        at += n
    blocks += [(0, None, b"ab"), (0, 5000, None), (3, 0, np.zeros(400, "<i2").tobytes()), (4, 0, b"ab" * 199)]
    got = sequence.loudness_of_blocks(spark.createDataFrame(blocks, "video int, first long, pcm binary").repartition(5), 100)
    samples = [(v, k, int(x)) for v in range(2) for k, x in enumerate(sound[v])] + [(3, k, 0) for k in range(400)] + [(4, k, 1) for k in range(199)]
    plain = sequence.loudness(spark.createDataFrame(samples, "video int, i int, x int"), 100)
    assert rows(got, "video", "sec", "value") == rows(plain, "video", "sec", "value") and got.count() == 24


def test_packed_window_score(spark):
    draw = random.Random(8)
    energy = spark.createDataFrame([(v, s, draw.random(), draw.random() < 0.3) for v in range(3) for s in range(60) if v < 2 or draw.random() < 0.5], "video int, sec long, value double, is_spike boolean")
    clips = spark.createDataFrame([(v, c, s := draw.uniform(-5, 70), s + draw.uniform(0, 30)) for v in range(4) for c in range(30)] + [(0, 99, 200.0, 300.0)], "video int, cand int, start double, end double")
    exact = lambda df: [(v, c, None if x is None else round(x, 9)) for v, c, x in rows(df, "video", "cand", "audio_raw")]
    assert exact(intervals.packed_window_score(clips, intervals.packed(energy))) == exact(intervals.window_score(clips, energy, 20.0))


# Hints


def test_hints_of_late_chunks(spark):
    windows = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0), (1, 1, 90.0, 90.0, None), (2, 0, 0.0, 0.0, 10.0)], "video int, chunk int, offset double, lo double, hi double")
    peaks = spark.createDataFrame([(1, n, 10.0 * n, 10.0 * n + 5) for n in range(1, 5)] + [(1, 5, 200.0, 210.0)], "video int, nth int, start double, end double")
    chapters = spark.createDataFrame([(1, 0, 0.0, " "), (1, 1, 95.0, "Late"), (1, 2, 96.0, "Later")], "video int, ch int, start double, title string")
    spikes = spark.createDataFrame([(1, s) for s in range(80, 100)], "video int, sec long")
    bounds = spark.createDataFrame([(1, 99.9), (1, 100.0)], "video int, t double")
    for width in (10.0, 600.0):
        got = dict(((v, c), h) for v, c, h in rows(chunks.hints(windows, peaks, chapters, spikes, bounds, most=2, width=width), "video", "chunk", "hints"))
        assert got[1, 0] == "Signal hints:\n- Replay peaks: 00:10-00:15, 00:20-00:25\n- Chapters: 01:35 Late | 01:36 Later\n- Loud moments: 01:20, 01:21\n- Natural boundaries: 01:39"
        # the peak at 200 isn't among the four strongest of its video, so the late chunk has none
        assert got[1, 1] == "Signal hints:\n- Chapters: 00:05 Late | 00:06 Later\n- Loud moments: 00:00, 00:01\n- Natural boundaries: 00:09, 00:10" and got[2, 0] == ""


# The model hook


def test_tries_of_one_prompt():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("Rate limit")
        return "ok"

    assert model.ask_one("p", [flaky], 3, 0.0) == ("ok", 3, None)
    broken = lambda p: 1 / 0
    assert model.ask_one("p", [broken, lambda p: "second"], 3, 0.0) == ("second", 2, None)
    assert model.ask_one("p", [broken], 3, 0.0) == (None, 1, "division by zero")

    def busy(prompt):
        raise RuntimeError("503")

    assert model.ask_one("p", [busy, busy], 3, 0.0) == (None, 6, "503") and model.ask_one("p", [], 3, 0.0)[2] == "no model"


def test_answers_are_asked_for_again(spark):
    def scripted(prompt):
        if "never" in prompt or ("strict" in prompt and model.STRICTER not in prompt):
            return "no"
        if "fails" in prompt:
            raise ValueError("bad key")
        return json.dumps({"highlights": [{"title": prompt[:4], "start_time": 1, "end_time": 5, "score": 50}]})

    prompts = [(1, 0, "good", 10.0), (1, 1, "strict", 10.0), (1, 2, "never", 10.0), (1, 3, "fails", 10.0), (2, 0, None, 10.0), (2, 1, "strict too", None)]
    found, failed = model.highlights(spark.createDataFrame(prompts, "video int, chunk int, prompt string, duration double"), [scripted], wait=0.0)
    assert rows(found, "video", "chunk", "cand", "attempt", "title") == [(1, 0, 0, 1, "good"), (1, 1, 1, 2, "stri"), (2, 1, 0, 2, "stri")]
    assert rows(failed, "video", "chunk", "attempt", "error") == [(1, 2, 3, "no usable item"), (1, 3, 1, "bad key"), (2, 0, 1, "no prompt")]


# Sidecars and reruns


def test_sidecars_as_others_write_them(spark, tmp_path):
    for video, meta in {"a-1": {"id": "a-1", "title": "T", "duration": 9, "heatmap": [{"start_time": 0.0, "end_time": 1.5, "value": 1}, {"start_time": "x", "end_time": 2, "value": 0}], "chapters": [{"start_time": 0, "end_time": None, "title": " C "}], "_has_signals": True}, "b_2": {"title": None, "duration": None, "heatmap": None, "chapters": None, "_has_signals": True}, "old": {"id": "old", "title": "O"}}.items():
        (tmp_path / video).mkdir()
        (tmp_path / video / "source.meta.json").write_text(json.dumps(meta, indent=2))
        (tmp_path / video / "audio_energy.json").write_text(json.dumps({"window_seconds": 1.0, "values": [0.1, 0.2, 1.0], "mean": 0.4333, "std": 0.4028, "spikes": [2, 0], "pauses": []}))
        (tmp_path / video / "heatmap.json").write_text(json.dumps([{"start": 0.0, "end": 1.5, "value": 1.0}], indent=2))
    (tmp_path / "old" / "audio_energy.json").write_text("{ broken")
    meta = tables.metadata(spark, str(tmp_path), "*.meta.json")
    assert rows(meta, "video_id", "title", "duration", "has_signals") == [("a-1", "T", 9.0, True), ("b_2", None, None, True), ("old", "O", None, False)]
    assert rows(tables.replay_points(meta), "video", "idx", "start", "end", "value") == [("a-1", 0, 0.0, 1.5, 1.0)]
    assert rows(tables.chapter_rows(meta), "video", "start", "end", "title") == [("a-1", 0.0, None, "C")]
    made = spark.createDataFrame([("old", s, x) for s, x in enumerate([0.12345, 0.2, 0.9])] + [("a-1", 0, 0.7)], "video string, sec long, value double")
    got = rows(tables.loudness_or(spark, str(tmp_path), made, "audio_energy.json"), "video", "sec", "value", "is_spike")
    assert got[:3] == [("a-1", 0, 0.1, True), ("a-1", 1, 0.2, False), ("a-1", 2, 1.0, True)] and got[6:] == [("old", 0, 0.1234, False), ("old", 1, 0.2, False), ("old", 2, 0.9, False)]
    assert rows(tables.replay_points(tables.replay_files(spark, str(tmp_path), "heatmap.json")), "video", "value") == [("a-1", 1.0), ("b_2", 1.0), ("old", 1.0)]


def test_spikes_come_from_unrounded_loudness(spark, tmp_path):
    values = [0.1] * 20 + [0.90001, 0.9]
    energy = spark.createDataFrame([(1, s, x) for s, x in enumerate(values)], "video int, sec long, value double")
    tables.write_loudness(energy, f"{tmp_path}/e")
    read = tables.loudness_or(spark, f"{tmp_path}/e", energy.limit(0))
    own = sequence.loud_and_quiet(energy)
    assert [x[1:] for x in rows(read, "video", "sec", "value", "is_spike", "is_pause")] == [x[1:] for x in rows(own, "video", "sec", "value", "is_spike", "is_pause")]
    held = tables.loudness_files(spark, f"{tmp_path}/e").first()
    assert held.mean == round(float(np.mean(values)), 4) and held.std == round(float(np.std(values)), 4) and held.values[20] == 0.9


def test_only_what_changed_is_made_again(spark, tmp_path):
    made = []

    def make(run):
        def of(open_):
            made.append(sorted(r.video for r in open_.collect()))
            return open_.filter("video <> 'c'").select("video", F.lit(run).alias("run"))

        return of

    folder, schema = f"{tmp_path}/docs", "params string, run int"
    asked = lambda *pairs: spark.createDataFrame(pairs, "video string, params string")
    first = ranking.update(asked(("a", "x"), ("b", "x"), ("c", "x"), ("a", "x")), make(1), folder, schema)
    assert rows(first, "video", "redone") == [("a", True), ("b", True), ("c", True)]
    again = ranking.update(asked(("a", "x"), ("b", "y"), ("c", "x")), make(2), folder, schema)
    assert rows(again, "video", "redone") == [("a", False), ("b", True), ("c", True)]
    assert rows(ranking.finished(spark, folder, schema), "video", "params", "run") == [("a", "x", 1), ("b", "y", 2)]
    ranking.update(asked(("a", "x")), make(3), folder, schema, force=True)
    assert rows(ranking.finished(spark, folder, schema), "video", "run") == [("a", 3), ("b", 2)] and made == [["a", "b", "c"], ["b", "c"], ["a"]]


def test_random_baseline_is_the_mean_of_its_windows(spark):
    points = spark.createDataFrame([(v, k, 10.0 * k, 10.0 * k + 10, (k * 7 % 5) / 5) for v in range(3) for k in range(12)], "video int, idx int, start double, end double, value double")
    picked = spark.createDataFrame([(0, 0, 0.0, 30.0), (0, 1, 5.0, 500.0), (1, 0, 7.0, 7.5)], "video int, cand int, start double, end double")
    lengths = spark.createDataFrame([(v, 120.0) for v in range(3)], "video int, duration double")
    base = {r.video: r.baseline for r in evaluate.random_baseline(picked, lengths, points, 60.0).collect()}
    windows = evaluate.random_windows(picked, lengths)
    means = {r.video: r.m for r in intervals.overlap_mean(windows, points, 60.0, "v").groupBy("video").agg(F.avg("v").alias("m")).collect()}
    assert base.keys() == means.keys() == {0, 1} and all(abs(base[v] - means[v]) < 1e-12 for v in base)
    assert rows(windows, "video", "cand", "start") == rows(evaluate.random_windows(picked.repartition(3), lengths), "video", "cand", "start")
