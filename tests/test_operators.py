"""Literal cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from highmark.functions import text, timefmt, urls
from highmark.operators import answers, captions, chunks, crop, evaluate, expand, fusion, intervals, sequence, suppress
from highmark.params import DEFAULTS
from highmark.sources import tables


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


REPLAY = [(1, 0, 0.0, 10.0, 0.2), (1, 1, 10.0, 20.0, 0.5), (1, 2, 20.0, 30.0, 1.0), (1, 3, 30.0, 40.0, 0.6), (1, 4, 40.0, 50.0, 0.1)]
CHAPTERS = [(1, 0, 0.0, 15.0, "Opening"), (1, 1, 15.0, 35.0, "My biggest mistake"), (1, 2, 35.0, 50.0, "Closing")]
SEGMENTS = [(1, 0, 0.0, 2.0, "Hello there."), (1, 1, 2.5, 5.0, "I made a mistake."), (1, 2, 5.0, 8.0, "It was a secret."), (1, 3, 8.0, 12.0, "Goodbye now.")]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(REPLAY, "video int, idx int, start double, end double, value double")


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(SEGMENTS, "video int, seg int, start double, end double, text string")


@pytest.fixture(scope="module")
def energy(spark):
    values = [0.1, 0.1, 0.1, 0.9, 0.1, 0.1, 0.8, 0.1, 0.1, 0.1]
    return spark.createDataFrame([(1, k, v, k in (3, 6), k in (0, 1)) for k, v in enumerate(values)], "video int, sec long, value double, is_spike boolean, is_pause boolean")


def clips(spark, *spans):
    return spark.createDataFrame([(1, k, float(s), float(e), int(score)) for k, (s, e, score) in enumerate(spans)], "video int, cand int, start double, end double, score int")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_overlap_mean(spark, points):
    got = rows(intervals.overlap_mean(clips(spark, (0, 30, 1), (0, 0, 1), (90, 99, 1)), points, 10), "cand", "replay_raw")
    assert got == [(0, pytest.approx(17 / 30)), (1, 0.0), (2, 0.0)]


def test_overlaps_meet_once_whatever_the_bins(spark):
    rnd = random.Random(3)
    a = [(rnd.randint(1, 2), k, (s := rnd.uniform(-50, 100)), s + rnd.uniform(0, 60)) for k in range(60)]
    b = [(rnd.randint(1, 2), k, (s := rnd.uniform(-50, 100)), s + rnd.uniform(0, 60)) for k in range(60)]
    x, y = (spark.createDataFrame(r, f"video int, {n} int, start double, end double") for r, n in ((a, "cand"), (b, "k")))
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and q[3] > p[2] and q[2] < p[3])
    for width in (1.0, 7.0, 1000.0):
        assert rows(intervals.overlaps(x, y, width), "cand", "i_k") == want


def test_chapter_score(spark, points):
    c = spark.createDataFrame(CHAPTERS, "video int, ch int, start double, end double, title string")
    assert rows(intervals.chapter_score(clips(spark, (20, 30, 1), (0, 10, 1)), c), "cand", "chapter_raw") == [(0, 1.0), (1, 0.5)]
    assert rows(intervals.chapter_score(clips(spark, (20, 30, 1)), c.filter("video = 2")), "chapter_raw") == [(None,)]
    open_end = c.withColumn("end", F.when(F.col("ch") < 1, F.col("end")))
    assert rows(intervals.chapter_score(clips(spark, (90, 99, 1)), open_end), "chapter_raw") == [(1.0,)]


def test_window_score(spark, energy):
    got = dict(rows(intervals.window_score(clips(spark, (0, 2, 1), (0, 7, 1), (90, 95, 1)), energy, 5), "cand", "audio_raw"))
    assert got[0] == pytest.approx(0.07) and got[0] < got[1] <= 1 and got[2] == 0
    assert rows(intervals.window_score(clips(spark, (0, 2, 1)), energy.filter("video = 2"), 5), "audio_raw") == [(None,)]


def test_peaks_and_pauses(spark, points, segments, energy):
    first = sequence.peak_windows(points).orderBy("nth").first()
    assert (first.start, first.end, first.value) == (20.0, 40.0, 1.0)
    assert rows(sequence.pauses(segments, 0.4), "t") == [(2.5,)]
    b = [t for (t,) in rows(sequence.boundaries(segments, sequence.peak_windows(points, 8), energy.filter("is_spike")), "t")]
    assert {20.0, 3.0, 6.0} <= set(b)


def test_snap(spark, segments):
    assert rows(intervals.snap(clips(spark, (2.2, 7.8, 1)), segments), "start", "end") == [(0.0, pytest.approx(8.3))]
    once = intervals.snap(clips(spark, (4, 4.5, 1)), segments)
    assert rows(once, "end") == [(pytest.approx(5.3),)]
    assert rows(intervals.snap(once, segments), "end") == [(pytest.approx(8.3),)]
    overlapping = spark.createDataFrame([(1, 0, 0.0, 9.0), (1, 1, 1.0, 6.0)], "video int, seg int, start double, end double")
    assert rows(intervals.snap(clips(spark, (0, 5, 1)), overlapping), "end") == [(pytest.approx(6.3),)]


def test_excerpt_and_peak(spark, segments, points, energy):
    assert rows(intervals.excerpt(clips(spark, (2, 8, 1)), segments, 5), "excerpt") == [("I made a mistake. It was a secret.",)]
    c = clips(spark, (22, 28, 1), (2, 4, 1), (60, 70, 1))
    assert rows(intervals.overlapping_peak(c, sequence.peak_windows(points, 10), energy.filter("is_spike"), 10), "cand", "peak") == [(0, 20.0), (1, 3.0), (2, None)]


def test_average_rank(spark):
    df = spark.createDataFrame([(1, v) for v in (10, 20, 20, 5)] + [(2, 7)], "video int, v int")
    got = rows(df.withColumn("r", sequence.average_rank("v", ["video"])), "video", "v", "r")
    assert got == [(1, 5, 0.0), (1, 10, pytest.approx(1 / 3)), (1, 20, pytest.approx(2.5 / 3)), (1, 20, pytest.approx(2.5 / 3)), (2, 7, 1.0)]


def test_fuse(spark):
    c = clips(spark, (0, 10, 50), (20, 30, 90), (40, 50, 30))
    bare = c.withColumns({f"{k}_raw": F.lit(None).cast("double") for k in ("replay", "audio", "chapter")})
    f = fusion.fuse(bare).orderBy("nth").collect()
    assert [r.cand for r in f] == [1, 0, 2] and [r.score for r in f] == [100, 50, 0]
    assert f[0].weight_llm == 1.0 and f[0].weight_replay is None and f[0].signals_present == ["llm"]
    some = bare.withColumn("replay_raw", F.when(F.col("cand") == 2, 5.0))
    f = fusion.fuse(some).orderBy("cand").collect()
    assert f[0].weight_llm == pytest.approx(0.45 / 0.7) and f[0].norm_replay == 0.25


def test_least_score_keeps_the_best(spark):
    c = clips(spark, (0, 1, 10), (2, 3, 30), (4, 5, 30))
    assert rows(fusion.at_least(c, 50), "cand") == [(1,)]
    assert rows(fusion.at_least(c, 20), "cand") == [(1,), (2,)]
    assert rows(fusion.at_least(c, 50, False), "cand") == []


def greedy(items):
    kept = []
    for s, e, score, k in sorted(((s, e, sc, k) for k, (s, e, sc) in enumerate(items)), key=lambda x: (-x[2], x[3])):
        if not any(min(e, f) - max(s, a) > 0.5 * (e - s) for a, f, _ in kept):
            kept.append((s, e, k))
    return sorted(k for _, _, k in kept)


def test_suppress_by_time(spark):
    assert rows(suppress.by_time(clips(spark, (0, 60, 90), (40, 100, 70), (10, 50, 60))), "cand") == [(0,), (1,)]
    rnd = random.Random(5)
    items = [((s := rnd.uniform(0, 100)), s + rnd.uniform(1, 40), rnd.randint(0, 5)) for _ in range(40)]
    assert [k for (k,) in rows(suppress.by_time(clips(spark, *items)), "cand")] == greedy(items)


def test_suppress_by_text(spark):
    df = spark.createDataFrame([(1, 0, 90, "the biggest mistake of my life today"), (1, 1, 70, "biggest mistake of my life today"), (1, 2, 60, "completely different words"), (1, 3, 5, "")], "video int, cand int, score int, t string")
    assert rows(suppress.by_text(df, "t"), "cand") == [(0,), (2,), (3,)]


def test_sponsors(spark):
    s = spark.createDataFrame([(1, 100.0, 200.0)], "video int, start double, end double")
    assert rows(intervals.drop_sponsored(clips(spark, (110, 190, 90), (180, 300, 80)), s, 60), "cand") == [(1,)]


EVEN = [(2.0 * k, 2.0 * k + 2) for k in range(150)]


def expanded(spark, items, segs):
    c = spark.createDataFrame([(1, k, float(s), float(e), p and float(p)) for k, (s, e, p) in enumerate(items)], "video int, cand int, start double, end double, peak double")
    seg = spark.createDataFrame([(1, k, float(s), float(e)) for k, (s, e) in enumerate(segs)], "video int, seg int, start double, end double")
    return {r.cand: (round(r.start, 6), round(r.end, 6), r.expanded) for r in expand.expand(c, seg, None, 50).collect()}


def test_expand_by_hand(spark):
    # lead 5 to 20 seconds, tail 5, pad 0.3, at most 180 long; sentences start at even seconds
    got = expanded(spark, [(50, 60, 58), (57, 60, 58), (10, 60, 58), (1, 4, 3), (50, 290, 58), (294, 299, 297), (50, 60, None)], EVEN)
    assert got == {
        0: (49.7, 66.3, True), 1: (51.7, 66.3, True), 2: (37.7, 66.3, True), 3: (0.0, 10.3, True), 4: (49.7, 229.7, True), 5: (291.7, 300.3, True), 6: (50.0, 60.0, False),
    }


def test_expand_keeps_its_bounds(spark):
    rnd = random.Random(9)
    items = [((s := rnd.uniform(0, 200)), s + rnd.uniform(1, 90), rnd.uniform(0, 290)) for _ in range(60)]
    p = DEFAULTS
    for k, (s, e, whole) in expanded(spark, items, EVEN).items():
        start, end, peak = items[k]
        assert whole and 0 <= s <= max(0.0, peak - p.peak_lead) - p.pad + 1e-6 or s == 0
        assert s >= max(0.0, max(0.0, peak - p.peak_lead_most) - p.pad) - 1e-6 and 1 <= e - s + 1e-6 <= p.longest_clip + 1e-5
        assert s == 0 or any(abs(s + p.pad - b) < 1e-5 for b, _ in EVEN) or abs(s + p.pad - max(0.0, peak - p.peak_lead)) < 1e-5 or abs(s + p.pad - max(0.0, peak - p.peak_lead_most)) < 1e-5
        assert e >= min(end + p.peak_tail, 300.0, s + p.longest_clip) - 1e-5 and e <= 300 + p.pad + 1e-5 or e - s <= 1 + 1e-5


def test_onset(spark, energy):
    p = spark.createDataFrame([(1, 0, 3.5, 0.0), (1, 1, 6.0, 6.0), (1, 2, 99.0, 0.0)], "video int, cand int, peak double, floor double")
    assert rows(intervals.onset(p, energy, 5), "cand", "onset") == [(0, 2.0), (1, 6.0), (2, 9.0)]


def test_chunks(spark):
    seg = spark.createDataFrame([(1, k, 30.0 * k, 30.0 * k + 2, "x") for k in range(80)], "video int, seg int, start double, end double, text string")
    got = chunks.chunk_segments(seg).collect()
    assert {r.offset for r in got} >= {0.0, 1140.0} and all(r.start >= 0 for r in got)
    assert [r.transcript for r in chunks.transcript_text(seg.filter("seg < 2"), ["video"]).collect()] == ["[0.0s] x\n[30.0s] x"]


def test_hints(spark, points, energy):
    w = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0), (1, 1, 900.0, 900.0, 999.0)], "video int, chunk int, offset double, lo double, hi double")
    c = spark.createDataFrame(CHAPTERS, "video int, ch int, start double, end double, title string")
    got = dict(rows(chunks.hints(w, sequence.peak_windows(points, 12), c, energy.filter("is_spike"), spark.createDataFrame([(1, 2.5)], "video int, t double")), "chunk", "hints"))
    assert got[1] == "" and "00:20-00:40" in got[0] and "00:15 My biggest mistake" in got[0] and "Loud moments: 00:03, 00:06" in got[0]


def test_answers(spark):
    good = '{"highlights": [{"title": "A", "start_time": 1, "end_time": 5, "score": 150}], "content_type": "talk", "density": "high"}'
    raws = [good, "```json\n" + good.replace("}]", "},]") + "\n```", 'noise {"title": "B", "start_time": 1, "end_time": 5, "score": 7} noise', good[:-40] + ', {"title": "cut', "nothing", None]
    df = spark.createDataFrame([(k, 0, r, 100.0) for k, r in enumerate(raws)], "video int, chunk int, raw string, duration double")
    got = rows(answers.candidates(df), "video", "title", "score", "content_type")
    assert got == [(0, "A", 100, "talk"), (1, "A", 100, "talk"), (2, "B", 7, "other"), (3, "A", 100, "other")]
    loose = spark.createDataFrame([("5", "1", "x"), ("-1", "9", "1"), ("90", "120", "9.9"), ("NaN", "5", "1"), (None, "5", "1"), ("100", "120", "1")], "start_time string, end_time string, score string")
    loose = loose.withColumns({c: F.lit(None).cast("string") for c in ("title", "hook_sentence", "virality_reason")}).withColumn("duration", F.lit(100.0))
    assert rows(answers.sanitise(loose), "start", "end", "score", "title") == [(90.0, 100.0, 9, "Untitled Highlight")]


def test_captions(spark):
    words = spark.createDataFrame([(1, k, float(k), k + 1.0, w) for k, w in enumerate(["a", "", "b", "c", "d"])], "video int, w int, start double, end double, word string")
    assert rows(captions.cues(words), "cue", "start", "end", "text") == [(1, 0.0, 4.0, "a b c"), (2, 4.0, 5.0, "d")]
    events = captions.dialogue(captions.karaoke(words)).orderBy("cue", "pos").collect()
    assert len(events) == 4 and events[0].line.startswith("Dialogue: 0,0:00:00.00,0:00:01.00,Default,,0,0,0,,{\\c")
    seg = spark.createDataFrame([(1, 0, 100.0, 103.0, "one"), (1, 1, 103.0, 106.0, "two"), (1, 2, 200.0, 205.0, "far")], "video int, seg int, start double, end double, text string")
    cue = captions.clip_cues(clips(spark, (100, 106, 1)), seg, 10)
    assert rows(cue, "cue", "start", "end") == [(1, 0.0, 3.0), (2, 3.0, 6.0)]
    assert captions.subtitle_text(cue).first().srt == "1\n00:00:00,000 --> 00:00:03,000\none\n\n2\n00:00:03,000 --> 00:00:06,000\ntwo\n"


def test_crop(spark):
    still = spark.createDataFrame([(1, 0.5 * k, 0.5) for k in range(120)], "video int, t double, cx double")
    moving = spark.createDataFrame([(2, 0.5 * k, 0.2 if k < 60 else 0.8) for k in range(120)], "video int, t double, cx double")
    ends = spark.createDataFrame([(1, 60.0), (2, 60.0)], "video int, duration double")
    got = rows(crop.crop_segments(still.unionByName(moving), ends), "video", "nth", "start", "end", "x")
    assert [g[:4] for g in got if g[0] == 1] == [(1, 0, 0.0, 60.0)] and abs(got[0][4] - 0.5) < 0.1
    assert len([g for g in got if g[0] == 2]) == 2
    w = one(spark, crop.crop_window(F.lit(1920), F.lit(1080), F.lit(0.0)))
    assert (w.x, w.y, w.w, w.h) == (0, 0, 607, 1080)
    assert one(spark, crop.crop_window(F.lit(1920), F.lit(1080), F.lit(1.0))).x == 1313
    assert one(spark, crop.crop_window(F.lit(1080), F.lit(1920), F.lit(0.5))).h == 1920
    m = spark.createDataFrame([(1, k, v) for k, v in enumerate([0.5, 0.8, 0.9, 0.1, 0.2])], "video int, k int, v double")
    assert rows(m.select("k", sequence.rolling_median("v", ["video"], "k").alias("m")), "k", "m")[3] == (3, 0.2)


def test_holdout(spark, points):
    picked = clips(spark, (20, 30, 1)).select("video", "cand", "start", "end")
    length = spark.createDataFrame([(1, 50.0)], "video int, duration double")
    base = evaluate.random_windows(picked, length)
    assert base.count() == 200 and base.filter("end > 50.001 or start < 0").count() == 0
    v = evaluate.verdict(evaluate.lift(picked, base, points, 10)).first()
    assert v.passed and v.wins == 1


def test_text(spark):
    assert one(spark, text.content_words(F.lit("The Cat's cat's hat, a mistake!"))) == ["cat's", "hat", "mistake"]
    assert one(spark, text.slug(F.lit("Hello, World!  Again"))) == "hello-world-again" and one(spark, text.slug(F.lit("!!"))) == "clip"
    assert one(spark, text.strip(F.lit("\t\n a b  "))) == "a b"
    assert one(spark, text.hashtags(F.lit("This great great talk about secret things"))) == "#great #talk #secret"
    assert one(spark, text.human_count(F.lit(1_500))) == "1.5K" and one(spark, text.score_band(F.lit(60))) == "warn"
    assert one(spark, text.is_transient(F.lit("HTTP 429"))) and not one(spark, text.is_transient(F.lit(None).cast("string")))
    got = one(spark, text.weight_map(F.lit("llm:0.5, bad, replay:x, audio:0.1"), DEFAULTS.weights))
    assert got == {"llm": 0.5, "replay": 0.25, "audio": 0.1, "chapter": 0.1}
    assert one(spark, text.to_int(F.lit("-7.9"), 0)) == -7 and one(spark, text.to_double(F.lit("x"), -1)) == -1.0


def test_times(spark):
    for s, want in ((0, "00:00"), (61.9, "01:01"), (3661, "01:01:01"), (-5, "00:00")):
        assert one(spark, timefmt.hms(F.lit(float(s)))) == want
    assert one(spark, timefmt.srt_time(F.lit(3661.0025))) == "01:01:01,002"
    assert one(spark, timefmt.parse_srt_time(F.lit("01:01:01,500"))) == 3661.5 and one(spark, timefmt.parse_srt_time(F.lit("1:01:01.5"))) is None
    assert one(spark, timefmt.ass_time(F.lit(59.999))) == "0:00:59.100"
    assert one(spark, timefmt.hms_tenths(F.lit(59.97))) == "00:00:60.0" and one(spark, timefmt.minutes(F.lit(125.0))) == "2:05"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.youtube.com/watch?v=abc123&t=5", "abc123"), ("youtube.com/watch?t=1&v=abc%20d", "abc d"), ("https://youtu.be/xyz?si=1", "xyz"), ("https://m.youtube.com/shorts/s1?x", "s1"),
        ("https://youtube.com/embed/e1", "e1"), ("https://youtube.com/live/l1#t", "l1"), ("https://example.com/watch?v=abc", None), ("https://youtube.com/watch", None), ("", None),
    ],
)
def test_long_video_id(spark, url, want):
    assert one(spark, urls.long_video_id(F.lit(url))) == want


def test_short_video_id(spark):
    assert one(spark, urls.short_video_id(F.lit("https://www.tiktok.com/@a.b/video/123?x"))) == "123"
    assert one(spark, urls.short_video_id(F.lit("https://vm.tiktok.com/abc"))) is None
    assert one(spark, urls.shown_title(F.lit("TikTok video #12"), F.lit("chan"), F.lit("1"))) == "@chan TikTok video"


def test_sources(spark, tmp_path):
    srt = "﻿1\n00:00:00,000 --> 00:00:02,000\nHello\n\n2\n00:00:02,500 --> 00:00:05,000\nTwo\nlines\n\n00:00:05,000 --> 00:00:08,000\nThree\n"
    (tmp_path / "a.srt").write_text(srt)
    (tmp_path / "b.srt").write_text(srt.replace("00:00:02,500", "00:00:02.500"))
    (tmp_path / "c.srt").write_text("")
    got = rows(tables.subtitles(spark, str(tmp_path / "*.srt")), "seg", "start", "end", "text")
    assert got == [(0, 0.0, 2.0, "Hello"), (1, 2.5, 5.0, "Two\nlines"), (2, 5.0, 8.0, "Three")]
    (tmp_path / "urls.txt").write_text("# no\n\n  http://a  \nhttp://b\n")
    assert rows(tables.url_list(spark, [str(tmp_path / "urls.txt")]), "url") == [("http://a",), ("http://b",)]
    assert rows(tables.url_list(spark, ["missing.txt"]), "url") == [("missing.txt",)]
    (tmp_path / "m.json").write_text('{"video_id": "v", "duration": 9, "_has_signals": true, "heatmap": [{"start_time": 5, "end_time": 9, "value": 0.5}, {"start_time": 1, "end_time": 1, "value": 1}, {"start_time": "NaN", "end_time": 2, "value": 1}, {"start_time": 0, "end_time": 5, "value": "0.25"}, {"start_time": "x"}], "chapters": [{"start_time": 3, "title": " b "}, {"start_time": 0, "end_time": "y"}, {"title": "z"}]}\n')
    meta = tables.metadata(spark, str(tmp_path / "m.json"))
    assert rows(tables.replay_points(meta), "idx", "start", "end", "value") == [(0, 0.0, 5.0, 0.25), (1, 5.0, 9.0, 0.5)]
    assert rows(tables.chapter_rows(meta), "ch", "start", "title") == [(0, 0.0, ""), (1, 3.0, "b")]


def test_loudness(spark):
    x = [(1, i, 1000 if i < 4 else 500) for i in range(10)] + [(2, i, 5) for i in range(5)]
    got = rows(sequence.loudness(spark.createDataFrame(x, "video int, i long, x int"), 4), "video", "sec", "value")
    assert got == [(1, 0, 1.0), (1, 1, 0.5)]
