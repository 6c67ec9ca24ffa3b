"""What a review found at larger sizes, as small tables."""

import struct

from pyspark.sql import functions as F

from highmark.functions import timefmt
from highmark.operators import evaluate, fusion, sequence
from highmark.plans import ranking
from highmark.plans.queries import _round


def test_rounding_is_that_of_the_sql(spark):
    """270.7135155 times a million is a half in binary: DuckDB rounds up, decimals would go down."""
    xs = [974568.655800 / 3600, 1446199.527 / 3600, -2.5, 0.1234565, float("inf")]
    xs += [k / 3600 + 1e-6 * n / 7 for k in range(40) for n in range(40)]
    import duckdb

    c = duckdb.connect()
    want = [c.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in xs]
    half = [x for x in (n / 1e6 + 5e-7 for n in range(270_000_000, 270_003_000)) if x * 1e6 % 1 == 0.5]
    want += [c.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in half[:300]]
    df = spark.createDataFrame(list(enumerate(xs + half[:300])), "k int, x double")
    assert [r.x for r in _round(df, "x").orderBy("k").collect()] == want


def test_tenths_round_the_number_itself(spark):
    xs = [n / 20 for n in range(0, 1300)] + [0.05, 0.15, 0.25, 0.35, 59.95, 59.75, 7.0, 12.449999999999999]
    df = spark.createDataFrame(list(enumerate(xs)), "k int, x double").select("k", timefmt.hms_tenths(F.col("x")).alias("t"))
    assert [r.t for r in df.orderBy("k").collect()] == ["%02d:%02d:%04.1f" % (x // 3600, x % 3600 // 60, x % 60) for x in xs]


def test_sound_of_wide_samples(spark):
    loud, low = [40_000, -40_000, 70_000, 0], [300, -300, 300, 5]
    blocks = [(1, 0, struct.pack("<4i", *loud) + b"\x01\x02\x03", 32), (1, 4, struct.pack("<4h", *low) + b"\x01", 16)]
    got = sequence.loudness_of_blocks(spark.createDataFrame(blocks, "video int, first long, pcm binary, bits int"), 4)
    rms = [(sum(x * x for x in xs) / 4) ** 0.5 for xs in (loud, low)]
    assert sorted((r.sec, round(r.value, 12)) for r in got.collect()) == [(0, 1.0), (1, round(rms[1] / rms[0], 12))]


def test_equal_sums_share_their_rank(spark):
    """0.1 + 0.2 is 0.3, though not as doubles."""
    rows = [("a", 1, 10, 0.1 + 0.2, 0.7 * ((0.1 + 0.2 + 0.3) / 3)), ("a", 2, 10, 0.3, 0.7 * ((0.3 + 0.2 + 0.1) / 3)), ("a", 3, 10, 0.5, 0.5)]
    clips = spark.createDataFrame(rows, "video string, cand int, score int, replay_raw double, audio_raw double").withColumn("chapter_raw", F.lit(None).cast("double"))
    got = {r.cand: (r.norm_replay, r.norm_audio) for r in fusion.fuse(ranking.steady(clips)).collect()}
    assert got == {1: (0.25, 0.25), 2: (0.25, 0.25), 3: (1.0, 1.0)}


def test_ranks_sort_once(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id % 13 AS v").withColumn("r", sequence.average_rank("v", ["k"]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 1


def test_random_windows_are_not_shuffled(spark):
    """Windows are made after the last exchange but those by video of the inputs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = spark.range(2000).selectExpr("id % 5 AS video", "double(id * 3) AS start", "double(id * 3 + 20) AS end", "double(id % 11) AS value").repartition(3, "video")
        picked = spark.createDataFrame([(v, c, 10.0 * c, 10.0 * c + 60) for v in range(5) for c in (1, 2)], "video long, cand int, start double, end double").repartition(3, "video")
        lengths = points.groupBy("video").agg(F.max("end").alias("duration"))
        base = evaluate.random_baseline(picked, lengths, points, 60.0, trials=20)
        assert "hashpartitioning(video" in (plan := base._jdf.queryExecution().executedPlan().toString()) and "cand#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
        got = {r.video: r.baseline for r in base.collect()}
        from highmark.operators.intervals import overlap_mean

        want = overlap_mean(evaluate.random_windows(picked, lengths, 20), points, 60.0, "v").groupBy("video").agg(F.avg("v").alias("v")).collect()
        assert {k: round(x, 9) for k, x in got.items()} == {r.video: round(r.v, 9) for r in want}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_queries_of_top_k_are_not_broadcast(spark, tmp_path):
    """What goes to all groups doesn't pass the driver."""
    import numpy as np

    from highmark.llm import topk

    vs = np.random.default_rng(1).standard_normal((400, 8)).tolist()
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    joins = []
    plans = lambda out: joins.append(out._jdf.queryExecution().executedPlan().toString())
    keep = topk.stored

    def noting(rows, name, *more):  # noqa: ANN001, ANN202
        plans(rows)
        return keep(rows, name, *more)

    topk.stored = noting
    try:
        got = topk.top_k(df, df.filter("vec_id % 100 = 0"), k=3, spread=4).collect()
    finally:
        topk.stored = keep
    assert len(got) == 12 and len(joins) == 1
    met = joins[0].split("SortMergeJoin")
    assert len(met) > 1 and "group" in met[1].splitlines()[0]


def test_alike_sets_meet_in_slots(spark):
    """Sets are shuffled, not their words one by one, and each pair is found once, whatever the slots."""
    import random

    from highmark.operators import suppress

    draw, bank = random.Random(3), [f"w{k}" for k in range(60)]
    sets = {(v, c): draw.sample(bank[: draw.choice([8, 15, 60])], draw.choice([1, 2, 5, 7, 8])) for v in (None, "a") for c in range(150)}
    sets |= {("b", c): sorted({bank[(c // 9 + k) % 60] for k in range(40)} - {bank[c % 60]}) for c in range(70)}
    df = spark.createDataFrame([((v,), (-(c % 7), c), c, w) for (v, c), w in sets.items()], "v struct<video: string>, o struct<s: int, cand: int>, cand int, words array<string>")
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = sorted((str(v), a, b) for v, a in sets for w, b in sets if v == w and (-(a % 7), a) < (-(b % 7), b) and alike(sets[v, a], sets[w, b]) > 0.6)
    for a_slot in (30, 200, 10**6):
        out = suppress.alike(df, 0.6, a_slot)
        assert sorted((str(r.v.video), r.a, r.b) for r in out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(words" not in plan and len(want) > 300


def test_packed_sidecars(spark, tmp_path):
    """Sidecars of many recordings share files, and read as those of one file each."""
    from highmark.sources import tables

    points = spark.range(600).selectExpr("id % 60 AS video", "int(id) AS idx", "double(id) AS start", "double(id + 2) AS end", "id / 7 AS value")
    videos = points.groupBy("video").agg(F.collect_list(F.struct(*[F.col(c).cast("string").alias(n) for c, n in (("start", "start_time"), ("end", "end_time"), ("value", "value"))])).alias("heatmap"))
    videos = videos.select(F.col("video").cast("string").alias("video_id"), F.lit('a\tb\n"c"\r').alias("title"), F.lit(None).cast("double").alias("duration"), "heatmap", F.array(F.struct(F.lit("0").alias("start_time"), F.lit(None).cast("string").alias("end_time"), F.lit("\tx\n y").alias("title"))).alias("chapters"))
    energy = points.selectExpr("video", "bigint(idx) AS sec", "value % 1 AS value")
    forms = {
        "meta": (lambda f, p: tables.write_metadata(videos, f, packed=p), lambda f, p: tables.metadata(spark, f, packed=p)),
        "bare": (lambda f, p: tables.write_metadata(videos, f, with_signals=False, packed=p), lambda f, p: tables.metadata(spark, f, packed=p)),
        "replay": (lambda f, p: tables.write_replay(points, f, packed=p), lambda f, p: tables.replay_files(spark, f, packed=p)),
        "loudness": (lambda f, p: tables.write_loudness(energy, f, packed=p), lambda f, p: tables.loudness_files(spark, f, packed=p)),
    }
    for name, (write, read) in forms.items():
        got = []
        for packed in (True, False):
            write(folder := f"{tmp_path}/{name}{packed}", packed)
            got.append(sorted(map(repr, read(folder, packed).collect())))
        assert got[0] == got[1] and len(got[0]) == 60
        assert len(list((tmp_path / f"{name}True").glob("**/*.txt"))) <= 8


def test_sidecar_queries_make_few_files(spark, sf):
    """As many files as tasks, not as recordings."""
    from highmark.plans import queries as plans
    from highmark.plans import reader_queries, run_queries  # noqa: F401
    from highmark.sources import tables

    made, write = [], tables._write_files
    tables._write_files = lambda rows, folder, packed=False: made.append(packed) or write(rows, folder, packed)
    try:
        for name in ("q41_replay_sidecars", "q42_chapter_sidecars", "q45_loudness_sidecars", "q64_replay_files"):
            assert plans.QUERIES[name](spark, sf).count() > 0
    finally:
        tables._write_files = write
    assert made == [True] * 6


def test_ranking_passes_narrow_clips(spark, sf):
    """Events are ordered once for points and once for loudness; titles, texts and weights wait until clips are ranked."""
    from highmark import storage
    from highmark.plans import queries as plans

    read, passed, keep = [], {}, storage.stored

    def noting(rows, name, *more, **named):  # noqa: ANN001, ANN202
        if "events.parquet" in rows._jdf.queryExecution().optimizedPlan().toString() or any("events.parquet" in f for f in rows.inputFiles()):
            read.append(name)
        passed[name] = rows.columns
        return keep(rows, name, *more, **named)

    storage.stored = noting
    try:
        assert plans.QUERIES["q37_documents"](spark, sf).count() > 0
    finally:
        storage.stored = keep
    assert len(read) == 2
    wide = {name.split("-", 1)[-1] for name, columns in passed.items() if {"title", "said", "fused"} & set(columns)}
    assert wide <= {"candidates", "chapters", "fused", "said"}


def test_ranked_clips_keep_their_columns(spark):
    """What waits meets the ranked clips again: by video, null or not, and by the candidate's own number."""
    from highmark.plans import ranking

    kinds = ["a secret story", "plain talk here", "other words entirely", "something else again"]
    rows = [(v, k, 60.0 * k, 60.0 * k + 50, (k * 7) % 10 * 10, f"t{v}{k}", f"more {v}{k}") for v in ("x", None) for k in range(4)]
    candidates = spark.createDataFrame(rows, "video string, cand int, start double, end double, score int, title string, note string")
    segments = spark.createDataFrame([(v, k, 30.0 * k, 30.0 * k + 20, kinds[k // 2]) for v in ("x", None) for k in range(8)], "video string, seg int, start double, end double, text string")
    points = segments.selectExpr("video", "seg AS idx", "start", "end", "seg / 8.0D AS value")
    energy = spark.createDataFrame([(v, k, (k % 50) / 50, k == 130) for v in ("x", None) for k in range(240)], "video string, sec bigint, value double, is_spike boolean")
    chapters = spark.createDataFrame([("x", 0, 0.0, 100.0, "plain"), ("x", 1, 100.0, None, "a secret")], "video string, ch int, start double, end double, title string")
    got = ranking.rank_clips(candidates, segments, points, chapters, energy, points.select("video", "start", "end").limit(0)).collect()
    assert {"excerpt", "peak", "expanded", "replay_raw", "audio_raw", "chapter_raw", "weight_llm", "norm_replay", "fused", "final_score", "llm_score", "signals_present", "cand", "score", "rank"} <= set(got[0].asDict())
    assert sorted((str(r.video), r.rank) for r in got) == [(v, k) for v in ("None", "x") for k in (1, 2, 3)]
    of = {r[5]: r for r in rows}
    assert all(r.note == f"more {r.title[1:]}" and r.video == of[r.title][0] and r.llm_score == of[r.title][4] for r in got)
    assert all((r.excerpt != "") == (r.video == "x") for r in got)


def test_signals_and_words_in_one(spark):
    """signals() gives what the three operators give, spoken() the words of the excerpt."""
    import random

    from highmark.functions.text import content_words
    from highmark.operators import intervals

    draw = random.Random(5)
    spans = lambda n, long: [(v, k, (s := draw.uniform(0, 300)), s + draw.uniform(1, long)) for v in "abc" for k in range(n)]
    clips = spark.createDataFrame(spans(25, 60), "video string, cand int, start double, end double")
    points = spark.createDataFrame([(*r, draw.random()) for r in spans(30, 9) if r[0] != "b"], "video string, idx int, start double, end double, value double")
    energy = spark.createDataFrame([(v, k, draw.random(), k % 7 == 0) for v in "ab" for k in range(0, 250, 2)], "video string, sec bigint, value double, is_spike boolean")
    chapters = spark.createDataFrame([(*r, draw.choice(["a secret", "plain"])) for r in spans(4, 90) if r[0] != "c"], "video string, ch int, start double, end double, title string")
    has = points.select("video").distinct().withColumn("has", F.lit(True))
    want = intervals.chapter_score(intervals.window_score(intervals.overlap_mean(clips, points, 40), energy, 40), chapters).join(has, "video", "left").withColumn("replay_raw", F.when(F.col("has"), F.col("replay_raw")))
    shown = lambda df: sorted((r.video, r.cand, *(x if x is None else round(x, 9) for x in (r.replay_raw, r.audio_raw, r.chapter_raw))) for r in df.collect())
    got = shown(intervals.signals(clips, points, energy, chapters, 40))
    assert got == shown(want) and {x[2] is None for x in got} == {x[3] is None for x in got} == {x[4] is None for x in got} == {True, False}
    texts = ["Same old story", " the same STORY\x1c", "", None, "I am", "don't, don't; ÉTÉ-9lives"]
    segments = spark.createDataFrame([(*r, draw.choice(texts)) for r in spans(12, 30) if r[0] != "c"], "video string, seg int, start double, end double, text string")
    words = lambda df, name: sorted((r.video, r.cand, sorted(r.w)) for r in df.select("video", "cand", content_words(F.col(name)).alias("w")).collect())
    assert words(intervals.spoken(clips, segments, 40), "said") == words(intervals.excerpt(clips, segments, 40), "excerpt")
