"""Queries over the driver's tables, and SQL for DuckDB that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from highmark.functions import text, timefmt, urls
from highmark.operators import answers, captions, chunks, crop, evaluate, expand, fusion, intervals, sequence, suppress
from highmark.plans import ranking, roles
from highmark.plans.roles import CHAPTERS, CLIPS, DAY, ENERGY, HOUR, POINTS, SENTENCES, TURNS, WORDS, table
from highmark.sources.tables import first_wins, unfinished
from highmark.storage import Scratch

WEEK = 7 * DAY
INTEREST = "error|purchase"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(%s), '[a-z0-9'']+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"
_JACCARD = "CASE WHEN len(%(a)s) > 0 AND len(%(b)s) > 0 THEN len(list_intersect(%(a)s, %(b)s))::DOUBLE / (len(%(a)s) + len(%(b)s) - len(list_intersect(%(a)s, %(b)s))) ELSE 0 END"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Rounded as DuckDB does it: the number times a power of ten, as a double, to the nearest whole one, halves away from 0. Spark's round(c, places) takes decimals instead."""
    return df.select(*[(F.round(F.col(c) * 10.0**places) / 10.0**places).alias(c) if c in names else F.col(c) for c in df.columns])


#: The mean value of points in each clip, by covered time.
_MEANS = """
means AS (SELECT c.video, c.cand, coalesce(sum(p.value * (least(c.f, p.f) - greatest(c.s, p.s))) / sum(least(c.f, p.f) - greatest(c.s, p.s)), 0) AS replay_raw
  FROM clips c LEFT JOIN points p ON p.video = c.video AND p.f > c.s AND p.s < c.f GROUP BY ALL)"""
_RANK = "CASE WHEN count(*) OVER (PARTITION BY {k}) = 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY {k} ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0) / (count(*) OVER (PARTITION BY {k}) - 1) END"


@query(
    f"""WITH {POINTS}, {CLIPS}, {_MEANS},
n AS (SELECT video, cand, s, f, 0.45 / 0.7 * {_RANK.format(k="video", v="score")} + 0.25 / 0.7 * {_RANK.format(k="video", v="replay_raw")} AS fused FROM clips JOIN means USING (video, cand)),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY round_even(round(fused * 100, 9), 0) DESC, cand) AS rank FROM n)
SELECT video, rank::INTEGER AS rank, cand, s AS start, f AS "end", round_even(round(fused * 100, 9), 0)::INTEGER AS score FROM r WHERE rank <= 3"""
)
def q01_fused_top_windows(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    c = intervals.overlap_mean(roles.clips(p), p, 2 * DAY).withColumn("replay_raw", F.round("replay_raw", 9)).withColumn("audio_raw", F.lit(None).cast("double")).withColumn("chapter_raw", F.lit(None).cast("double"))
    return sequence.top_n(fusion.fuse(c), ["video"], [F.col("score").desc(), "cand"], 3).select("video", "rank", "cand", "start", "end", "score")


@query(f"WITH {POINTS}, {CLIPS}, {_MEANS} SELECT video, cand, round(replay_raw, 6) AS replay_raw FROM means")
def q02_overlap_mean(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    return _round(intervals.overlap_mean(roles.clips(p), p, 2 * DAY).select("video", "cand", "replay_raw"), "replay_raw")


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, {_RANK.format(k='l_orderkey', v='l_extendedprice')} AS norm FROM lineitem")
def q03_average_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.withColumn("norm", sequence.average_rank("l_extendedprice", ["l_orderkey"]))


_PEAKS = """
high AS (SELECT *, max(value) OVER (PARTITION BY video) AS most FROM points),
flagged AS (SELECT *, CASE WHEN s <= lag(f) OVER (PARTITION BY video ORDER BY idx) + 1e-6 THEN 0 ELSE 1 END AS new FROM high WHERE most > 0 AND value >= 0.6 * most),
islands AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY idx) AS island FROM flagged),
all_peaks AS (SELECT video, island, arg_min(s, idx) AS s, arg_max(f, idx) AS f, max(value) AS value FROM islands GROUP BY 1, 2),
peaks AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY value DESC, island)::INTEGER AS nth FROM all_peaks)"""


@query(f'WITH {POINTS}, {_PEAKS} SELECT video, nth, s AS start, f AS "end", value FROM peaks WHERE nth <= 5')
def q04_peak_windows(spark: SparkSession, d: str) -> DataFrame:
    return sequence.peak_windows(roles.points(spark, d))


@query(f"WITH {POINTS}, {SENTENCES} SELECT video, s AS t FROM (SELECT *, lag(f) OVER (PARTITION BY video ORDER BY seg) AS before FROM sentences) WHERE s - before >= 43200")
def q05_pauses(spark: SparkSession, d: str) -> DataFrame:
    return sequence.pauses(roles.sentences(roles.points(spark, d)), 43_200)


def _snapped(clips: str, name: str, pad: str = "0.3", of: str = "sentences") -> str:
    return f"""
{name}_near AS (SELECT c.video, c.cand, max(g.s) FILTER (g.s <= c.s + 0.05) AS b, arg_min(g.f, g.seg) FILTER (g.f >= c.f - 0.05) AS a FROM {clips} c JOIN {of} g USING (video) GROUP BY ALL),
{name}_edge AS (SELECT video, arg_min(s, seg) AS first, arg_max(f, seg) AS last FROM {of} GROUP BY 1),
{name}_to AS (SELECT c.*, greatest(coalesce(b, first) - {pad}, 0) AS b2, coalesce(a, last) + {pad} AS a2, last FROM {clips} c LEFT JOIN {name}_near USING (video, cand) LEFT JOIN {name}_edge USING (video)),
{name} AS (SELECT * EXCLUDE (b2, a2, last) REPLACE (CASE WHEN a2 > b2 THEN b2 ELSE s END AS s, CASE WHEN a2 > b2 THEN least(a2, last + {pad}) ELSE f END AS f) FROM {name}_to)"""


@query(f'WITH {POINTS}, {CLIPS}, {SENTENCES}, {_snapped("clips", "once")}, {_snapped("once", "twice")} SELECT video, cand, round(s, 6) AS start, round(f, 6) AS "end" FROM twice')
def q06_snap_twice(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    s = roles.sentences(p)
    return _round(intervals.snap(intervals.snap(roles.clips(p), s), s).select("video", "cand", "start", "end"), "start", "end")


_ONSET = """
tops AS (SELECT video, nth AS cand, s / 3600 AS peak, greatest(s / 3600 - 20, 0) AS floor_ FROM peaks WHERE nth <= 5),
stats AS (SELECT video, avg(value) AS m, max(sec) + 1 AS n FROM loud GROUP BY 1),
walk AS (SELECT *, least(n - 1, floor(peak)) AS i, greatest(floor(floor_), 0) AS lo FROM tops JOIN stats USING (video)),
onsets AS (SELECT w.video, w.cand, w.peak, CASE WHEN i <= lo THEN i ELSE coalesce(max(l.sec), lo) END::DOUBLE AS onset
  FROM walk w LEFT JOIN loud l ON l.video = w.video AND l.sec BETWEEN w.lo AND w.i AND l.value <= w.m GROUP BY w.video, w.cand, w.peak, i, lo)"""


@query(f"WITH {POINTS}, {ENERGY}, {_PEAKS}, {_ONSET} SELECT video, cand, round(peak, 6) AS peak, onset FROM onsets")
def q07_onset(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    tops = sequence.peak_windows(p).select("video", F.col("nth").alias("cand"), (F.col("start") / HOUR).alias("peak")).withColumn("floor", F.greatest(F.col("peak") - 20, F.lit(0.0)))
    return _round(intervals.onset(tops, sequence.loud_and_quiet(roles.energy(p)), 24).select("video", "cand", "peak", "onset"), "peak")


_STRONGEST = """
strong AS (SELECT c.video, c.cand, arg_max(p.s, p.value * 1e6 - p.s / 1e6) AS peak FROM clips c JOIN peaks p ON p.video = c.video AND p.nth <= 10 AND p.s < c.f AND p.f > c.s GROUP BY 1, 2),
first_spike AS (SELECT c.video, c.cand, min(l.sec * 3600.0) AS spike FROM clips c JOIN loud l ON l.video = c.video AND l.is_spike AND l.sec * 3600 BETWEEN c.s AND c.f GROUP BY 1, 2),
clip_peaks AS (SELECT c.*, coalesce(peak, spike) AS peak FROM clips c LEFT JOIN strong USING (video, cand) LEFT JOIN first_spike USING (video, cand))"""


def _spikes(p: DataFrame) -> DataFrame:
    return sequence.loud_and_quiet(roles.energy(p)).filter("is_spike").select("video", (F.col("sec") * 3600).alias("sec"))


@query(f"WITH {POINTS}, {CLIPS}, {ENERGY}, {_PEAKS}, {_STRONGEST} SELECT video, cand, peak FROM clip_peaks")
def q08_overlapping_peak(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    return intervals.overlapping_peak(roles.clips(p), sequence.peak_windows(p, 10), _spikes(p), 2 * DAY).select("video", "cand", "peak")


_CHAPTER = f"""
held AS (SELECT c.video, c.cand, arg_min(h.title, h.ch) AS title FROM clips c JOIN chapters h ON h.video = c.video AND h.s <= (c.s + c.f) / 2 AND ((c.s + c.f) / 2 < h.f OR h.f IS NULL) GROUP BY 1, 2),
chapter_scores AS (SELECT c.video, c.cand, CASE WHEN c.video IN (SELECT video FROM chapters) THEN CASE WHEN regexp_matches(coalesce(held.title, ''), '(?i){INTEREST}') THEN 1.0 ELSE 0.5 END END::DOUBLE AS chapter_raw FROM clips c LEFT JOIN held USING (video, cand))"""


@query(f"WITH {POINTS}, {CLIPS}, {CHAPTERS}, {_CHAPTER} SELECT * FROM chapter_scores")
def q09_chapter_score(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    return intervals.chapter_score(roles.clips(p), roles.chapters(p), INTEREST).select("video", "cand", "chapter_raw")


_AUDIO = """
scored AS (SELECT c.video, c.cand, least(1.0, 0.7 * avg(l.value) + 0.3 * least(count(*) FILTER (l.is_spike) / 3.0, 1.0)) AS a FROM clips c
  JOIN loud l ON l.video = c.video AND l.sec BETWEEN floor(c.s / 3600) AND floor(c.f / 3600) GROUP BY 1, 2),
audio AS (SELECT c.video, c.cand, coalesce(a, 0) AS audio_raw FROM clips c LEFT JOIN scored USING (video, cand))"""


@query(f"WITH {POINTS}, {CLIPS}, {ENERGY}, {_AUDIO} SELECT video, cand, round(audio_raw, 9) AS audio_raw FROM audio")
def q10_window_score(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    return _round(intervals.window_score(roles.in_hours(roles.clips(p)), sequence.loud_and_quiet(roles.energy(p)), 48).select("video", "cand", "audio_raw"), "audio_raw", places=9)


@query(f"WITH {POINTS}, {ENERGY} SELECT video, sec, value, is_spike, is_pause FROM loud")
def q11_loud_and_quiet(spark: SparkSession, d: str) -> DataFrame:
    return sequence.loud_and_quiet(roles.energy(roles.points(spark, d)))


@query(
    f"""WITH {POINTS},
ends AS (SELECT video, arg_max(f, idx) AS d FROM points GROUP BY 1),
clips AS (SELECT video, k::INTEGER AS cand, d * k / 40 AS s, d * (k + 1) / 40 AS f FROM ends, (SELECT unnest(range(0, 40)) AS k) WHERE d > 0), {_MEANS},
top AS (SELECT *, coalesce(nullif(max(replay_raw) OVER (PARTITION BY video), 0), 1) AS most FROM means)
SELECT video, string_agg(substr('▁▂▃▄▅▆▇█', least(8, floor(replay_raw / most * 7)::INTEGER + 1), 1), '' ORDER BY cand) AS line FROM top GROUP BY video"""
)
def q12_curve(spark: SparkSession, d: str) -> DataFrame:
    return sequence.curve(roles.points(spark, d), DAY)


_GREEDY = """
RECURSIVE {base},
o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, cand) AS n FROM clips),
step AS (
  SELECT video, 0::BIGINT AS n, []::STRUCT(cand INTEGER, s DOUBLE, f DOUBLE)[] AS kept FROM (SELECT DISTINCT video FROM clips)
  UNION ALL
  SELECT step.video, o.n, CASE WHEN len(list_filter(step.kept, lambda k: least(k.f, o.f) - greatest(k.s, o.s) > 0.5 * (o.f - o.s))) > 0 THEN step.kept
    ELSE list_append(step.kept, {{'cand': o.cand, 's': o.s, 'f': o.f}}) END FROM step JOIN o ON o.video = step.video AND o.n = step.n + 1),
done AS (SELECT video, unnest(arg_max(kept, n)) AS k FROM step GROUP BY video)"""


@query("WITH " + _GREEDY.format(base=f"{POINTS}, short_{CLIPS.strip()}, clips AS (SELECT * REPLACE (f + 86400 AS f) FROM short_clips)").strip() + ' SELECT video, k.cand AS cand, k.s AS start, k.f AS "end" FROM done')
def q13_suppress_by_time(spark: SparkSession, d: str) -> DataFrame:
    three_days = roles.clips(roles.points(spark, d)).withColumn("end", F.col("end") + DAY)
    return suppress.by_time(three_days, width=2 * DAY).select("video", "cand", "start", "end")


@query(
    f"""WITH RECURSIVE o AS (SELECT source AS video, doc_id AS cand, {_WORDS % "text"} AS ws, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents),
step AS (
  SELECT video, 0::BIGINT AS n, []::STRUCT(cand BIGINT, ws VARCHAR[])[] AS kept FROM (SELECT DISTINCT video FROM o)
  UNION ALL
  SELECT step.video, o.n, CASE WHEN len(list_filter(step.kept, lambda k: {_JACCARD % {"a": "k.ws", "b": "o.ws"}} > 0.6)) > 0 THEN step.kept
    ELSE list_append(step.kept, {{'cand': o.cand, 'ws': o.ws}}) END FROM step JOIN o ON o.video = step.video AND o.n = step.n + 1),
done AS (SELECT video, unnest(arg_max(kept, n)) AS k FROM step GROUP BY video)
SELECT video, k.cand AS cand FROM done"""
)
def q14_suppress_by_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("video"), F.col("doc_id").alias("cand"), F.col("n_chars").alias("score"), "text")
    return suppress.by_text(docs, "text").select("video", "cand")


@query(f"WITH {TURNS}, t AS (SELECT video, seg, {_WORDS % 'text'} AS a, lead({_WORDS % 'text'}) OVER (PARTITION BY video ORDER BY seg) AS b FROM turns) SELECT video, seg, len(a)::INTEGER AS n_words, round({_JACCARD % {'a': 'a', 'b': 'b'}}, 6) AS sim FROM t WHERE b IS NOT NULL")
def q15_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = roles.turns(spark, d).withColumn("a", text.content_words(F.col("text")))
    t = t.withColumn("b", F.lead("a").over(Window.partitionBy("video").orderBy("seg"))).filter("b is not null")
    return t.select("video", "seg", F.size("a").alias("n_words"), F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("sim"))


_TOPICS = f"""
said AS (SELECT video, seg, s / 3600 AS s, f / 3600 AS f, text FROM sentences),
block_counts AS (SELECT video, greatest(floor(arg_max(f, seg) / 24) + 1, 1)::BIGINT AS n FROM said GROUP BY 1),
blocks AS (SELECT video, unnest(range(0, n)) AS b FROM block_counts),
block_words AS (SELECT video, least(n - 1, floor(s / 24)::BIGINT) AS b, unnest({_WORDS % "text"}) AS w FROM said JOIN block_counts USING (video)),
block_sets AS (SELECT video, b, list(DISTINCT w) AS ws FROM block_words GROUP BY 1, 2),
pairs AS (SELECT video, b, coalesce(ws, []) AS x, lead(coalesce(ws, [])) OVER (PARTITION BY video ORDER BY b) AS y FROM blocks LEFT JOIN block_sets USING (video, b)),
sims AS (SELECT video, b, {_JACCARD % {"a": "x", "b": "y"}} AS sim FROM pairs WHERE y IS NOT NULL),
lows AS (SELECT *, sim < lag(sim) OVER w AND sim < lead(sim) OVER w AS low FROM sims WINDOW w AS (PARTITION BY video ORDER BY b)),
topics AS (SELECT video, (b + 1) * 24.0::DOUBLE AS t FROM lows WHERE low)"""


@query(f"WITH {POINTS}, {SENTENCES}, {_TOPICS} SELECT * FROM topics")
def q16_topic_shifts(spark: SparkSession, d: str) -> DataFrame:
    return sequence.topic_shifts(roles.in_hours(roles.sentences(roles.points(spark, d))), 24.0)


@query(
    f"""WITH {TURNS}, ends AS (SELECT video, arg_max(f, seg) AS d FROM turns GROUP BY 1),
starts AS (SELECT video, d, unnest(range(0, greatest(ceil(d / 60), 0)::BIGINT)) AS chunk FROM ends),
members AS (SELECT c.video, c.chunk, c.chunk * 60.0::DOUBLE AS off, t.seg, t.s - c.chunk * 60 AS s, t.f - c.chunk * 60 AS f FROM starts c JOIN turns t ON t.video = c.video AND t.s >= c.chunk * 60 AND t.f <= least(c.chunk * 60 + 90, d) + 30)
SELECT video, chunk, off AS "offset", round(last(f ORDER BY seg) OVER (PARTITION BY video, chunk), 6) AS chunk_duration, seg, round(s, 6) AS start, round(f, 6) AS "end" FROM members"""
)
def q17_chunks(spark: SparkSession, d: str) -> DataFrame:
    p = fusion.DEFAULTS.__class__(chunk_seconds=90.0, chunk_overlap=30.0)
    return _round(chunks.chunk_segments(roles.turns(spark, d), p).drop("text"), "chunk_duration", "start", "end")


_R3 = """
r3 AS (SELECT d.source AS video, d.doc_id AS cand, least(100, coalesce(n_chars, 0) // 100)::INTEGER AS score, (n_chars / 1000.0)::DOUBLE AS replay_raw, l.quality::DOUBLE AS audio_raw,
  CASE WHEN l.toxic IS NOT NULL THEN CASE WHEN l.toxic = 0 THEN 1.0 ELSE 0.5 END END AS chapter_raw FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _r3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    chapter = F.when(F.col("toxic").isNotNull(), F.when(F.col("toxic") == 0, 1.0).otherwise(0.5))
    score = F.least(F.lit(100), F.floor(F.coalesce("n_chars", F.lit(0)) / 100)).cast("int")
    return rows.select(F.col("source").alias("video"), F.col("doc_id").alias("cand"), score.alias("score"), (F.col("n_chars") / 1000).alias("replay_raw"), F.col("quality").cast("double").alias("audio_raw"), chapter.alias("chapter_raw"))


@query(
    f"""WITH {_R3}, h AS (SELECT video, cand, 0.45 AS l, CASE WHEN replay_raw IS NOT NULL THEN 0.25 END AS r, CASE WHEN audio_raw IS NOT NULL THEN 0.2 END AS a, CASE WHEN chapter_raw IS NOT NULL THEN 0.1 END AS c FROM r3),
t AS (SELECT *, (l + coalesce(r, 0) + coalesce(a, 0) + coalesce(c, 0))::DOUBLE AS total FROM h)
SELECT video, cand, round(l / total, 6) AS llm, round(r / total, 6) AS replay, round(a / total, 6) AS audio, round(c / total, 6) AS chapter FROM t"""
)
def q18_active_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = _r3(spark, d)
    present = {"llm": F.lit(True), **{k: F.col(f"{k}_raw").isNotNull() for k in fusion.SIGNALS[1:]}}
    return rows.select("video", "cand", *[F.round(w, 6).alias(k) for k, w in fusion.active_weights(present).items()])


@query(
    f"""WITH {_R3}, h AS (SELECT *, max(replay_raw IS NOT NULL) OVER (PARTITION BY video) AS hr, max(audio_raw IS NOT NULL) OVER (PARTITION BY video) AS ha, max(chapter_raw IS NOT NULL) OVER (PARTITION BY video) AS hc FROM r3),
g AS (SELECT video, cand, score, coalesce(replay_raw, 0) AS r, coalesce(audio_raw, 0) AS a, coalesce(chapter_raw, 0) AS c, CASE WHEN hr THEN 0.25 ELSE 0 END AS wr, CASE WHEN ha THEN 0.2 ELSE 0 END AS wa, CASE WHEN hc THEN 0.1 ELSE 0 END AS wc FROM h),
n AS (SELECT video, cand, score AS llm_score, (0.45 * {_RANK.format(k="video", v="score")} + wr * {_RANK.format(k="video", v="r")} + wa * {_RANK.format(k="video", v="a")} + wc * {_RANK.format(k="video", v="c")})::DOUBLE / (0.45 + wr + wa + wc)::DOUBLE AS fused FROM g)
SELECT video, cand, llm_score, round_even(round(fused * 100, 9), 0)::INTEGER AS score, round(fused, 6) AS fused FROM n"""
)
def q19_fuse_four_signals(spark: SparkSession, d: str) -> DataFrame:
    return _round(fusion.fuse(_r3(spark, d)).select("video", "cand", "llm_score", "score", "fused"), "fused")


@query(
    f"""WITH {POINTS}, {CLIPS}, {ENERGY}, {_PEAKS}, {SENTENCES}, {_STRONGEST},
said AS (SELECT video, seg, s / 3600 AS s, f / 3600 AS f FROM sentences),
edge AS (SELECT video, arg_max(f, seg) AS last FROM said GROUP BY 1),
stats AS (SELECT video, avg(value) AS m, max(sec) + 1 AS n FROM loud GROUP BY 1),
h AS (SELECT video, cand, s / 3600 AS s, f / 3600 AS f, peak / 3600 AS peak FROM clip_peaks),
a AS (SELECT *, greatest(peak - 5, 0) AS target, greatest(peak - 20, 0) AS lo, least(n - 1, floor(peak)) AS i FROM h JOIN stats USING (video)),
walk AS (SELECT a.video, a.cand, CASE WHEN any_value(i) <= any_value(floor(lo)) THEN any_value(i) ELSE coalesce(max(l.sec), any_value(floor(lo))) END AS onset
  FROM a LEFT JOIN loud l ON l.video = a.video AND l.sec BETWEEN floor(lo) AND i AND l.value <= a.m WHERE peak IS NOT NULL GROUP BY 1, 2),
b AS (SELECT a.*, least(s, target, greatest(onset, lo)) AS new FROM a LEFT JOIN walk USING (video, cand)),
near AS (SELECT b.video, b.cand, max(g.s) FILTER (g.s BETWEEN lo AND target + 0.5 AND g.s <= new + 0.5) AS x, min(g.s) FILTER (g.s BETWEEN lo AND target + 0.5) AS y, arg_min(g.f, g.seg) FILTER (g.f >= b.f + 2 - 0.05) AS z
  FROM b JOIN said g USING (video) WHERE peak IS NOT NULL GROUP BY 1, 2),
c AS (SELECT b.*, last, greatest(greatest(lo, least(coalesce(x, y, new), target)) - 0.25, 0) AS ns, least(coalesce(z, b.f + 2) + 0.25, last + 0.25) AS ne FROM b LEFT JOIN near USING (video, cand) JOIN edge USING (video))
SELECT video, cand, round(CASE WHEN peak IS NULL THEN s ELSE ns END, 6) AS start, round(CASE WHEN peak IS NULL THEN f ELSE greatest(least(ne, ns + 48), ns + 1) END, 6) AS "end", peak IS NOT NULL AS expanded FROM c"""
)
def q20_expand(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    energy = sequence.loud_and_quiet(roles.energy(p))
    c = intervals.overlapping_peak(roles.in_hours(roles.clips(p)), roles.in_hours(sequence.peak_windows(p, 10)), energy.filter("is_spike"), 48)
    params = fusion.DEFAULTS.__class__(pad=0.25, peak_lead=5.0, peak_lead_most=20.0, peak_tail=2.0, longest_clip=48.0)
    return _round(expand.expand(c, roles.in_hours(roles.sentences(p)), energy, 24, params).select("video", "cand", "start", "end", "expanded"), "start", "end")


@query(
    f"""WITH {POINTS}, {CLIPS}, sponsors AS (SELECT video, s, f FROM points WHERE kind = 'error'),
o AS (SELECT c.video, c.cand, sum(least(c.f, x.f) - greatest(c.s, x.s)) AS covered FROM clips c JOIN sponsors x ON x.video = c.video AND x.f > c.s AND x.s < c.f GROUP BY 1, 2)
SELECT video, cand, s AS start, f AS "end" FROM clips LEFT JOIN o USING (video, cand) WHERE coalesce(covered / nullif(f - s, 0), 0) < 0.5"""
)
def q21_drop_sponsored(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    return intervals.drop_sponsored(roles.clips(p), p.filter("kind = 'error'"), 2 * DAY).select("video", "cand", "start", "end")


@query(f"WITH {_R3}, o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, cand) AS n, max(score >= 90) OVER (PARTITION BY video) AS reached FROM r3) SELECT video, cand, score FROM o WHERE score >= 90 OR (NOT reached AND n = 1)")
def q22_least_score(spark: SparkSession, d: str) -> DataFrame:
    return fusion.at_least(_r3(spark, d), 90).select("video", "cand", "score")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3")
def q23_top_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sequence.top_n(rows, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3)


_HALVES = "halves AS (SELECT video, unnest([0, 1]) AS cand, d FROM (SELECT video, max(f) AS d FROM turns GROUP BY 1)), spans AS (SELECT video, cand::INTEGER AS cand, d / 4 + cand * d / 4 AS s, d / 2 + cand * d / 4 AS f FROM halves)"


def _halves(t: DataFrame) -> DataFrame:
    ends = t.groupBy("video").agg(F.max("end").alias("d")).select("video", "d", F.explode(F.array(F.lit(0), F.lit(1))).alias("cand"))
    return ends.select("video", "cand", (F.col("d") / 4 + F.col("cand") * F.col("d") / 4).alias("start"), (F.col("d") / 2 + F.col("cand") * F.col("d") / 4).alias("end"))


@query(
    f"""WITH {TURNS}, {_HALVES}, x AS (SELECT h.video, h.cand, string_agg(trim(t.text, E' \\t\\n\\r'), ' ' ORDER BY t.seg) AS said FROM spans h JOIN turns t ON t.video = h.video AND t.f > h.s AND t.s < h.f WHERE trim(t.text, E' \\t\\n\\r') <> '' GROUP BY 1, 2)
SELECT video, cand, coalesce(said, '') AS excerpt FROM spans LEFT JOIN x USING (video, cand)"""
)
def q24_excerpt(spark: SparkSession, d: str) -> DataFrame:
    t = roles.turns(spark, d)
    return intervals.excerpt(_halves(t), t, 60).select("video", "cand", "excerpt")


@query(
    f"""WITH {POINTS}, {ENERGY}, {_PEAKS}, {SENTENCES}, {_TOPICS},
u AS (SELECT video, s / 3600 AS t FROM (SELECT *, lag(f) OVER (PARTITION BY video ORDER BY seg) AS before FROM sentences) WHERE s / 3600 - before / 3600 >= 1.0
  UNION SELECT video, s / 3600 FROM peaks WHERE nth <= 8 UNION SELECT video, sec::DOUBLE FROM loud WHERE is_spike UNION SELECT video, t FROM topics)
SELECT video, round(t, 6) AS t FROM u"""
)
def q25_boundaries(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    s = roles.in_hours(roles.sentences(p))
    peaks = roles.in_hours(sequence.peak_windows(p, 8))
    return _round(sequence.boundaries(s, peaks, sequence.loud_and_quiet(roles.energy(p)).filter("is_spike"), 24.0), "t")


@query(
    f"WITH {POINTS}, n AS (SELECT video, idx, list_sort(list(value) OVER (PARTITION BY video ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS near FROM points) SELECT video, idx, near[len(near) // 2 + 1] AS value FROM n"
)
def q26_rolling_median(spark: SparkSession, d: str) -> DataFrame:
    return roles.points(spark, d).select("video", "idx", sequence.rolling_median("value", ["video"], "idx").alias("value"))


@query(
    f"""WITH RECURSIVE {POINTS.strip()},
near AS (SELECT video, idx, s / 3600 AS t, list_sort(list(value / 500) OVER (PARTITION BY video ORDER BY s / 3600 ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS n FROM points),
b AS (SELECT video, t, least(11, greatest(0, round_even(n[len(n) // 2 + 1] * 12, 0)))::INTEGER AS bin FROM near),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, bin) AS i FROM b),
walk AS (
  SELECT video, i, t, bin, t AS at_t, bin AS at_bin, true AS cut FROM o WHERE i = 1
  UNION ALL SELECT o.video, o.i, o.t, o.bin, CASE WHEN o.bin <> at_bin AND o.t - at_t >= 12 THEN o.t ELSE at_t END, CASE WHEN o.bin <> at_bin AND o.t - at_t >= 12 THEN o.bin ELSE at_bin END, o.bin <> at_bin AND o.t - at_t >= 12
  FROM walk JOIN o ON o.video = walk.video AND o.i = walk.i + 1),
ends AS (SELECT video, max(f) / 3600 AS d FROM points GROUP BY 1),
g AS (SELECT video, t AS s, coalesce(lead(t) OVER (PARTITION BY video ORDER BY i), d) AS f, (bin + 0.5::DOUBLE) / 12 AS x, i FROM walk JOIN ends USING (video) WHERE cut),
j AS (SELECT *, coalesce(f - s < 12 AND abs(lag(x) OVER (PARTITION BY video ORDER BY i) - x) < 1.0::DOUBLE / 12, false) AS joins FROM g),
m AS (SELECT video, i, s, CASE WHEN lead(joins) OVER (PARTITION BY video ORDER BY i) THEN lead(f) OVER (PARTITION BY video ORDER BY i) ELSE f END AS f, x, joins FROM j)
SELECT video, (row_number() OVER (PARTITION BY video ORDER BY i) - 1)::INTEGER AS nth, s AS start, f AS "end", x FROM m WHERE NOT joins"""
)
def q27_crop_segments(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    faces = p.select("video", (F.col("start") / HOUR).alias("t"), (F.col("value") / 500).alias("cx"))
    ends = p.groupBy("video").agg((F.max("end") / HOUR).alias("duration"))
    return crop.crop_segments(faces, ends, shortest=12.0)


@query(
    f"""WITH {TURNS}, {WORDS}, n AS (SELECT *, (row_number() OVER (PARTITION BY video ORDER BY w) - 1) // 3 + 1 AS cue FROM words WHERE word <> '')
SELECT video, cue::INTEGER AS cue, round(arg_min(s, w), 6) AS start, round(arg_max(f, w), 6) AS "end", string_agg(word, ' ' ORDER BY w) AS text FROM n GROUP BY 1, 2"""
)
def q28_cues(spark: SparkSession, d: str) -> DataFrame:
    return _round(captions.cues(roles.words(roles.turns(spark, d))).drop("words"), "start", "end")


@query(
    f"""WITH {TURNS}, {WORDS}, n AS (SELECT *, (row_number() OVER (PARTITION BY video ORDER BY w) - 1) // 3 + 1 AS cue FROM words WHERE word <> ''),
c AS (SELECT video, cue, list(word ORDER BY w) AS ws, list(s ORDER BY w) AS ss, list(f ORDER BY w) AS fs FROM n GROUP BY 1, 2),
e AS (SELECT *, unnest(range(0, len(ws)))::INTEGER AS pos FROM c),
g AS (SELECT video, cue::INTEGER AS cue, pos, greatest(ss[pos + 1], ss[1]) AS s, least(CASE WHEN pos < len(ws) - 1 THEN fs[pos + 1] ELSE fs[-1] END, fs[-1]) AS f,
  array_to_string(list_transform(ws, lambda x, j: CASE WHEN j = pos + 1 THEN '{{\\c{captions.HIGHLIGHT}}}' || x || '{{\\c{captions.PLAIN}}}' ELSE x END), ' ') AS text FROM e)
SELECT video, cue, pos, round(s + 1e-9, 6) AS start, round(f + 1e-9, 6) AS "end", text FROM g WHERE f > s"""
)
def q29_karaoke(spark: SparkSession, d: str) -> DataFrame:
    events = captions.karaoke(roles.words(roles.turns(spark, d)))
    # the engines round halves differently, as one multiplies first: none is left
    return _round(events.withColumns({c: F.col(c) + 1e-9 for c in ("start", "end")}), "start", "end")


@query(
    f"""WITH {POINTS}, w AS (SELECT video, idx, floor(s)::BIGINT % 360000 AS n, CASE WHEN idx % 17 = 16 THEN 0.9990234375::DOUBLE ELSE (idx % 17)::DOUBLE / 16 END AS x FROM points),
r AS (SELECT *, round_even(x * 1000, 0)::BIGINT AS ms, round_even(x * 100, 0)::BIGINT AS cs FROM w)
SELECT video, idx, CASE WHEN n >= 3600 THEN printf('%02d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) ELSE printf('%02d:%02d', n // 60, n % 60) END AS hms,
  printf('%02d:%02d:%02d,%03d', n // 3600, n % 3600 // 60, n % 60, ms) AS srt, printf('%d:%02d:%02d.%02d', n // 3600, n % 3600 // 60, n % 60, cs) AS ass,
  printf('%d:%02d', n // 60, n % 60) AS minutes, n + ms / 1000.0::DOUBLE AS parsed, NULL::DOUBLE AS unparsed FROM r"""
)
def q30_time_formats(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("idx") % 17 == 16, F.lit(1023 / 1024)).otherwise((F.col("idx") % 17) / 16)  # halves of both roundings, and one that reads 100
    t = F.floor("start") % 360_000 + part
    rows = roles.points(spark, d).select("video", "idx", timefmt.hms(t).alias("hms"), timefmt.srt_time(t).alias("srt"), timefmt.ass_time(t).alias("ass"), timefmt.minutes(t).alias("minutes"))
    return rows.withColumn("parsed", timefmt.parse_srt_time(F.col("srt"))).withColumn("unparsed", timefmt.parse_srt_time(F.col("ass")))


@query(
    f"""WITH w AS (SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]{{4,}}'), lambda w: w NOT IN ({", ".join(f"'{w}'" for w in text.UNTAGGED)})) AS tags FROM part),
o AS (SELECT *, list_filter(tags, lambda w, i: list_position(tags, w) = i)[:4] AS first FROM w)
SELECT p_partkey, left(CASE WHEN slug = '' THEN 'clip' ELSE slug END, 60) AS slug, coalesce(array_to_string(list_transform(first, lambda w: '#' || w), ' '), '') AS hashtags FROM o"""
)
def q31_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.hashtags(F.col("p_name")).alias("hashtags"))


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN url ELSE 'https://' || url END AS url,
  regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '^[^?#]*\?(?:[^#]*&)??page=([^&#]+)', 1) AS page FROM pages"""
)
def q32_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.with_scheme(u).alias("url"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query_value(u, "page").alias("page"))


@query(
    """WITH k AS (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS n FROM events)
SELECT user_id AS video, event_id AS chunk, least(n, n % 7 * 20 + 10)::DOUBLE AS start, least(n + 30, n % 7 * 20 + 10)::DOUBLE AS "end", least(100, n)::INTEGER AS score, event_type AS title,
  CASE WHEN n % 3 = 2 THEN 'other' ELSE 'talk' END AS content_type FROM k WHERE n < n % 7 * 20 + 10"""
)
def q33_answers(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    item = F.format_string('{"title": "%s", "start_time": %d, "end_time": %d, "score": %d}', "event_type", n, n + 30, n)
    whole = F.concat(F.lit('{"highlights": ['), item, F.lit('], "content_type": "talk", "density": "high"}'))
    fenced = F.concat(F.lit("```json\n"), F.replace(whole, F.lit("}]"), F.lit("},]")), F.lit("\n```"))
    broken = F.concat(F.lit('{"highlights": ['), item, F.lit(', {"title": "cut'))
    raw = F.when(n % 3 == 0, whole).when(n % 3 == 1, fenced).otherwise(broken)
    rows = table(spark, d, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("chunk"), raw.alias("raw"), (n % 7 * 20.0 + 10).alias("duration")).filter("raw is not null")
    return answers.candidates(rows).select("video", "chunk", "start", "end", "score", "title", "content_type")


@query(r"SELECT page_id, host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages)) WHERE n = 1")
def q34_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return first_wins(table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host")), "host", ["page_id"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q35_unfinished(spark: SparkSession, d: str) -> DataFrame:
    return unfinished(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    f"""WITH {POINTS}, all_{CLIPS.strip()}, lengths AS (SELECT video, max(f) AS d FROM points GROUP BY 1),
picked AS (SELECT video, cand, s, f FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, cand) AS n FROM all_clips) WHERE n <= 3),
grid AS (SELECT video, cand * 10 + k AS cand, k * greatest(0.1, d - (f - s)) / 10 AS s, k * greatest(0.1, d - (f - s)) / 10 + (f - s) AS f FROM picked JOIN lengths USING (video), (SELECT unnest(range(0, 10)) AS k)),
windows AS (SELECT video, cand, s, f, true AS own FROM picked UNION ALL SELECT video, cand, s, f, false FROM grid),
v AS (SELECT c.video, c.cand, c.own, coalesce(sum(p.value * (least(c.f, p.f) - greatest(c.s, p.s))) / sum(least(c.f, p.f) - greatest(c.s, p.s)), 0) AS v FROM windows c LEFT JOIN points p ON p.video = c.video AND p.f > c.s AND p.s < c.f GROUP BY ALL),
m AS (SELECT video, avg(v) FILTER (own) AS picked, avg(v) FILTER (NOT own) AS baseline FROM v GROUP BY 1)
SELECT video, round(picked, 6) AS picked, round(baseline, 6) AS baseline, round(CASE WHEN baseline = 0 THEN 0 ELSE (picked - baseline) * 100 / baseline END, 6) AS lift FROM m"""
)
def q36_holdout_lift(spark: SparkSession, d: str) -> DataFrame:
    p = roles.points(spark, d)
    picked = sequence.top_n(roles.clips(p), ["video"], [F.col("score").desc(), "cand"], 3).select("video", "cand", "start", "end")
    lengths = p.groupBy("video").agg(F.max("end").alias("duration"))
    return _round(evaluate.lift(picked, evaluate.grid_windows(picked, lengths), p, 2 * DAY), "picked", "baseline", "lift")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    p = scratch.stored(roles.points(spark, d), "points")
    energy = scratch.stored(sequence.loud_and_quiet(roles.energy(roles.points(spark, d))), "loudness")  # hours of a video follow from the shuffle that orders its points
    chapters = scratch.stored(roles.chapters(p), "chapters")
    out = ranking.rank_clips(
        roles.in_hours(roles.clips(p)), roles.in_hours(roles.sentences(p)), roles.in_hours(p), roles.in_hours(chapters), energy, roles.in_hours(p.filter("kind = 'error'").select("video", "start", "end")), 0, 48.0
    )
    scratch.drop()
    return out


@query()
def q37_documents(spark: SparkSession, d: str) -> DataFrame:
    return ranking.clip_documents(_ranked(spark, d))


@query("SELECT count(*) FILTER (event_type <> 'error' OR event_type IS NULL) AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events")
def q38_run_report(spark: SparkSession, d: str) -> DataFrame:
    return ranking.run_report(table(spark, d, "events").select(F.when(F.col("event_type") == "error", F.col("event_type")).alias("error")))
