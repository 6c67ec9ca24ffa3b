"""The driver's tables in the roles of videos: users' events are points, conversations are transcripts."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY, HOUR = 86_400.0, 3_600.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """video, idx, start, end, value, kind: a user's events, each until the next; the last one has no end and goes."""
    e = table(spark, d, "events").select(F.col("user_id").alias("video"), "event_id", "value", F.col("event_type").alias("kind"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 1e6).alias("start"))
    w = Window.partitionBy("video").orderBy("start", "event_id")
    return e.withColumn("idx", F.row_number().over(w) - 1).withColumn("end", F.lead("start").over(w)).filter("end is not null").select("video", "idx", "start", "end", "value", "kind")


POINTS = """
e AS (SELECT user_id AS video, event_id, value, event_type AS kind, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS t FROM events),
points AS (SELECT * FROM (SELECT video, row_number() OVER w - 1 AS idx, t AS s, lead(t) OVER w AS f, value, kind FROM e WINDOW w AS (PARTITION BY video ORDER BY t, event_id)) WHERE f IS NOT NULL)"""


def clips(pts: DataFrame) -> DataFrame:
    """video, cand (day), start, end, score, title: two days from each day with points; 10 a point, 100 at most."""
    return pts.groupBy("video", F.floor(F.col("start") / DAY).cast("int").alias("cand")).agg(F.least(F.lit(100), F.count("*") * 10).cast("int").alias("score"), F.min_by("kind", "idx").alias("title")).select(
        "video", "cand", (F.col("cand") * DAY).alias("start"), ((F.col("cand") + 2) * DAY).alias("end"), "score", "title"
    )


CLIPS = """
clips AS (SELECT video, cand, cand * 86400.0::DOUBLE AS s, (cand + 2) * 86400.0::DOUBLE AS f, score, title FROM
  (SELECT video, floor(s / 86400.0)::INTEGER AS cand, least(100, count(*) * 10)::INTEGER AS score, arg_min(kind, idx) AS title FROM points GROUP BY 1, 2))"""


def energy(pts: DataFrame) -> DataFrame:
    """video, sec, value: hour by hour, the mean value of points that start in it, over 487."""
    return pts.groupBy("video", F.floor(F.col("start") / HOUR).alias("sec")).agg((F.avg("value") / 487).alias("value"))


ENERGY = """
hours AS (SELECT video, floor(s / 3600.0)::BIGINT AS sec, avg(value) / 487 AS value FROM points GROUP BY 1, 2),
loud AS (SELECT video, sec, round_even(value, 4) AS value, value >= m + 2 * sd AS is_spike, value <= greatest(0.04, 0.4 * m) AS is_pause FROM
  (SELECT *, avg(value) OVER (PARTITION BY video) AS m, coalesce(nullif(stddev_pop(value) OVER (PARTITION BY video), 0), 1e-6) AS sd FROM hours))"""


def in_hours(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start") / HOUR).withColumn("end", F.col("end") / HOUR)


def chapters(pts: DataFrame) -> DataFrame:
    """video, ch (week), start, end (null in the last), title (kind of the first point)."""
    weeks = pts.groupBy("video", F.floor(F.col("start") / (7 * DAY)).cast("int").alias("ch")).agg(F.min("start").alias("start"), F.min_by("kind", "idx").alias("title"))
    return weeks.withColumn("end", F.lead("start").over(Window.partitionBy("video").orderBy("ch")))


CHAPTERS = """
chapters AS (SELECT *, lead(s) OVER (PARTITION BY video ORDER BY ch) AS f FROM
  (SELECT video, floor(s / 604800.0)::INTEGER AS ch, min(s) AS s, arg_min(kind, idx) AS title FROM points GROUP BY 1, 2))"""


def sentences(pts: DataFrame) -> DataFrame:
    """video, seg, start, end, text: points that last an hour at most, with their kind as text."""
    return pts.select("video", F.col("idx").alias("seg"), "start", F.least("end", F.col("start") + HOUR).alias("end"), F.col("kind").alias("text"))


SENTENCES = """
sentences AS (SELECT video, idx AS seg, s, least(f, s + 3600.0) AS f, kind AS text FROM points)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """video, seg, start, end, text: a conversation's turns, each a fifteenth of a second a character."""
    w = Window.partitionBy("video").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("video"), F.col("turn").cast("int").alias("seg"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("chars", F.sum(F.length("text")).over(w))
    return t.select("video", "seg", ((F.col("chars") - F.length("text")) / 15).alias("start"), (F.col("chars") / 15).alias("end"), "text")


TURNS = """
turns AS (SELECT video, seg, (chars - length(text)) / 15.0::DOUBLE AS s, chars / 15.0::DOUBLE AS f, text FROM
  (SELECT conv_id AS video, turn::INTEGER AS seg, coalesce(text, '') AS text, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS chars FROM conversations))"""


def words(t: DataFrame) -> DataFrame:
    """video, w, start, end, word: the words of turns, which share their turn's time."""
    rows = t.select("video", "seg", "start", "end", F.split("text", " ").alias("ws")).select("*", F.size("ws").alias("n"), F.posexplode("ws").alias("k", "word"))
    step = (F.col("end") - F.col("start")) / F.col("n")
    nth = F.row_number().over(Window.partitionBy("video").orderBy("seg", "k")) - 1
    return rows.select("video", nth.alias("w"), (F.col("start") + step * F.col("k")).alias("start"), (F.col("start") + step * (F.col("k") + 1)).alias("end"), "word")


WORDS = """
split_turns AS (SELECT video, seg, s, f, string_split(text, ' ') AS ws FROM turns),
each_word AS (SELECT video, seg, s, (f - s) / len(ws) AS step, unnest(range(0, len(ws))) AS k, unnest(ws) AS word FROM split_turns),
words AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY seg, k) - 1 AS w, s + step * k AS s, s + step * (k + 1) AS f, word FROM each_word)"""
