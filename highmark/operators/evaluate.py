"""Held-out evaluation: does a ranking that hasn't seen the replay curve find the replayed moments?"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from highmark.operators.intervals import overlap_mean

#: Random windows that a task makes and keeps sums of.
WINDOWS = 250_000


def _placed(trial: Column, trials: int, seed: int) -> Column:
    """cand, start, end of a random window for a row (video, cand, start, end, duration)."""
    length = F.col("end") - F.col("start")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in (F.col("video"), F.col("cand"), trial)]))
    u = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
    start = u * F.greatest(F.lit(0.1), F.col("duration") - length)
    return F.struct((F.col("cand") * trials + trial).alias("cand"), start.alias("start"), (start + length).alias("end"))


def random_windows(picked: DataFrame, durations: DataFrame, trials: int = 200, seed: int = 7) -> DataFrame:
    """video, cand, trial, start, end: for each picked clip so many windows of its length, each placed by a number of its own.

    That number is made of the MD5 of `seed:video:cand:trial`, so windows are the same in any run, order or engine.
    """
    rows = picked.join(durations, "video").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    return rows.select("video", "trial", _placed(F.col("trial"), trials, seed).alias("w")).select("video", "w.cand", "trial", "w.start", "w.end")


def random_baseline(picked: DataFrame, durations: DataFrame, points: DataFrame, width: float, trials: int = 200, seed: int = 7) -> DataFrame:
    """video, baseline: the mean replay of random_windows() of each video's picked clips, those without cover as 0.

    Points stand in blocks by start, `width` long, and windows are made beside them, an array a clip, so neither windows nor what
    they cover is shuffled: points and clips are, by video, over tasks of about WINDOWS windows each. Each point is in one block.
    """
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, -(-picked.count() * trials // WINDOWS))
    dealt = lambda df: df.repartition(tasks, "video")
    block = F.struct("start", "end", "value")
    blocks = dealt(points.filter("start <= end").select("video", "start", "end", "value")).groupBy("video", F.floor(F.col("start") / width).alias("block")).agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.collect_list(block).alias("points"))
    windows = dealt(picked.join(durations, "video").select("video", "cand", "start", "end", "duration")).select("video", F.transform(F.sequence(F.lit(1), F.lit(trials)), lambda k: _placed(k, trials, seed)).alias("windows"))
    near = lambda w: (w["end"] > F.col("lo")) & (w["start"] < F.col("hi"))
    met = blocks.join(windows, "video").select("video", "points", F.explode(F.filter("windows", near)).alias("w"))
    pairs = met.select("video", "w.*", F.explode("points").alias("p")).filter((F.col("p.end") > F.col("start")) & (F.col("p.start") < F.col("end")))
    shared = F.least("end", "p.end") - F.greatest("start", "p.start")
    covered = pairs.groupBy("video", "cand").agg(F.try_divide(F.sum(F.col("p.value") * shared), F.sum(shared)).alias("v")).groupBy("video").agg(F.sum("v").alias("v"))
    counts = picked.join(durations, "video").groupBy("video").agg((F.count("*") * trials).alias("n"))
    return counts.join(covered, "video", "left").select("video", (F.coalesce("v", F.lit(0.0)) / F.col("n")).alias("baseline"))


def grid_windows(picked: DataFrame, durations: DataFrame, steps: int = 10) -> DataFrame:
    """random_windows() with evenly placed windows instead."""
    rows = picked.join(durations, "video").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    length = F.col("end") - F.col("start")
    start = F.col("trial") * F.greatest(F.lit(0.1), F.col("duration") - length) / steps
    return rows.select("video", (F.col("cand") * steps + F.col("trial")).alias("cand"), "trial", start.alias("start"), (start + length).alias("end"))


def lift(picked: DataFrame, baseline: DataFrame, points: DataFrame, width: float) -> DataFrame:
    """video, picked, baseline, lift (percent, 0 where the baseline is 0): mean replay of picked clips against that of baseline windows.

    baseline is windows (video, cand, start, end), or what random_baseline() has made of them.
    """
    mean = lambda df, name: overlap_mean(df, points, width, "v").groupBy("video").agg(F.avg("v").alias(name))
    rows = mean(picked, "picked").join(baseline if "baseline" in baseline.columns else mean(baseline, "baseline"), "video")
    return rows.withColumn("lift", F.coalesce(F.try_divide((F.col("picked") - F.col("baseline")) * 100, "baseline"), F.lit(0.0)))


def verdict(lifts: DataFrame) -> DataFrame:
    """One row: videos, wins, mean_lift, passed."""
    return lifts.agg(F.count("*").alias("videos"), F.count_if(F.col("lift") > 0).alias("wins"), F.avg("lift").alias("mean_lift"), (F.avg("lift") > 0).alias("passed"))
