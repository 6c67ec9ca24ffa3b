"""Upright crops that follow a face."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from highmark.operators.nearest import asof
from highmark.operators.sequence import rolling_median
from highmark.params import DEFAULTS
from highmark.storage import Scratch, stored


def crop_bin(cx: Column, bins: int = DEFAULTS.crop_bins) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.bround(cx * bins).cast("int")))


def largest_faces(faces: DataFrame) -> DataFrame:
    """video, t, cx, cy, face_w: the largest of faces(video, t, nth, cx, cy, w, h) of each frame; of equal ones the first by nth, then by cx, cy and w."""
    order = F.struct(F.col("w") * F.col("h"), *[-F.col(c) for c in ("nth", "cx", "cy", "w")])
    best = faces.groupBy("video", "t").agg(F.max_by(F.struct("cx", "cy", "w"), order).alias("b"))
    return best.select("video", "t", "b.cx", "b.cy", F.col("b.w").alias("face_w"))


def clip_samples(clips: DataFrame, samples: DataFrame, width: float) -> DataFrame:
    """video, cand, t, cx: the samples(video, t, cx) within clips, both ends included."""
    from highmark.operators.intervals import overlaps

    items = samples.select("video", (F.col("t") - 1).alias("start"), (F.col("t") + 1).alias("end"), "t", "cx")
    pairs = overlaps(clips.select("video", "cand", "start", "end"), items, width).filter("start <= i_t and i_t <= end")
    return pairs.select("video", "cand", F.col("i_t").alias("t"), F.col("i_cx").alias("cx"))


def _next_cuts(rows: DataFrame, shortest: float, width: float) -> DataFrame:
    """video, i, to: of rows(video, i, t, bin), the sample at which a stretch that begins with i ends: the first `shortest` later or more in another bin."""
    w = Window.partitionBy("video").orderBy("i")
    turn = F.when(F.col("bin") != F.lag("bin").over(w), F.col("i"))
    later = Window.partitionBy("video").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("turn", turn).withColumn("run", F.last("turn", ignorenulls=True).over(later))
    sample = lambda of: F.struct(of("i").alias("i"), of("t").alias("t"), of("bin").alias("bin"), of("run").alias("run"))
    own = sample(F.col)
    items = rows.select("video", "t", F.struct(F.col("i"), own.alias("one"), sample(lambda c: F.lead(c).over(w)).alias("two")).alias("found"))
    # sums and differences of times round differently: look from a little earlier, and compare differences
    near = (F.col("t") + shortest) - 1e-9 * F.greatest(F.lit(1.0), F.abs("t"))
    found = asof(rows.select("video", F.col("i").alias("cand"), near.alias("t")), items, width, "found", forward=True).withColumnRenamed("cand", "i")
    late = F.when(F.col("found.one.t") - F.col("t") >= shortest, F.col("found.one")).otherwise(F.col("found.two"))
    cut = rows.join(found, ["video", "i"]).withColumn("late", late).filter("late.t is not null")
    return cut.select("video", "i", F.when(F.col("late.bin") != F.col("bin"), F.col("late.i")).otherwise(F.col("late.run")).alias("to")).filter("to is not null")


def _reached(pointers: DataFrame, first: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """video, i: what pointers(video, i, to) lead to from first(video, i), itself included: the way doubles with each round."""
    reached = keep(first, "reached")
    while not pointers.isEmpty():
        reached = keep(reached.unionByName(reached.join(pointers, ["video", "i"]).select("video", F.col("to").alias("i"))).distinct(), "reached")
        ahead = pointers.select("video", F.col("i").alias("to"), F.col("to").alias("further"))
        pointers = keep(pointers.join(ahead, ["video", "to"]).select("video", "i", F.col("further").alias("to")), "pointers")
    return reached


def crop_segments(samples: DataFrame, durations: DataFrame, bins: int = DEFAULTS.crop_bins, shortest: float = DEFAULTS.shortest_crop, width: float = 600.0) -> DataFrame:
    """video, nth, start, end, x of samples(video, t, cx) and durations(video, duration): stretches with one crop.

    Positions are smoothed and binned. A stretch ends where the bin differs, but not before `shortest`
    seconds (above 0); the last one, if shorter and less than a bin away, joins the one before. Each sample
    gets the end of a stretch that would begin there; the stretches are those that the first sample leads to.
    """
    scratch = Scratch(samples.sparkSession)
    rows = samples.withColumn("cx", rolling_median("cx", ["video"], "t")).withColumn("bin", crop_bin(F.col("cx"), bins))
    nth = lambda *by: F.row_number().over(Window.partitionBy("video").orderBy(*by)) - 1
    rows = scratch.stored(rows.select("video", F.col("t").cast("double").alias("t"), "bin").withColumn("i", nth("t", "bin")), "samples")
    pointers = scratch.stored(_next_cuts(rows, shortest, width), "pointers")
    starts = _reached(pointers, rows.filter("i = 0").select("video", "i"), scratch.stored)
    w = Window.partitionBy("video").orderBy("i")
    segs = rows.join(starts, ["video", "i"]).join(durations.select("video", F.col("duration").cast("double").alias("duration")), "video")
    segs = segs.select("video", "i", F.col("t").alias("start"), F.coalesce(F.lead("t").over(w), "duration").alias("end"), ((F.col("bin") + 0.5) / bins).alias("x"))
    # every stretch but the last is `shortest` or longer
    joins = (F.col("end") - F.col("start") < shortest) & (F.abs(F.lag("x").over(w) - F.col("x")) < 1.0 / bins)
    segs = segs.withColumn("joins", F.coalesce(joins, F.lit(False)))
    segs = segs.withColumn("end", F.when(F.lead("joins").over(w), F.lead("end").over(w)).otherwise(F.col("end"))).filter("not joins")
    out = stored(segs.select("video", nth("i").alias("nth"), "start", "end", "x"), "crops")
    scratch.drop()
    return out


def crop_window(src_w: Column, src_h: Column, x: Column, target_w: int = 1080, target_h: int = 1920) -> Column:
    """x, y, w, h in pixels: wide sources are cut in width around x, tall ones in height, a little above the middle."""
    ratio = target_w / target_h
    wide = src_w / src_h >= ratio
    w = F.when(wide, F.floor(src_h * ratio)).otherwise(src_w).cast("int")
    h = F.when(wide, src_h).otherwise(F.floor(src_w / ratio)).cast("int")
    px = F.when(wide, F.greatest(F.lit(0), F.least(F.floor(x * (src_w - w)), src_w - w))).otherwise(0).cast("int")
    py = F.when(wide, 0).otherwise(F.greatest(F.lit(0), F.floor((src_h - h) * 0.45))).cast("int")
    return F.struct(px.alias("x"), py.alias("y"), F.greatest(w, F.lit(2)).alias("w"), F.greatest(h, F.lit(2)).alias("h"))
