"""Widening clips around their peak: back to its set-up, forward past its end."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from highmark.operators.intervals import onset
from highmark.operators.nearest import asof, first_to_end
from highmark.params import DEFAULTS, Params


def expand(clips: DataFrame, segments: DataFrame, energy: DataFrame | None, width: float, p: Params = DEFAULTS, to_end: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> DataFrame:
    """clips(video, cand, start, end, peak) widened, with `expanded`; clips without a peak only get expanded = false.

    The new start lies between `peak_lead_most` and `peak_lead` seconds before the peak (so it can lie
    after the old one), at the last segment start up to it within these bounds (else the first within),
    less the pad. The end goes to the end of the first segment that ends `peak_tail` later or after,
    plus the pad; then at most `longest_clip` after the start. Clips of videos without segments stay, with null. to_end is first_to_end(segments), where it is stored.
    keep, if given, stores the clips with their onset, which are read several times.
    """
    lead, floor = F.greatest(F.col("peak") - p.peak_lead, F.lit(0.0)), F.greatest(F.col("peak") - p.peak_lead_most, F.lit(0.0))
    rows = clips.withColumn("__target", lead).withColumn("__floor", floor)
    if energy is not None:
        found = onset(rows.filter("peak is not null").select("video", "cand", "peak", F.col("__floor").alias("floor")), energy, width).select("video", "cand", F.col("onset").alias("__onset"))
        rows = rows.join(found, ["video", "cand"], "left")
    else:
        rows = rows.withColumn("__onset", F.lit(None).cast("double"))
    rows = keep(rows, "onset").withColumn("__new", F.least("start", "__target", F.when(F.col("__onset").isNotNull(), F.greatest("__onset", "__floor"))))
    ends = segments.groupBy("video").agg(F.max_by("end", "seg").alias("__last"))
    latest, tail = F.col("__target") + 0.5, F.col("end") + p.peak_tail
    with_peak = rows.filter("peak is not null")
    starts = segments.select("video", F.col("start").alias("t"), F.col("start").alias("found"))
    before = asof(with_peak.select("video", "cand", F.least(F.col("__new") + 0.5, latest).alias("t")), starts, width, "__before")
    within = asof(with_peak.select("video", "cand", F.col("__floor").alias("t")), starts, width, "__within", forward=True)
    after = asof(with_peak.select("video", "cand", (tail - p.snap_tolerance).alias("t")), first_to_end(segments) if to_end is None else to_end, width, "__end", forward=True)
    for near in (before, within, after):
        rows = rows.join(near, ["video", "cand"], "left")
    rows = rows.join(ends, "video", "left")
    rows = rows.withColumn("__before", F.when(F.col("__before") >= F.col("__floor"), F.col("__before"))).withColumn("__within", F.when(F.col("__within") <= latest, F.col("__within")))
    start = F.greatest(F.greatest("__floor", F.least(F.coalesce("__before", "__within", "__new"), "__target")) - p.pad, F.lit(0.0))
    rows = rows.withColumn("__s", start)
    end = F.least(F.coalesce("__end", tail) + p.pad, F.col("__last") + p.pad)
    end = F.greatest(F.least(end, F.col("__s") + p.longest_clip), F.col("__s") + 1.0)
    moved = F.col("peak").isNotNull() & F.col("__last").isNotNull()
    rows = rows.withColumn("end", F.when(moved, end).otherwise(F.col("end"))).withColumn("start", F.when(moved, F.col("__s")).otherwise(F.col("start")))
    rows = rows.withColumn("expanded", F.when(F.col("__last").isNotNull(), F.col("peak").isNotNull()))
    return rows.select(*[c for c in rows.columns if not c.startswith("__")])
