"""Interval joins. Clips are (video, cand, start, end, ...); every join carries the video.

Overlaps are joined by time bin as well, so a long video with a third of all rows is dealt over its
bins: both sides stand in every bin that they touch, and a pair counts in the first bin that they share.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from highmark.functions.text import INTEREST, content_words, strip
from highmark.operators.nearest import asof, first_holders, first_to_end
from highmark.params import DEFAULTS


def _bins(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def overlaps(clips: DataFrame, items: DataFrame, width: float) -> DataFrame:
    """Pairs of one video that overlap strictly: columns of clips, and of items with the prefix i_.

    width, in seconds, should be about the length of a clip. Rows with null times or an end before the start pair with nothing.
    """
    own = [c for c in items.columns if c != "video"]
    left = _bins(clips.filter("start <= end"), "start", "end", width)
    right = _bins(items.filter("start <= end"), "start", "end", width).select("video", "__bin", *[F.col(c).alias(f"i_{c}") for c in own])
    first = F.floor(F.greatest("start", "i_start") / width)
    return left.join(right, ["video", "__bin"]).filter((F.col("i_end") > F.col("start")) & (F.col("i_start") < F.col("end")) & (F.col("__bin") == first)).drop("__bin")


def _shared() -> Column:
    return F.least("end", "i_end") - F.greatest("start", "i_start")


def overlap_mean(clips: DataFrame, points: DataFrame, width: float, name: str = "replay_raw") -> DataFrame:
    """clips with the mean value of points(video, start, end, value), weighted by covered time; 0 without cover."""
    return clips.join(_means(clips, points, width), ["video", "cand"], "left").withColumn(name, F.coalesce("__mean", F.lit(0.0))).drop("__mean")


def _means(clips: DataFrame, points: DataFrame, width: float) -> DataFrame:
    pairs = overlaps(clips.select("video", "cand", "start", "end"), points.select("video", "start", "end", "value"), width)
    return pairs.groupBy("video", "cand").agg((F.sum(F.col("i_value") * _shared()) / F.sum(_shared())).alias("__mean"))


def chapter_score(clips: DataFrame, chapters: DataFrame, interest: str = INTEREST, name: str = "chapter_raw", width: float = 3600.0) -> DataFrame:
    """clips with 1.0 if the first chapter that holds their middle has a title of interest, 0.5 otherwise, null for videos without chapters.

    A chapter holds start <= t < end; a null end is open. Chapters become pieces that don't overlap, of which the last up to a middle counts.
    """
    out = clips.join(_titles(clips, chapters, width), ["video", "cand"], "left").join(_any(chapters, "__any"), "video", "left")
    return out.withColumn(name, F.when(F.col("__any"), _liked(interest))).drop("__title", "__any")


def _titles(clips: DataFrame, chapters: DataFrame, width: float) -> DataFrame:
    middles = clips.select("video", "cand", ((F.col("start") + F.col("end")) / 2).alias("t"))
    return asof(middles, first_holders(chapters, width), width, "__title")


def _liked(interest: str) -> Column:
    return F.when(F.coalesce(F.col("__title"), F.lit("")).rlike(f"(?i){interest}"), 1.0).otherwise(0.5)


def _any(items: DataFrame, name: str) -> DataFrame:
    return items.select("video").distinct().withColumn(name, F.lit(True))


def window_score(clips: DataFrame, energy: DataFrame, width: float, name: str = "audio_raw") -> DataFrame:
    """clips with 0.7 of the mean of energy(video, sec, value, is_spike) in their whole seconds and 0.3 of spikes / 3, both at most 1.

    0 where no second is there, null for videos without energy. Seconds int(start) to int(end) count.
    """
    out = clips.join(_heard(clips, energy, width), ["video", "cand"], "left").join(_any(energy, "__any"), "video", "left")
    return out.withColumn(name, F.when(F.col("__any"), F.coalesce("__score", F.lit(0.0)))).drop("__score", "__any")


def _heard(clips: DataFrame, energy: DataFrame, width: float) -> DataFrame:
    whole = clips.select("video", "cand", F.floor(F.greatest("start", F.lit(0.0))).cast("double").alias("start"), (F.floor("end") + 1).cast("double").alias("end"))
    items = energy.select("video", F.col("sec").cast("double").alias("start"), (F.col("sec") + 1).cast("double").alias("end"), "value", "is_spike")
    pairs = overlaps(whole, items, width)
    bonus = F.least(F.sum(F.when(F.col("i_is_spike"), 1.0).otherwise(0.0)) / 3, F.lit(1.0))
    return pairs.groupBy("video", "cand").agg(F.least(F.lit(1.0), 0.7 * F.avg("i_value") + 0.3 * bonus).alias("__score"))


def signals(clips: DataFrame, points: DataFrame, energy: DataFrame, chapters: DataFrame, width: float) -> DataFrame:
    """clips with replay_raw, audio_raw and chapter_raw, as overlap_mean(), window_score() and chapter_score() give them; replay_raw is null for videos without points.

    clips, which should be stored, meet all three by video and cand first, then what their videos have, so they are shuffled twice.
    """
    out = clips
    for found in (_means(clips, points, width), _heard(clips, energy, width), _titles(clips, chapters, 3600.0)):
        out = out.join(found, ["video", "cand"], "left")
    for items, name in ((points, "__points"), (energy, "__energy"), (chapters, "__chapters")):
        out = out.join(_any(items, name), "video", "left")
    raw = {"replay_raw": F.when(F.col("__points"), F.coalesce("__mean", F.lit(0.0))), "audio_raw": F.when(F.col("__energy"), F.coalesce("__score", F.lit(0.0))), "chapter_raw": F.when(F.col("__chapters"), _liked(INTEREST))}
    return out.withColumns(raw).drop("__mean", "__score", "__title", "__points", "__energy", "__chapters")


def onset(peaks: DataFrame, energy: DataFrame, width: float) -> DataFrame:
    """peaks(video, cand, peak, floor) with `onset`: walking back from the peak's second while energy is above its video's mean.

    That is the last second up to the peak's whose value is at most the mean, or the floor's second if
    there is none; null for videos without energy.
    """
    stats = energy.groupBy("video").agg(F.avg("value").alias("__mean"), (F.max("sec") + 1).alias("__n"))
    p = peaks.join(stats, "video", "left").withColumn("__at", F.least(F.col("__n") - 1, F.floor("peak"))).withColumn("__floor", F.greatest(F.floor("floor"), F.lit(0)))
    span = p.filter("__at >= __floor").select("video", "cand", "__mean", F.col("__floor").cast("double").alias("start"), (F.col("__at") + 1).cast("double").alias("end"))
    items = energy.select("video", F.col("sec").cast("double").alias("start"), (F.col("sec") + 1).cast("double").alias("end"), "sec", "value")
    last = overlaps(span, items, width).filter("i_value <= __mean").groupBy("video", "cand").agg(F.max("i_sec").alias("__last"))
    found = F.when(F.col("__at") <= F.col("__floor"), F.col("__at")).otherwise(F.coalesce("__last", "__floor"))
    return p.join(last, ["video", "cand"], "left").withColumn("onset", found.cast("double")).drop("__mean", "__n", "__at", "__floor", "__last")


def snap(clips: DataFrame, segments: DataFrame, pad: float = DEFAULTS.pad, tolerance: float = DEFAULTS.snap_tolerance, width: float = 3600.0, to_end: DataFrame | None = None) -> DataFrame:
    """clips moved to edges of segments(video, seg, start, end), and padded.

    The start goes to the last segment start up to it (else to the first start), the end to the end of
    the first segment, in their order, that ends there or later (else to the last segment's end). Clips that
    would be empty, and those of videos without segments, stay. A second call moves most clips again. to_end is first_to_end(segments), where it is stored.
    """
    edges = segments.groupBy("video").agg(F.min_by("start", "seg").alias("__first"), F.max_by("end", "seg").alias("__last"))
    starts = asof(clips.select("video", "cand", (F.col("start") + tolerance).alias("t")), segments.select("video", F.col("start").alias("t"), F.col("start").alias("found")), width, "__start")
    ends = asof(clips.select("video", "cand", (F.col("end") - tolerance).alias("t")), first_to_end(segments) if to_end is None else to_end, width, "__end", forward=True)
    out = clips.join(starts, ["video", "cand"], "left").join(ends, ["video", "cand"], "left").join(edges, "video", "left")
    start = F.greatest(F.coalesce("__start", "__first") - pad, F.lit(0.0))
    end = F.coalesce("__end", "__last") + pad
    moved = F.col("__first").isNotNull() & (end > start)
    return (
        out.withColumn("__s", F.when(moved, start).otherwise(F.col("start")))
        .withColumn("end", F.when(moved, F.least(end, F.col("__last") + pad)).otherwise(F.col("end")))
        .withColumn("start", F.col("__s"))
        .drop("__s", "__start", "__end", "__first", "__last")
    )


def overlapping_peak(clips: DataFrame, peaks: DataFrame, spikes: DataFrame, width: float) -> DataFrame:
    """clips with `peak`: the start of the strongest of peaks(video, start, end, value) that overlaps, else the first of spikes(video, sec) within, else null."""
    c = clips.select("video", "cand", "start", "end")
    strong = overlaps(c, peaks.select("video", "start", "end", "value"), width).groupBy("video", "cand").agg(F.max_by("i_start", F.struct("i_value", -F.col("i_start"))).alias("__peak"))
    points = spikes.select("video", (F.col("sec") - 1).cast("double").alias("start"), (F.col("sec") + 1).cast("double").alias("end"), F.col("sec").cast("double").alias("sec"))
    near = overlaps(c, points, width).filter("start <= i_sec and i_sec <= end").groupBy("video", "cand").agg(F.min("i_sec").alias("__spike"))
    return clips.join(strong, ["video", "cand"], "left").join(near, ["video", "cand"], "left").withColumn("peak", F.coalesce("__peak", "__spike")).drop("__peak", "__spike")


def excerpt(clips: DataFrame, segments: DataFrame, width: float, name: str = "excerpt") -> DataFrame:
    """clips with the texts of overlapping segments(video, seg, start, end, text), stripped, in order, joined by spaces."""
    pairs = overlaps(clips.select("video", "cand", "start", "end"), segments.select("video", "start", "end", "seg", "text"), width).withColumn("t", strip(F.coalesce("i_text", F.lit("")))).filter("t <> ''")
    texts = pairs.groupBy("video", "cand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i_seg", "t"))), lambda x: x["t"]), " ").alias("__text"))
    return clips.join(texts, ["video", "cand"], "left").withColumn(name, F.coalesce("__text", F.lit(""))).drop("__text")


def spoken(clips: DataFrame, segments: DataFrame, width: float, name: str = "said") -> DataFrame:
    """clips with the content words of their excerpt() joined by spaces, in any order: texts meet as sets of words, so repeated ones are shuffled once."""
    words = segments.select("video", "start", "end", F.array_join(content_words(F.col("text")), " ").alias("said")).filter("said <> ''")
    pairs = overlaps(clips.select("video", "cand", "start", "end"), words, width)
    texts = pairs.groupBy("video", "cand").agg(F.array_join(F.array_distinct(F.split(F.array_join(F.collect_set("i_said"), " "), " ")), " ").alias("__said"))
    return clips.join(texts, ["video", "cand"], "left").withColumn(name, F.coalesce("__said", F.lit(""))).drop("__said")


def packed(energy: DataFrame) -> DataFrame:
    """video, heard, loud, n: of energy(video, sec, value, is_spike), the sum of values, the number of spikes and of seconds before each second from 0 on, and after the last.

    Seconds that aren't there add nothing.
    """
    top = energy.groupBy("video").agg(F.max("sec").alias("top"))
    each = top.select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("sec")).join(energy, ["video", "sec"], "left")
    before = Window.partitionBy("video").orderBy("sec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = {"heard": F.coalesce("value", F.lit(0.0)), "loud": F.coalesce(F.col("is_spike").cast("int"), F.lit(0)), "n": F.col("value").isNotNull().cast("int")}
    sums = each.select("video", "sec", *[F.sum(x).over(before).alias(c) for c, x in kinds.items()])
    sums = sums.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("sec", *kinds))).alias("s"))
    return sums.select("video", *[F.concat(F.array(F.lit(0).cast("double" if c == "heard" else "long")), F.col(f"s.{c}")).alias(c) for c in kinds])


def packed_window_score(clips: DataFrame, sums: DataFrame, name: str = "audio_raw") -> DataFrame:
    """window_score() from packed() sums: two lookups a clip, in the array of its video. For sidecars, which hold one array a video."""
    top = F.size("n") - 1
    lo = F.least(F.greatest(F.floor("start"), F.lit(0)), top).cast("int")
    hi = F.greatest(lo, F.least(top, F.floor("end") + 1)).cast("int")
    of = lambda c: F.get(c, hi) - F.get(c, lo)
    score = F.when(of("n") > 0, F.least(F.lit(1.0), 0.7 * of("heard") / of("n") + 0.3 * F.least(of("loud") / 3, F.lit(1.0)))).otherwise(0.0)
    return clips.join(sums, "video", "left").withColumn(name, F.when(F.col("n").isNotNull(), score)).drop("heard", "loud", "n")


def drop_sponsored(clips: DataFrame, sponsors: DataFrame, width: float, share: float = DEFAULTS.overlap_share) -> DataFrame:
    """clips of which sponsors(video, start, end) cover less than `share`; sponsor rows that overlap count twice. Empty clips stay."""
    pairs = overlaps(clips.select("video", "cand", "start", "end"), sponsors.select("video", "start", "end"), width)
    covered = pairs.groupBy("video", "cand").agg(F.sum(_shared()).alias("__covered"))
    out = clips.join(covered, ["video", "cand"], "left")
    return out.filter(F.coalesce(F.col("__covered") / F.nullif(F.col("end") - F.col("start"), F.lit(0.0)), F.lit(0.0)) < share).drop("__covered")


def by_order(*order: Column | str) -> "Window":
    return Window.partitionBy("video").orderBy(*order)
