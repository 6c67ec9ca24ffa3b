"""Operators over ordered rows of a video, as window functions."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from highmark.functions.text import content_words, jaccard
from highmark.params import DEFAULTS


def average_rank(value: Column | str, keys: list[str]) -> Column:
    """Rank within keys scaled to 0..1: ties share their mean rank, a lone row has 1."""
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*keys).orderBy(value)  # one order for all three, so rows are sorted once
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    same = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    rank = F.rank().over(w) - 1 + (same - 1) / 2
    return F.when(n == 1, F.lit(1.0)).otherwise(rank / (n - 1))


def peak_windows(points: DataFrame, most: int = 5, threshold: float = DEFAULTS.peak_threshold, gap: float = DEFAULTS.merge_gap) -> DataFrame:
    """video, nth (from 1), start, end, value: the strongest islands of points(video, idx, start, end, value).

    Points count from `threshold` of their video's maximum on (which must be above 0). One that starts by
    the end of the point before joins its island; an island ends with its last point. Ties go by start order.
    """
    w = Window.partitionBy("video")
    high = points.withColumn("most", F.max("value").over(w)).filter((F.col("most") > 0) & (F.col("value") >= threshold * F.col("most")))
    by_idx = w.orderBy("idx")
    new = F.coalesce((F.col("start") > F.lag("end").over(by_idx) + gap).cast("int"), F.lit(1))
    islands = high.withColumn("new", new).withColumn("island", F.sum("new").over(by_idx))
    peaks = islands.groupBy("video", "island").agg(F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), F.max("value").alias("value"))
    nth = F.row_number().over(w.orderBy(F.col("value").desc(), "island"))
    return peaks.withColumn("nth", nth).filter(F.col("nth") <= most).select("video", "nth", "start", "end", "value")


def pauses(segments: DataFrame, least: float = DEFAULTS.least_gap) -> DataFrame:
    """video, t: starts of segments(video, seg, start, end) at least `least` seconds after the end before."""
    before = F.lag("end").over(Window.partitionBy("video").orderBy("seg"))
    return segments.withColumn("before", before).filter(F.col("start") - F.col("before") >= least).select("video", F.col("start").alias("t"))


def topic_shifts(segments: DataFrame, block: float = DEFAULTS.topic_block) -> DataFrame:
    """video, t: where neighbouring blocks of segments(video, seg, start, end, text) share fewer words than on either side."""
    n = F.greatest(F.floor(F.max_by("end", "seg") / block) + 1, F.lit(1))
    counts = segments.groupBy("video").agg(n.alias("n"))
    blocks = counts.select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    said = segments.join(counts, "video").withColumn("b", F.least(F.col("n") - 1, F.floor(F.col("start") / block)))
    words = said.withColumn("w", F.explode(content_words(F.col("text")))).groupBy("video", "b").agg(F.collect_set("w").alias("words"))
    none = F.array().cast("array<string>")
    w = Window.partitionBy("video").orderBy("b")
    rows = blocks.join(words, ["video", "b"], "left").withColumn("words", F.coalesce("words", none))
    rows = rows.withColumn("next", F.lead("words").over(w)).filter("next is not null").withColumn("sim", jaccard(F.col("words"), F.col("next")))
    low = (F.col("sim") < F.lag("sim").over(w)) & (F.col("sim") < F.lead("sim").over(w))
    return rows.withColumn("low", low).filter("low").select("video", ((F.col("b") + 1) * block).alias("t"))


def boundaries(segments: DataFrame, peaks: DataFrame, spikes: DataFrame, block: float = DEFAULTS.topic_block) -> DataFrame:
    """video, t: distinct pauses, topic shifts, starts of peaks (the eight strongest are asked for) and spikes."""
    return pauses(segments).unionByName(topic_shifts(segments, block)).unionByName(peaks.select("video", F.col("start").alias("t"))).unionByName(spikes.select("video", F.col("sec").cast("double").alias("t"))).distinct()


def loudness(samples: DataFrame, rate: int = 16_000) -> DataFrame:
    """video, sec, value: root mean square of each whole second of samples(video, i, x), over its video's maximum.

    A last second that isn't whole goes; videos with fewer than two seconds have no row.
    """
    return _heard(samples.groupBy("video", F.floor(F.col("i") / rate).alias("sec")).agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("squares"), F.count("*").alias("n")), rate)


def loudness_of_blocks(blocks: DataFrame, rate: int = 16_000) -> DataFrame:
    """loudness() of blocks(video, first, pcm) of sound: 16-bit little-endian samples from sample number `first` on; with a column `bits`, samples of 16 or 32 bits by block.

    Blocks may have any length and end within a second: each gives its sums of squares by second, and a second's
    sums meet. Bytes left over at a block's end are no sample; blocks that are null or empty give nothing.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, seconds, squares, counts = [], [], [], []
            for k in range(b.num_rows):
                first, raw, size = b.column(1)[k].as_py(), b.column(2)[k], b.column(3)[k].as_py() // 8
                x = np.frombuffer(raw.as_buffer(), f"<i{size}", len(raw.as_buffer()) // size).astype(np.float64) if raw.is_valid and first is not None else np.zeros(0)
                if len(x):
                    sec = np.arange(first // rate, (first + len(x) - 1) // rate + 1)
                    cuts = np.maximum(sec * rate - first, 0)
                    rows.append(np.full(len(sec), k))
                    seconds.append(sec)
                    squares.append(np.add.reduceat(x * x, cuts))
                    counts.append(np.diff(np.append(cuts, len(x))))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), *[pa.array(np.concatenate(c).astype(t)) for c, t in ((seconds, np.int64), (squares, np.float64), (counts, np.int64))]], ["video", "sec", "squares", "n"])

    schema = T.StructType([blocks.schema["video"], T.StructField("sec", T.LongType()), T.StructField("squares", T.DoubleType()), T.StructField("n", T.LongType())])
    bits = F.col("bits") if "bits" in blocks.columns else F.lit(16)
    parts = blocks.select("video", F.col("first").cast("long"), "pcm", bits.cast("int").alias("bits")).mapInArrow(sums, schema)
    return _heard(parts.groupBy("video", "sec").agg(F.sum("squares").alias("squares"), F.sum("n").alias("n")), rate)


def _heard(seconds: DataFrame, rate: int) -> DataFrame:
    """Root mean squares of seconds(video, sec, squares, n) that are whole, over their video's maximum."""
    rms = seconds.filter(F.col("n") == rate).select("video", "sec", F.sqrt(F.col("squares") / F.col("n")).alias("rms"))
    w = Window.partitionBy("video")
    return rms.withColumn("k", F.count("*").over(w)).filter("k >= 2").withColumn("value", F.col("rms") / F.coalesce(F.nullif(F.max("rms").over(w), F.lit(0.0)), F.lit(1.0))).select("video", "sec", "value")


def loud_and_quiet(energy: DataFrame, with_statistics: bool = False) -> DataFrame:
    """energy(video, sec, value) with is_spike (mean and two population deviations or more) and is_pause (at most 0.04, or 0.4 of the mean); value rounded to 4 places.

    With statistics, mean and std of the unrounded values stay, std at least 1e-6.
    """
    w = Window.partitionBy("video")
    rows = energy.withColumn("mean", F.avg("value").over(w)).withColumn("std", F.coalesce(F.nullif(F.stddev_pop("value").over(w), F.lit(0.0)), F.lit(1e-6)))
    spike, pause = F.col("value") >= F.col("mean") + 2 * F.col("std"), F.col("value") <= F.greatest(F.lit(0.04), 0.4 * F.col("mean"))
    rows = rows.withColumn("is_spike", spike).withColumn("is_pause", pause).withColumn("value", F.bround("value", 4))
    return rows if with_statistics else rows.drop("mean", "std")


def curve(points: DataFrame, width: float, buckets: int = 40) -> DataFrame:
    """video, line: the mean replay of so many equal buckets as eight heights of bars."""
    from highmark.operators.intervals import overlap_mean

    glyphs = F.array(*map(F.lit, "▁▂▃▄▅▆▇█"))
    ends = points.groupBy("video").agg(F.max_by("end", "idx").alias("d")).filter("d > 0")
    spans = ends.select("video", "d", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("cand"))
    spans = spans.select("video", "cand", (F.col("d") * F.col("cand") / buckets).alias("start"), (F.col("d") * (F.col("cand") + 1) / buckets).alias("end"))
    means = overlap_mean(spans, points, width, "v").withColumn("most", F.coalesce(F.nullif(F.max("v").over(Window.partitionBy("video")), F.lit(0.0)), F.lit(1.0)))
    height = F.least(F.lit(8), F.floor(F.col("v") / F.col("most") * 7).cast("int") + 1)
    bars = means.select("video", "cand", F.element_at(glyphs, height).alias("g"))
    return bars.groupBy("video").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cand", "g"))), lambda x: x["g"]), "").alias("line"))


def rolling_median(value: str, keys: list[str], order: str) -> Column:
    """The middle of a value and its neighbours; the larger one of two at the ends."""
    near = F.sort_array(F.collect_list(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-1, 1)))
    return F.element_at(near, F.floor(F.size(near) / 2).cast("int") + 1)


def top_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
