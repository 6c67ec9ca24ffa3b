"""Long transcripts in overlapping chunks, and the hints that go with each."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from highmark.functions.text import strip
from highmark.functions.timefmt import hms
from highmark.params import DEFAULTS, Params


def chunk_segments(segments: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """video, chunk, offset, chunk_duration, seg, start, end, text: segments by chunk, times from the chunk's start.

    Chunks are chunk_seconds long and start every chunk_seconds - chunk_overlap while before the last
    segment's end. A segment belongs to those in which it starts and ends, or ends at most chunk_overlap later. A chunk lasts to
    its last segment's end; empty ones don't occur.
    """
    step = p.chunk_seconds - p.chunk_overlap
    ends = segments.groupBy("video").agg(F.max_by("end", "seg").alias("duration"))
    s = segments.join(ends, "video")
    first = F.greatest(F.lit(0), F.ceil((F.col("end") - p.chunk_overlap - p.chunk_seconds) / step))
    last = F.least(F.floor(F.col("start") / step), F.ceil(F.col("duration") / step) - 1)
    rows = s.filter("start >= 0").withColumn("first", first).withColumn("last", last).filter("first <= last")
    rows = rows.withColumn("chunk", F.explode(F.sequence("first", "last"))).withColumn("offset", F.col("chunk") * step)
    rows = rows.filter((F.col("start") >= F.col("offset")) & (F.col("end") <= F.least(F.col("offset") + p.chunk_seconds, F.col("duration")) + p.chunk_overlap))
    rows = rows.withColumn("start", F.col("start") - F.col("offset")).withColumn("end", F.col("end") - F.col("offset"))
    w = Window.partitionBy("video", "chunk").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("chunk_duration", F.last("end").over(w)).select("video", "chunk", "offset", "chunk_duration", "seg", "start", "end", "text")


def transcript_text(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, transcript: lines of `[start s] text` in order."""
    line = F.format_string("[%.1fs] %s", "start", F.coalesce("text", F.lit("")))
    return segments.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", line.alias("l")))), lambda x: x["l"]), "\n").alias("transcript"))


def quota(clips: int, duration: Column, chunked: bool) -> Column:
    """How many candidates are asked for."""
    return F.least(F.greatest(F.lit(min(2 * clips, 10**6)), F.lit(5)), F.greatest(F.lit(2 if chunked else 3), F.floor(duration / 90)), F.lit(8)).cast("int")


def shifted(candidates: DataFrame) -> DataFrame:
    """Times of candidates(start, end, offset) counted from the video's start again."""
    return candidates.withColumn("start", F.col("start") + F.col("offset")).withColumn("end", F.col("end") + F.col("offset"))


def windows_of(chunked: DataFrame) -> DataFrame:
    """video, chunk, offset, lo, hi of chunk_segments(): where each chunk's hints lie."""
    rows = chunked.groupBy("video", "chunk").agg(F.first("offset").alias("offset"), F.max("chunk_duration").alias("length"))
    return rows.select("video", "chunk", "offset", F.col("offset").cast("double").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"))


#: Kinds of hints in their order, with what stands between items.
_KINDS = {"peaks": ("Replay peaks", ", "), "chapters": ("Chapters", " | "), "loud": ("Loud moments", ", "), "bounds": ("Natural boundaries", ", ")}


def hints(windows: DataFrame, peaks: DataFrame, chapters: DataFrame, spikes: DataFrame, bounds: DataFrame, most: int = 6, width: float = 600.0) -> DataFrame:
    """video, chunk, hints: for windows(video, chunk, offset, lo, hi) the first `most` signals of each kind with lo <= t < hi.

    peaks(video, nth, start, end) count as far as they are among their video's 2 * most strongest, wherever these
    lie; chapters need a title. Times count from the offset, at least 0. A kind without items has no line, a
    window without lines is ''. All kinds meet the windows in one join, by time bin; a null or infinite hi is open.
    """
    none = F.lit(None).cast("string")
    item = lambda df, kind, nth, t, end=None, title=none: df.select("video", F.lit(kind).alias("kind"), nth.cast("double").alias("nth"), t.cast("double").alias("t"), (F.lit(None) if end is None else end).cast("double").alias("to"), title.alias("title"))
    items = item(peaks.filter(F.col("nth") <= 2 * most), "peaks", F.col("nth"), F.col("start"), F.col("end"))
    items = items.unionByName(item(chapters.filter(strip(F.col("title")) != ""), "chapters", F.col("ch"), F.col("start"), title=F.col("title")))
    items = items.unionByName(item(spikes, "loud", F.col("sec"), F.col("sec"))).unionByName(item(bounds, "bounds", F.col("t"), F.col("t")))
    last = items.groupBy("video").agg(F.max("t").alias("__last"))
    bin_ = lambda t: F.floor(t / width)
    held = windows.select("video", "chunk", "offset", "lo", "hi").join(last, "video").filter(F.col("lo") <= F.col("__last"))
    held = held.withColumn("__bin", F.explode(F.sequence(bin_(F.col("lo")), bin_(F.greatest("lo", F.least("hi", "__last"))))))
    met = held.join(items.withColumn("__bin", bin_(F.col("t"))), ["video", "__bin"]).filter("lo <= t and (hi is null or t < hi)")
    nth = F.row_number().over(Window.partitionBy("video", "chunk", "kind").orderBy("nth", "t"))
    met = met.withColumn("place", nth).filter(F.col("place") <= most)
    at = lambda c: hms(F.greatest(F.col(c) - F.col("offset"), F.lit(0.0)))
    text = F.concat(at("t"), F.coalesce(F.when(F.col("to").isNotNull(), F.concat(F.lit("-"), at("to"))), F.concat(F.lit(" "), F.col("title")), F.lit("")))
    lists = met.groupBy("video", "chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "place", text.alias("text")))).alias("items"))

    def line(kind: str) -> Column:
        name, between = _KINDS[kind]
        own = F.transform(F.filter("items", lambda x: x["kind"] == kind), lambda x: x["text"])
        return F.when(F.size(own) > 0, F.concat(F.lit(f"- {name}: "), F.array_join(own, between)))

    whole = F.concat_ws("\n", *map(line, _KINDS))
    out = windows.select("video", "chunk").join(lists, ["video", "chunk"], "left").withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))
    return out.select("video", "chunk", F.when(whole != "", F.concat(F.lit("Signal hints:\n"), whole)).otherwise("").alias("hints"))
