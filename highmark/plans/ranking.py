"""The whole ranking of a set of videos as one plan, shuffled by video."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from highmark.functions.text import slug
from highmark.functions.timefmt import hms_tenths
from highmark.operators.expand import expand
from highmark.operators.fusion import at_least, fuse
from highmark.operators.intervals import drop_sponsored, excerpt, overlapping_peak, signals, snap, spoken
from highmark.operators.nearest import first_to_end
from highmark.operators.sequence import peak_windows, top_n
from highmark.operators.suppress import by_text, by_time
from highmark.params import DEFAULTS, Params
from highmark.sources.tables import unfinished
from highmark.storage import Scratch, stored


def rank_clips(
    candidates: DataFrame, segments: DataFrame, points: DataFrame, chapters: DataFrame, energy: DataFrame, sponsors: DataFrame, least: float = 0, width: float = 60.0, p: Params = DEFAULTS
) -> DataFrame:
    """The best clips of each video, ranked.

    candidates(video, cand, start, end, score, title): suppressed by time, moved to sentence edges, scored by
    all signals, suppressed by text, widened around peaks, moved to edges again (which widens them further),
    freed of sponsored ones, filtered by score and cut to p.clips a video. Each operator joins clips to what it
    has found about them, so the clips are stored a few times on the way; these tables go when the result is
    stored. What a step doesn't need waits in them: clips pass with their times and score, and only the ranked
    ones meet their title, signals and excerpt. Inputs are read several times, so they should be stored.
    """
    scratch = Scratch(candidates.sparkSession)
    keep = scratch.stored
    found, to_end = keep(candidates, "candidates"), keep(first_to_end(segments), "ends")
    clips = keep(by_time(found.select("video", "cand", "start", "end", "score"), p.overlap_share, width), "apart")
    clips = keep(snap(clips, segments, p.pad, p.snap_tolerance, to_end=to_end), "snapped")
    fused = keep(fuse(steady(signals(clips, points, energy, chapters, width)), p.weights), "fused")
    clips = keep(spoken(fused.select("video", F.col("nth").alias("cand"), "start", "end", "score"), segments, width), "said")
    clips = keep(by_text(clips, "said", p.text_similarity).drop("said"), "unlike")
    peaks = peak_windows(points, 10, p.peak_threshold, p.merge_gap)
    clips = keep(overlapping_peak(clips, peaks, energy.filter("is_spike"), width), "peaks")
    clips = keep(expand(clips, segments, energy, width, p, to_end, keep), "expanded")
    clips = keep(snap(clips, segments, p.pad, p.snap_tolerance, to_end=to_end), "moved")
    clips = at_least(drop_sponsored(clips, sponsors, width, p.overlap_share), least)
    clips = keep(top_n(clips, ["video"], [F.col("score").desc(), "cand"], p.clips), "best")
    clips = _with(excerpt(clips, segments, width), fused.drop("start", "end", "score").withColumnsRenamed({"cand": "of", "nth": "cand"}), "cand")
    out = stored(_with(clips, found.drop("start", "end", "score").withColumnRenamed("cand", "of"), "of").drop("of"), "ranked")
    scratch.drop()
    return out


def _with(clips: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """clips with the columns of more that they lack, by video, null or not, and key."""
    m = more.withColumnsRenamed({"video": "__video", key: "__key"})
    return clips.join(m, F.col("video").eqNullSafe(F.col("__video")) & (F.col(key) == F.col("__key"))).drop("__video", "__key")


def steady(clips: DataFrame) -> DataFrame:
    """clips whose replay_raw and audio_raw are rounded: sums depend on the order of rows in their last digits, and clips that are equal must share their rank in any run."""
    return clips.withColumns({c: F.round(c, places) for c, places in (("replay_raw", 9), ("audio_raw", 12))})


def clip_documents(clips: DataFrame) -> DataFrame:
    """video, n_clips, clips: one nested document per video, clips by rank."""
    row = F.struct("rank", slug(F.col("title")).alias("name"), "title", "start", "end", hms_tenths(F.col("start")).alias("start_hms"), hms_tenths(F.col("end")).alias("end_hms"), "score")
    return clips.groupBy("video").agg(F.sort_array(F.collect_list(row)).alias("clips")).select("video", F.size("clips").alias("n_clips"), "clips")


def run_report(results: DataFrame) -> DataFrame:
    """ok, failed: how many of results(url, error) have no error, and how many have."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def with_documents(results: DataFrame, documents: DataFrame) -> DataFrame:
    """results(video, ...) with n_clips and clips of their documents (clip_documents()); 0 and null for those without one."""
    out = results.join(documents.select("video", "n_clips", "clips"), "video", "left")
    return out.withColumn("n_clips", F.coalesce("n_clips", F.lit(0)))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Documents (video, ...) as JSON, a folder per video; folders of other videos stay as they are."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").json(folder)


def finished(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Documents that write_documents() has left in a folder, none if it isn't there yet. schema has the columns beside video, which is text."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, video string")
    return spark.read.schema(f"{schema}, video string").json(folder)


def update(requests: DataFrame, make: Callable[[DataFrame], DataFrame], folder: str, schema: str, force: bool = False) -> DataFrame:
    """requests(video, params) with `redone`: documents of those that aren't finished with their parameters are made and written, the others stay.

    make gets the open requests and gives documents (video, and the columns of schema but params). params, any text that tells what a
    document depends on, is kept with it. A request that yields no document is redone each time.
    """
    asked = requests.select(F.col("video").cast("string").alias("video"), "params").distinct()
    done = finished(requests.sparkSession, folder, schema).select("video", "params")
    open_ = stored(asked if force else unfinished(asked, done, ["video", "params"]), "open")
    write_documents(make(open_).join(open_, "video").select("video", *T.StructType.fromDDL(schema).names), folder)
    return asked.join(open_.withColumn("redone", F.lit(True)), ["video", "params"], "left").withColumn("redone", F.coalesce("redone", F.lit(False)))

