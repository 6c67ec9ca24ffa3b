"""Captions: cues of a few words, karaoke events, subtitle text."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from highmark.functions.text import strip
from highmark.functions.timefmt import ass_time, srt_time
from highmark.params import DEFAULTS

#: Fixed values of the subtitle format.
HIGHLIGHT, PLAIN = "&H0000FFFF&", "&H00FFFFFF&"


def cues(words: DataFrame, most: int = DEFAULTS.words_per_cue) -> DataFrame:
    """video, cue (from 1), start, end, text, words: so many words(video, w, start, end, word) at a time; empty words don't count."""
    rows = words.filter("word <> ''")
    nth = F.row_number().over(Window.partitionBy("video").orderBy("w")) - 1
    rows = rows.withColumn("cue", F.floor(nth / most).cast("int") + 1)
    packed = rows.groupBy("video", "cue").agg(F.sort_array(F.collect_list(F.struct("w", "start", "end", "word"))).alias("words"))
    return packed.select("video", "cue", F.col("words")[0]["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"), F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("text"), "words")


def karaoke(words: DataFrame, most: int = DEFAULTS.words_per_cue, colour: str = HIGHLIGHT) -> DataFrame:
    """video, cue, pos, start, end, text: an event for each word of a cue, with that word coloured; empty spans go.

    A word lasts to its end, the last one to the cue's, within the cue.
    """
    c = cues(words, most).select("video", "cue", F.col("start").alias("c_start"), F.col("end").alias("c_end"), "words", F.posexplode("words").alias("pos", "x"))
    end = F.when(F.col("pos") < F.size("words") - 1, F.col("x.end")).otherwise(F.col("c_end"))
    rows = c.withColumn("start", F.greatest("x.start", "c_start")).withColumn("end", F.least(end, F.col("c_end"))).filter("end > start")
    parts = F.transform("words", lambda w, j: F.when(j == F.col("pos"), F.concat(F.lit("{\\c" + colour + "}"), w["word"], F.lit("{\\c" + PLAIN + "}"))).otherwise(w["word"]))
    return rows.select("video", "cue", "pos", "start", "end", F.array_join(parts, " ").alias("text"))


def dialogue(events: DataFrame) -> DataFrame:
    """Events with their line of a styled subtitle file."""
    return events.withColumn("line", F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start")), F.lit(","), ass_time(F.col("end")), F.lit(",Default,,0,0,0,,"), F.col("text")))


def subtitle_text(cue_rows: DataFrame, order: str = "cue") -> DataFrame:
    """video, srt: numbered cues (video, order, start, end, text) as a subtitle file; line feeds in texts become spaces."""
    rows = cue_rows.withColumn("nth", F.row_number().over(Window.partitionBy("video").orderBy(order)))
    text = strip(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")))
    block = F.concat(F.col("nth").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"), text, F.lit("\n"))
    return rows.groupBy("video").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", block.alias("b")))), lambda x: x["b"]), "\n").alias("srt"))


def clip_cues(clips: DataFrame, segments: DataFrame, width: float) -> DataFrame:
    """video, cand, cue, start, end, text: segments within clips, cut to them, times from the clip's start, numbered anew."""
    from highmark.operators.intervals import overlaps

    pairs = overlaps(clips.select("video", "cand", "start", "end"), segments.select("video", "start", "end", "seg", "text"), width).withColumn("text", strip(F.coalesce("i_text", F.lit("")))).filter("text <> ''")
    rows = pairs.select("video", "cand", F.col("i_seg").alias("seg"), (F.greatest("i_start", "start") - F.col("start")).alias("s"), (F.least("i_end", "end") - F.col("start")).alias("e"), "text")
    cue = F.row_number().over(Window.partitionBy("video", "cand").orderBy("seg"))
    return rows.withColumn("cue", cue).select("video", "cand", "cue", F.col("s").alias("start"), F.col("e").alias("end"), "text")
