"""Candidates from a model's raw answers: strict JSON, mended JSON, or whatever flat objects can be saved."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from highmark.functions.text import strip, to_double, to_int
from highmark.storage import stored

_ITEM = "struct<title string, start_time string, end_time string, score string, hook_sentence string, virality_reason string>"
_ANSWER = f"highlights array<{_ITEM}>, content_type string, density string, _bad string"
_TEXTS = ("title", "hook_sentence", "virality_reason")


def sanitise(raw: DataFrame, duration: str = "duration") -> DataFrame:
    """Rows (video, ..., loose fields) with typed start, end, score, title, hook_sentence, virality_reason; impossible ones go.

    Numbers that can't be read are -1 (times) or 0 (score). start < 0, end <= start and NaN go; both
    are cut to the duration where it is above 0. Scores go from 0 to 100; a missing title is made up.
    """
    rows = raw.withColumn("start", to_double(F.col("start_time"), -1)).withColumn("end", to_double(F.col("end_time"), -1)).filter("not isnan(start) and not isnan(end) and start >= 0 and end > start")
    most = F.when(F.col(duration) > 0, F.col(duration))
    rows = rows.withColumn("start", F.least("start", most)).withColumn("end", F.least("end", most)).filter("end > start")
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), to_int(F.col("score"), 0))))
    text = lambda c, other: strip(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)))
    return rows.withColumn("title", text("title", "Untitled Highlight")).withColumn("hook_sentence", text("hook_sentence", "")).withColumn("virality_reason", text("virality_reason", "")).drop("start_time", "end_time")


# Fixed patterns: code fences, commas before a closing bracket, the outermost object, flat objects and their fields.


def _parsed(raw: Column) -> Column:
    """The answer as a struct, null where no way of mending helps."""
    bare = F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    mend = lambda t: F.regexp_replace(t, r",\s*([}\]])", "$1")
    outer = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)

    def read(t: Column) -> Column:
        found = F.from_json(t, _ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        return F.transform(F.array(found), lambda s: F.when(s["_bad"].isNull() & s["highlights"].isNotNull(), s))[0]  # parsed once

    return F.coalesce(read(bare), read(mend(bare)), read(mend(outer)))


def _salvaged(raw: Column) -> Column:
    number = lambda o, k: F.nullif(F.regexp_extract(o, rf'"{k}"\s*:\s*(-?\d+(?:\.\d+)?)', 1), F.lit(""))
    string = lambda o, k: strip(F.regexp_extract(o, rf'(?s)"{k}"\s*:\s*"(.*?)"\s*(?:,|\}})', 1))
    objects = F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), F.lit(0))
    items = F.transform(
        objects,
        lambda o: F.struct(string(o, "title").alias("title"), number(o, "start_time").alias("start_time"), number(o, "end_time").alias("end_time"), number(o, "score").alias("score"), string(o, "hook_sentence").alias("hook_sentence"), string(o, "virality_reason").alias("virality_reason")),
    )
    return F.filter(items, lambda x: x["start_time"].isNotNull() & x["end_time"].isNotNull())


def candidates(raw: DataFrame) -> DataFrame:
    """video, chunk, cand, start, end, score, title, hook_sentence, virality_reason, content_type, density of raw(video, chunk, raw, duration).

    An answer that parses and has a usable item gives its items and labels. Otherwise every flat object
    with numeric times is taken, with labels other and medium.
    """
    rows = stored(raw.select("video", "chunk", "duration", "raw", _parsed(F.col("raw")).alias("p")), "answers")  # three branches read it
    strict = rows.select("video", "chunk", "duration", "raw", F.coalesce("p.content_type", F.lit("other")).alias("content_type"), F.coalesce("p.density", F.lit("medium")).alias("density"), F.posexplode("p.highlights").alias("pos", "h"))
    strict = sanitise(strict.filter("h is not null").select("video", "chunk", "duration", "content_type", "density", "pos", "h.*"))
    rest = rows.join(strict.select("video", "chunk").distinct(), ["video", "chunk"], "left_anti")
    loose = rest.select("video", "chunk", "duration", F.lit("other").alias("content_type"), F.lit("medium").alias("density"), F.posexplode(_salvaged(F.col("raw"))).alias("pos", "h"))
    both = strict.unionByName(sanitise(loose.select("video", "chunk", "duration", "content_type", "density", "pos", "h.*")))
    cand = F.row_number().over(Window.partitionBy("video").orderBy("chunk", "pos")) - 1
    return both.withColumn("cand", cand).select("video", "chunk", "cand", "start", "end", "score", *_TEXTS, "content_type", "density")
