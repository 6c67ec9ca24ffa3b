"""Fusing a video's signals into one score."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from highmark.operators.sequence import average_rank
from highmark.params import DEFAULTS

SIGNALS = ("llm", "replay", "audio", "chapter")


def active_weights(present: dict[str, Column], weights: dict[str, float] | None = None) -> dict[str, Column]:
    """The weights of present signals, scaled to 1; null for others. With no weight left, llm has 1."""
    weights = weights or DEFAULTS.weights
    own = {k: F.when(present[k] & F.lit(weights[k] > 0), F.lit(float(weights[k]))) for k in present}
    total = sum((F.coalesce(w, F.lit(0.0)) for w in own.values()), F.lit(0.0))
    return {k: F.when(total > 0, w / total).otherwise(F.lit(1.0) if k == "llm" else F.lit(None).cast("double")) for k, w in own.items()}


def fuse(clips: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """clips(video, cand, score, replay_raw, audio_raw, chapter_raw) with a fused score from 0 to 100.

    A signal is present in a video if any of its clips has a value; where a present signal lacks one, it
    counts as 0. Adds llm_score, fused (0 to 1), score (whole, halves to even), final_score, the weight and
    normalised value of each signal (null where it has no weight), signals_present, and `nth`, the
    order by score, ties by the order before (cand).
    """
    w = Window.partitionBy("video")
    raw = {"llm": F.col("score").cast("double"), **{k: F.col(f"{k}_raw") for k in SIGNALS[1:]}}
    rows = clips
    for k in SIGNALS[1:]:
        rows = rows.withColumn(f"has_{k}", F.max(F.col(f"{k}_raw").isNotNull()).over(w))
    present = {"llm": F.lit(True), **{k: F.col(f"has_{k}") for k in SIGNALS[1:]}}
    for k, x in active_weights(present, weights).items():
        rows = rows.withColumn(f"weight_{k}", x)
    for k in SIGNALS:
        rows = rows.withColumn(f"raw_{k}", F.coalesce(raw[k], F.lit(0.0)))
        rows = rows.withColumn(f"norm_{k}", F.when(F.col(f"weight_{k}").isNotNull(), average_rank(f"raw_{k}", ["video"])))
    fused = sum((F.coalesce(F.col(f"weight_{k}") * F.col(f"norm_{k}"), F.lit(0.0)) for k in SIGNALS), F.lit(0.0))
    rows = rows.withColumn("fused", fused).withColumn("llm_score", F.col("score").cast("int"))
    rows = rows.withColumn("score", F.bround(F.round(F.col("fused") * 100, 9)).cast("int")).withColumn("final_score", F.round(F.col("fused") * 100, 2))
    rows = rows.withColumn("signals_present", F.array_sort(F.array_compact(F.array(F.lit("llm"), *[F.when(F.col(f"has_{k}"), k) for k in SIGNALS[1:]]))))
    rows = rows.withColumn("nth", F.row_number().over(w.orderBy(F.col("score").desc(), "cand")))
    return rows.drop(*[f"raw_{k}" for k in SIGNALS], *[f"has_{k}" for k in SIGNALS[1:]])


def at_least(clips: DataFrame, score: float, fallback: bool = True) -> DataFrame:
    """clips of at least `score`; with fallback, a video where none reaches it keeps its best (ties by cand)."""
    good = F.col("score") >= score
    if not fallback:
        return clips.filter(good)
    w = Window.partitionBy("video")
    rows = clips.withColumn("__any", F.max(good).over(w)).withColumn("__nth", F.row_number().over(w.orderBy(F.col("score").desc(), "cand")))
    return rows.filter(good | (~F.col("__any") & (F.col("__nth") == 1))).drop("__any", "__nth")
