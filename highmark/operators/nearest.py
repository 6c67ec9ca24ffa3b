"""As-of lookups: the last item up to a time of its video, or the first from it on.

Probes and items of a video are sorted together within time bins, so a long video is dealt over its bins.
What a bin hands on to the next ones is one item, found from one row per bin.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(probes: DataFrame, items: DataFrame, width: float, name: str, forward: bool = False) -> DataFrame:
    """video, cand, name: for each of probes(video, cand, t) the `found` of the last of items(video, t, found) up to t; forward: of the first from t on.

    Of items at one time the largest `found` counts, forward the smallest. Null where there is none; items
    without a time are none. width, in the unit of t, should hold a few thousand items.
    """
    bin_ = F.floor(F.col("t") / width).alias("__bin")
    item = F.struct(F.col("found")).alias("__item")  # an item with a null in it is an item
    i = items.filter("t is not null").select("video", F.lit(None).cast(probes.schema["cand"].dataType).alias("cand"), "t", bin_, item)
    rows = probes.filter("t is not null").select("video", "cand", "t", bin_, F.lit(None).cast(i.schema["__item"].dataType).alias("__item")).unionByName(i)
    by = [F.col("t").desc(), F.col("__item").desc_nulls_last()] if forward else [F.col("t"), F.col("__item").asc_nulls_last()]
    within = Window.partitionBy("video", "__bin").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("__near", F.last("__item", ignorenulls=True).over(within)).filter("__item is null")
    edge = (F.min if forward else F.max)(F.when(F.col("__item").isNotNull(), F.struct("t", "__item")))
    before = Window.partitionBy("video").orderBy(F.col("__bin").desc() if forward else F.col("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy("video", "__bin").agg(edge.alias("__edge")).select("video", "__bin", F.last("__edge", ignorenulls=True).over(before)["__item"].alias("__carried"))
    return near.join(edges, ["video", "__bin"], "left").select("video", "cand", F.coalesce("__near", "__carried")["found"].alias(name))


def first_to_end(segments: DataFrame, block: int = 4096) -> DataFrame:
    """video, t, found: ends of segments(video, seg, end) that are later than all before, in their order.

    The first segment that ends at a time or later is the first of these from that time on. Segments are dealt by `block` numbers.
    """
    s = segments.filter("end is not null").select("video", "seg", F.col("end").alias("t"), F.floor(F.col("seg") / block).alias("__block"))
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = s.groupBy("video", "__block").agg(F.max("t").alias("__most")).select("video", "__block", F.max("__most").over(before("video", by="__block")).alias("__before"))
    rows = s.withColumn("__own", F.max("t").over(before("video", "__block", by="seg"))).join(blocks, ["video", "__block"])
    latest = F.greatest("__before", "__own")
    return rows.filter(latest.isNull() | (F.col("t") > latest)).select("video", "t", F.col("t").alias("found"))


def first_holders(chapters: DataFrame, width: float) -> DataFrame:
    """video, t, found: from each start or end of chapters(video, ch, start, end, title) on, the title of the first that holds start <= t < end, null if none does.

    A null end is open. Chapters may overlap; they meet edges by time bin.
    """
    c = chapters.filter("start is not null").select("video", "ch", "start", "end", "title")
    edges = c.select("video", F.explode(F.array("start", "end")).alias("t")).filter("t is not null").distinct()
    to = edges.groupBy("video").agg(F.max("t").alias("__to"))
    held = c.join(to, "video").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest("start", F.coalesce("end", "__to")) / width))))
    at = edges.withColumn("__bin", F.floor(F.col("t") / width)).join(held, ["video", "__bin"]).filter("start <= t and (end is null or t < end)")
    return edges.join(at.groupBy("video", "t").agg(F.min_by("title", "ch").alias("found")), ["video", "t"], "left")
