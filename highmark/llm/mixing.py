"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source expects the same number of copies, target / source size. The documents of a
source stand in one order, their expected copies are summed up from its start, one offset is added, and
a document is emitted once for each integer that its stretch of the sum crosses. As the order is by
size, each range of sizes gives its share, and the words taken come near the target.

The sum isn't run over a whole source in one task: documents are ranked within cells of (source, size
class, salt), and a cell starts where the counts of the cells before it end. A source has at most
SALTS * 512 cells, however many documents it holds.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from highmark.llm._shared import WORD, numbered, stored

#: Cells that share a source and a size class.
SALTS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Joins null with null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _hash24(text: Column) -> Column:
    """0 to 2 ** 24 - 1, the same in every SQL engine that has MD5."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """A row per source of sizes(source, size): key, source_size long, target double.

    Sources in order of their code points, null last, have the weights in turn. They share the sum of
    all sizes by weight; a target stops at `most` times its source's size, and what is left over goes to
    the others by weight, until none is above. That is a water level: sources fill up in order of
    (most * size / weight), and one is full if the level among those not yet full lies above that
    ratio. One row per source reaches the ordering task. Without rows there are no targets; where all
    sizes are 0, so are the targets.
    """
    by_source = sizes.groupBy(_source_key(F.col("source")).alias("key"), "source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "nth")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w, cap = F.col("weight"), F.col("cap")
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum(w).over(whole) - F.coalesce(F.sum(w).over(before), F.lit(0)))
    full = F.when(F.col("full"), F.lit(1)).otherwise(0)
    return (
        by_source.withColumn("nth", F.row_number().over(in_order))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") - 1) % len(weights) + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", cap / w)
        .withColumn("full", level > F.col("ratio"))
        .withColumn("level", (F.sum("source_size").over(whole) - F.sum(cap * full).over(whole)) / (F.sum(w).over(whole) - F.sum(w * full).over(whole)))
        .select("key", "source_size", F.when(F.col("full"), cap.cast("double")).otherwise(F.col("level") * w).alias("target"))
    )


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per row of docs(doc_id, text, source): ids, size, source_size, target, copies int, taken long.

    size is the number of words, 0 for null or blank texts, which are emitted as often as others of
    their source. Null ids and repeated rows are rows like others; an empty table gives none. copies is at most `most`. The same
    rows and seed give the same copies. Null ids are dealt over cells by size and input partition, so for them this holds where
    the table is read in the same partitions; rows of one other id share a cell per size class.
    """
    sizes = stored(docs.select(*ids, "source", word_count(F.col("text")).alias("size"), F.spark_partition_id().alias("__hm_part")), "sizes")  # texts are read once
    rows = sizes.withColumn("key", _source_key(F.col("source")))
    digits = F.length(F.bin("size"))
    rows = rows.withColumn("size_class", digits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0)) & 7").cast("int")).withColumn(
        "salt", _hash24(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.col("__hm_part").cast("string"), F.lit(":"), F.col("size").cast("string")))) % SALTS
    )
    cell = ["key", "size_class", "salt"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("key").orderBy("size_class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    cells = cells.join(source_targets(rows, weights, most), "key").drop("n")
    offset = _hash24(F.concat(F.lit(f"{seed}:"), F.col("key"))) / F.lit(float(1 << 24))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    nth = F.col("first") + F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id", *[x for x in ids if x != "doc_id"]))
    crossed = F.floor(F.col("each") * F.col("nth") + F.col("offset")) - F.floor(F.col("each") * (F.col("nth") - 1) + F.col("offset"))
    return (
        rows.join(cells, cell)
        .withColumn("nth", nth)
        .withColumn("each", each)
        .withColumn("offset", offset)
        .withColumn("copies", F.least(crossed, F.lit(most)).cast("int"))
        .select(*ids, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns that docs has. Odd rows go as in mix_plan()."""
    own = docs.columns
    rows = numbered(docs, "__hm_row")
    plan = mix_plan(rows.select("doc_id", "text", "source", "__hm_row"), weights, most, seed, ("doc_id", "__hm_row"))
    plan = plan.filter("copies > 0").select("__hm_row", F.col("copies").alias("__hm_copies"))
    taken = rows.join(plan, "__hm_row").withColumn("__hm_nth", F.explode(F.sequence(F.lit(1), F.col("__hm_copies"))))
    return taken.select(*[F.col(f"`{c}`") for c in own])
