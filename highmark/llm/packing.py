"""Packing into sequences of fixed length: concatenate all documents and cut.

Two passes of prefix sums give each document its place in the concatenation: the ids before it in its
partition (kept with its ids) and those of all partitions before. Windows of that line are the sequences,
so each but the last is full, and a document is cut only where a window ends. Nothing is shuffled.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from highmark.llm.tokens import starts, tokenised

LENGTH = 4096
PAD = 0


def pack(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, spaced: bool = False) -> DataFrame:
    """A row per piece of docs(doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset, ids binary.

    start counts the document's ids before the piece, offset those of its sequence; both kinds of gaps
    don't occur. first and last tell the boundary pieces, with which a document begins and ends. A null
    or empty text is its end id alone. Rows that repeat are packed each; a document of any length is
    spread over as many sequences as it fills. An empty table gives no piece.
    """
    ids = tokenised(docs, path, end_id, spaced)
    at = ids.join(starts(ids.groupBy("part").agg(F.sum("n").alias("n"))), "part").withColumn("place", F.col("base") + F.col("ahead"))
    one = F.lit(length).cast("long")
    window = F.explode(F.sequence(F.expr(f"place div {length}"), F.expr(f"(place + n - 1) div {length}")))
    pieces = at.select("doc_id", "place", F.col("n").alias("doc_tokens"), "ids", window.alias("sequence_id"))
    begin = F.greatest("place", F.col("sequence_id") * one)
    pieces = pieces.withColumn("start", begin - F.col("place")).withColumn("offset", begin - F.col("sequence_id") * one)
    pieces = pieces.withColumn("length", F.least(F.col("place") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * one) - begin)
    own = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    last = F.col("start") + F.col("length") == F.col("doc_tokens")
    return pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", (F.col("start") == 0).alias("first"), last.alias("last"), own.alias("ids"))


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """A row per sequence: sequence_id, n_ids, ids binary of 4 * length bytes, the last sequence padded.

    At most `length` pieces meet in a group. Pieces of null doc_ids are pieces like others; no piece, no sequence.
    """
    joined = F.expr("aggregate(ps, cast('' as binary), (all, p) -> concat(all, p.ids))")
    padding = "".join(f"{b:02x}" for b in pad.to_bytes(4, "little"))
    full = F.concat(joined, F.unhex(F.repeat(F.lit(padding), (F.lit(length) - F.col("n_ids")).cast("int"))))
    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("ps"), F.sum("length").alias("n_ids"))
    return grouped.select("sequence_id", "n_ids", full.alias("ids"))
