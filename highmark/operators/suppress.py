"""Greedy suppression: candidates in order of score, each kept unless one already kept stands against it.

What a suppressed candidate stands against doesn't matter, so pairs alone don't tell who stays. Rounds do: who
is beaten by nobody undecided is kept, and what it stands against goes; then the next round. That equals the loop
in order of score, with all videos and all their parts decided at once.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from highmark.functions.text import content_words, jaccard
from highmark.params import DEFAULTS
from highmark.storage import Scratch, stored


def _folded(rows: DataFrame, compared: list[str], against: Callable[[Column, Column], Column]) -> DataFrame:
    """v, cand that a fold over rows(v, o, cand, compared) in order of o keeps: against(kept, x) tells whether x goes."""
    rows = rows.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("o", "cand", *compared))).alias("rows"))
    small = lambda x: F.struct(x["cand"].alias("cand"), *[x[c].alias(c) for c in compared])
    empty = F.transform(F.filter("rows", lambda x: F.lit(False)), small)
    kept = F.aggregate("rows", empty, lambda acc, x: F.when(F.exists(acc, lambda k: against(k, x)), acc).otherwise(F.concat(acc, F.array(small(x)))))
    return rows.select("v", F.explode(F.transform(kept, lambda k: k["cand"])).alias("cand"))


def _ordered(clips: DataFrame, *more: str | Column) -> DataFrame:
    """v (the video, null or not), o (the order), cand and more."""
    return clips.select(F.struct("video").alias("v"), F.struct((-F.col("score")).alias("s"), "cand").alias("o"), "cand", *more)


def _only(clips: DataFrame, kept: DataFrame, how: str) -> DataFrame:
    k = kept.select(F.col("v.video").alias("__video"), F.col("cand").alias("__cand"))
    return clips.join(k, F.col("video").eqNullSafe(F.col("__video")) & (F.col("cand") == F.col("__cand")), how)


_CLIP = "struct<cand: {cand}, start: double, end: double>"


def _over(share: float) -> Callable[[Column, Column], Column]:
    def over(k: Column, x: Column) -> Column:
        both = F.least(k["end"], x["end"]) - F.greatest(k["start"], x["start"])
        return (both > 0) & (both > share * (x["end"] - x["start"]))

    return over


def _entered(clips: DataFrame, width: float, shift: float = 0.0) -> DataFrame:
    """clips once for each time bin that they touch, with `bin`; `inside` tells whether it is one alone. Clips without times are in bin 0."""
    at = lambda c: F.floor((F.col(c) + shift) / width)
    low = F.coalesce(at("start"), at("end"), F.lit(0).cast("long"))
    high = F.greatest(low, F.coalesce(at("end"), low))
    return clips.withColumn("inside", low == high).withColumn("bin", F.explode(F.sequence(low, high)))


def _local_winners(undecided: DataFrame, width: float, share: float, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The undecided clips that are best in all bins that they touch, and those that go with them or are decided by that.

    A bin's best is one row, found by partial aggregation, and it alone meets the others of its bins.
    """
    over = _over(share)
    entries = _entered(undecided, width)
    best = entries.groupBy("v", "bin").agg(F.min("o").alias("best"))
    won = entries.join(best, ["v", "bin"]).groupBy("v", "cand").agg(F.every(F.col("o") == F.col("best")).alias("won"), F.first("start").alias("start"), F.first("end").alias("end")).filter("won")
    won = keep(won.drop("won"), "kept")
    winners = _entered(won, width).select("v", "bin", F.struct("cand", "start", "end").alias("k"))
    gone = entries.join(winners, ["v", "bin"]).filter((F.col("cand") == F.col("k.cand")) | over(F.col("k"), {c: F.col(c) for c in ("start", "end")}))
    return won.select("v", "cand"), gone.select("v", "cand")


def _block_winners(undecided: DataFrame, width: float, shift: float, share: float, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """_local_winners() by blocks of time: each block's clips are taken in order, as far as clips that reach beyond it leave them certain.

    A clip goes if a kept one stands against it, and is kept if neither a kept nor an undecided one does and it lies inside the block.
    """
    over = _over(share)
    clip = _CLIP.format(cand=undecided.schema["cand"].dataType.simpleString())
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    small = lambda x: F.array(F.struct(*[x[c].alias(c) for c in ("cand", "start", "end")]))

    def step(acc: Column, x: Column) -> Column:
        goes = F.exists(acc["kept"], lambda k: over(k, x))
        open_ = ~x["inside"] | F.exists(acc["open"], lambda k: over(k, x))
        return F.struct(
            F.when(goes | open_, acc["kept"]).otherwise(F.concat(acc["kept"], small(x))).alias("kept"),
            F.when(goes, F.concat(acc["gone"], small(x))).otherwise(acc["gone"]).alias("gone"),
            F.when(~goes & open_, F.concat(acc["open"], small(x))).otherwise(acc["open"]).alias("open"),
        )

    blocks = _entered(undecided, width, shift).groupBy("v", "bin").agg(F.sort_array(F.collect_list(F.struct("o", "cand", "start", "end", "inside"))).alias("rows"))
    done = blocks.select("v", F.aggregate("rows", F.struct(none(clip).alias("kept"), none(clip).alias("gone"), none(clip).alias("open")), step).alias("s"))
    flag = lambda xs, kept: F.transform(xs, lambda x: F.struct(x["cand"].alias("cand"), F.lit(kept).alias("kept")))
    done = keep(done.select("v", F.inline(F.concat(flag(F.col("s.kept"), True), flag(F.col("s.gone"), False)))), "decided")
    return done.filter("kept").select("v", "cand"), done.select("v", "cand")


def by_time(clips: DataFrame, share: float = DEFAULTS.overlap_share, width: float = 60.0, crowd: int = 20_000) -> DataFrame:
    """clips(video, cand, start, end, score) without those that a kept one covers by more than `share` of their own length.

    Higher scores first, ties by cand. width is about a clip's length. While a block of eight widths holds more than
    `crowd` undecided clips, rounds of local winners thin it out, without pairs and without a block in one task; then
    blocks are decided as a whole, with edges half a block on in the second round and blocks twice as long in each further
    one, so that rounds grow with the logarithm of the longest chain that crosses edges.
    """
    scratch = Scratch(clips.sparkSession)
    keep = scratch.stored
    undecided = keep(_ordered(clips, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")), "undecided")
    kept, blocks = [], 0
    while not undecided.isEmpty():
        most = 0 if blocks else _entered(undecided, 8 * width).groupBy("v", "bin").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most > crowd:
            won, decided = _local_winners(undecided, width, share, keep)
        else:
            wide = 8 * width * 2 ** max(0, blocks - 1)
            won, decided = _block_winners(undecided, wide, blocks % 2 * wide / 2, share, keep)
            blocks += 1
        kept.append(won)
        undecided = keep(undecided.join(decided.distinct(), ["v", "cand"], "left_anti"), "undecided")
    out = clips.limit(0).select(F.struct("video").alias("v"), "cand")
    for more in kept:
        out = out.unionByName(more)
    out = stored(out, "kept")
    scratch.drop()
    return _only(clips, out, "left_semi")


def _alike_in(rows: pa.Table, most: float, at_once: int = 1_000_000) -> pa.Table:
    """v, x, y: pairs of rows(v, cand, slot, low, high, said) with words so alike, one of slot low and one of high; said has the words, joined by blanks."""
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    said = pc.split_pattern(rows.column("said").combine_chunks(), " ")
    said = said.combine_chunks() if isinstance(said, pa.ChunkedArray) else said
    by_size = np.argsort(np.diff(said.offsets.to_numpy()), kind="stable")
    rows, said = rows.select(["v", "cand", "slot"]).take(pa.array(by_size)), said.take(pa.array(by_size))
    n, slot, codes = np.diff(said.offsets.to_numpy()).astype(np.int64), rows.column("slot").to_numpy(), said.flatten().dictionary_encode().indices.to_numpy()
    often = np.bincount(codes)
    rank, many = np.empty(len(often), np.int64), len(often)
    rank[np.argsort(often, kind="stable")] = np.arange(many)
    words = np.repeat(np.arange(len(n)) * many, n) + rank[codes]  # row and word, rare words first
    words.sort()
    first = np.concatenate([[0], np.cumsum(n)])
    of, word = np.divmod(words, many)
    place = np.arange(len(words)) - first[of]
    # Of two sets that are so alike the larger has a shared word among so many first ones, and the smaller, so many of whose words are shared, among fewer.
    larger = np.flatnonzero(place <= (n - np.ceil(n * most - 1e-9))[of])
    smaller = np.flatnonzero(place <= (n - np.ceil(n * 2 * most / (1 + most) - 1e-9))[of])
    met = word[smaller] * len(n) + of[smaller]
    smaller, met = smaller[order := np.argsort(met, kind="stable")], met[order]
    least = np.searchsorted(n, np.ceil(n * most - 1e-9))
    begin, end = (np.searchsorted(met, word[larger] * len(n) + to[of[larger]]) for to in (least, np.arange(len(n))))
    # Words that only one of two has are at least as many as bits that differ.
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * (n * n).sum() / n.sum())), 6, 13))
    bit, times = np.unique(of * bits + (word * 0x9E3779B1 >> 7) % bits, return_counts=True)
    bit = bit[times % 2 == 1]
    cell, starts = np.unique(bit >> 6, return_index=True)
    signs = np.zeros(len(n) * bits // 64, np.uint64)
    signs[cell] = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), starts) if len(bit) else 0
    signs = signs.reshape(len(n), -1)
    found = [np.empty(0, np.int64)]
    for part, count in _parts(end - begin, at_once):
        e = np.repeat(larger[part], count)
        f = smaller[np.repeat(begin[part], count) + _counted(count)]
        x, y = of[e], of[f]
        ok = np.minimum(n[x] - place[e], n[y] - place[f]) * (1 + most) >= (n[x] + n[y]) * most - 1e-6
        if low != high:
            ok &= slot[x] != slot[y]
        x, y = np.divmod(np.unique(x[ok] * len(n) + y[ok]), len(n))
        for near, _ in _parts(np.full(len(x), signs.shape[1]), at_once):
            apart = np.bitwise_count(signs[x[near]] ^ signs[y[near]]).sum(1, dtype=np.int64)
            some = near[apart * (1 + most) <= (n[x[near]] + n[y[near]]) * (1 - most) + 1e-6]
            for sure, count in _parts(n[y[some]], at_once):
                a, b = x[some[sure]], y[some[sure]]
                want = np.repeat(a, count) * many + word[np.repeat(first[b], count) + _counted(count)]
                there = words[np.minimum(np.searchsorted(words, want), len(words) - 1)] == want
                both = np.add.reduceat(there, np.cumsum(count) - count, dtype=np.int64)
                found.append((a * len(n) + b)[both / (n[a] + n[b] - both) > most])
    x, y = np.divmod(np.unique(np.concatenate(found)), len(n))
    return pa.table({"v": rows.column("v").take(pa.array(x)), "x": rows.column("cand").take(pa.array(x)), "y": rows.column("cand").take(pa.array(y))})


def _parts(counts: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the counts above 0, in order, and these counts, in parts of about so many in sum."""
    some = np.flatnonzero(counts)
    for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(counts[some]) // at_once)) + 1):
        if len(part):
            yield part, counts[part]


def _counted(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def alike(sets: DataFrame, most: float, a_slot: int = 2_000_000) -> DataFrame:
    """v, a, b: pairs of sets(v, o, cand, words) of one v whose Jaccard similarity is above `most`, a first by o. Words have no blanks.

    Sets of a v are dealt by size to slots of about so many words. Two slots meet in a task if they hold sizes that can be
    so alike, and a set goes only to those where there are such. There the rare words of each set meet, as many as could be
    missing from the other and one more; places, sizes and bits rule out more, and the rest is compared whole. What is
    shuffled are sets, and pairs only once they are known to be alike.
    """
    sets = sets.withColumn("n", F.size("words")).withColumn("class", F.floor(F.log("n") * 16))
    sizes = sets.groupBy("v", "class").agg(F.sum(F.col("n").cast("long")).alias("all"), F.min("n").alias("least"), F.max("n").alias("most"))
    until = F.sum("all").over(Window.partitionBy("v").orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.withColumn("from", F.floor((until - F.col("all")) / a_slot)).withColumn("to", F.floor((until - 1) / a_slot))
    slots = sizes.select("v", F.explode(F.sequence("from", "to")).alias("other"), "least", "most").groupBy("v", "other").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    rows = sets.join(sizes.select("v", "class", "from", "to"), ["v", "class"]).withColumn("slot", F.col("from") + F.pmod(F.xxhash64("cand"), F.col("to") - F.col("from") + 1))
    rows = rows.join(slots, "v").filter((F.col("most") >= F.col("n") * most - 1e-6) & (F.col("n") >= F.col("least") * most - 1e-6))
    rows = rows.select("v", "cand", "slot", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"), F.array_join("words", " ").alias("said"))
    cand = sets.schema["cand"].dataType
    pairs = T.StructType([sets.schema["v"], T.StructField("x", cand), T.StructField("y", cand)])
    pairs = rows.groupBy("v", "low", "high").applyInArrow(lambda rows: _alike_in(rows, most), pairs)
    own = lambda x: sets.select("v", F.col("cand").alias(x), F.col("o").alias(f"o_{x}"))
    first = F.col("o_x") < F.col("o_y")
    return pairs.join(own("x"), ["v", "x"]).join(own("y"), ["v", "y"]).select("v", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))


def by_text(clips: DataFrame, text: str, most: float = DEFAULTS.text_similarity, rounds: int = 40) -> DataFrame:
    """clips without those whose words are more alike than `most` to a kept one's; wordless clips stay.

    Of clips with equal words the first stands for all. The others' pairs come from a set join (alike()).
    """
    if most >= 1:
        return clips
    scratch = Scratch(clips.sparkSession)
    keep = scratch.stored
    rows = keep(_ordered(clips, F.array_sort(content_words(F.col(text))).alias("words")).filter("size(words) > 0"), "words")
    rows = rows.withColumn("same", F.sha2(F.array_join("words", " "), 256))
    sets = keep(rows.groupBy("v", "same").agg(F.min("o").alias("o"), F.min_by(F.struct("cand", "words"), "o").alias("x")).select("v", "o", "same", "x.cand", "x.words"), "sets")
    firsts = sets.select("v", "same", F.col("o").alias("first"))
    gone = [keep(rows.join(firsts, ["v", "same"]).filter("o > first").select("v", "cand"), "copies")]
    beats = keep(alike(sets, most), "beats")
    while not beats.isEmpty():
        if len(gone) > rounds:
            ends = beats.select("v", F.col("a").alias("cand")).unionByName(beats.select("v", F.col("b").alias("cand"))).distinct()
            left = _folded(sets.join(ends, ["v", "cand"]), ["words"], lambda k, x: jaccard(k["words"], x["words"]) > most)
            gone.append(keep(ends.join(left, ["v", "cand"], "left_anti"), "gone"))
            break
        unbeaten = keep(beats.select("v", "a").distinct().join(beats.select("v", F.col("b").alias("a")).distinct(), ["v", "a"], "left_anti"), "unbeaten")
        gone.append(lost := keep(beats.join(unbeaten, ["v", "a"]).select("v", F.col("b").alias("cand")).distinct(), "gone"))
        rest = beats.join(unbeaten, ["v", "a"], "left_anti")
        for x in "ab":
            rest = rest.join(lost.withColumnRenamed("cand", x), ["v", x], "left_anti")
        beats = keep(rest, "beats")
    out = gone[0]
    for more in gone[1:]:
        out = out.unionByName(more)
    out = stored(out, "gone")
    scratch.drop()
    return _only(clips, out, "left_anti")
