"""Merkle manifest of a table: a root per group, one root over all groups, and a proof for each row.

Leaves of a group are sorted by ranges, numbered from per-range counts, and gathered in blocks of BLOCK
consecutive leaves as arrays. Array functions collapse a block's levels (sequence and slice deal runs of FAN,
transform hashes them); the blocks' roots are gathered in blocks again until a group has one root. On
the way back down each block gets the siblings above it once, and its leaves add those within. A block
is the most that meets in one task, however large a group is.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from highmark.llm._shared import Scratch, stored

FAN, LEVELS = 16, 3
#: Leaves of one array.
BLOCK = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields: `-` for null, else the length in UTF-8 bytes, `:` and the value."""
    text = [x.cast("string") for x in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text])


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _collapsed(level: Column) -> Column:
    """The digests of a level's runs of FAN."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(_joined(F.slice(level, i * FAN + 1, F.lit(FAN)))))


def _sides(level: Column, at: Column) -> Column:
    """What stands left and right of a place of a level in its run."""
    within = (at % FAN).cast("int")
    return F.struct(_joined(F.slice(level, at - within + 1, within)).alias("left"), _joined(F.slice(level, at + 2, F.lit(FAN - 1) - within)).alias("right"))


def folded(leaf_: Column, path: Column) -> Column:
    """The root to which a leaf leads along its path of siblings."""
    return F.aggregate(path, leaf_, lambda acc, x: digest(x["left"], acc, x["right"]))


def _placed(nodes: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """nodes(tree, ...) with `at`, the place in its tree by `order` from 0, and `n`, the number of its tree's nodes."""
    by = ["tree", *order]
    rows = scratch.stored(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__id", 33).alias("__part")  # such an id has the task's number above, the row's below
    counts = rows.groupBy("tree", part).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("__n").over(of_tree.orderBy("__part")) - F.col("__n")
    counts = scratch.stored(counts.select("tree", "__part", "__first", before.alias("__before"), F.sum("__n").over(of_tree).alias("n")), "counts")
    rows = rows.withColumn("__part", part).join(counts, ["tree", "__part"])
    return rows.withColumn("at", F.col("__before") + F.col("__id") - F.col("__first")).drop("__id", "__part", "__first", "__before")


def _floor(placed: DataFrame, carried: Sequence[str], scratch: Scratch) -> DataFrame:
    """Blocks of placed(tree, n, at, node, carried): tree, n, block, k (levels that collapse here), rows in order, l0 to l2, root."""
    blocks = placed.groupBy("tree", "n", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "node", *carried))).alias("rows"))
    depth = F.when(F.col("n") > 1, F.length(F.hex(F.col("n") - 1))).otherwise(0)  # digits to the base FAN
    blocks = blocks.withColumn("k", F.least(F.lit(LEVELS), depth)).withColumn("l0", F.transform("rows", lambda x: x["node"]))
    for level in range(LEVELS):
        blocks = blocks.withColumn(f"l{level + 1}", F.when(F.col("k") > level, _collapsed(F.col(f"l{level}"))))
    root = F.coalesce(*[F.col(f"l{level}") for level in range(LEVELS, -1, -1)])[0]
    return scratch.stored(blocks.withColumn("root", root).drop(f"l{LEVELS}"), "blocks")


def _up(nodes: DataFrame, order: Sequence[str], carried: Sequence[str], scratch: Scratch) -> list[DataFrame]:
    """The floors of blocks of nodes(tree, node, carried), from the leaves on, until each tree has one block."""
    floors = [_floor(_placed(nodes, order, scratch), carried, scratch)]
    while not (more := floors[-1].filter(F.col("n") > BLOCK)).isEmpty():
        floors.append(_floor(more.select("tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("at"), F.col("root").alias("node")), [], scratch))
    return floors


def _roots(floors: list[DataFrame]) -> DataFrame:
    """tree, root of all trees."""
    done = [f.filter(F.col("n") <= BLOCK).select("tree", "root") for f in floors]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _path(i: Column) -> Column:
    """The path of a block's i-th row: its siblings in the block's levels, then those of the block."""
    levels = F.slice(F.array("l0", "l1", "l2"), F.lit(1), F.col("k"))
    return F.concat(F.transform(levels, lambda level, j: _sides(level, F.floor(i / F.pow(F.lit(FAN), j)).cast("int"))), F.col("path"))


def _down(floors: list[DataFrame], tops: DataFrame, known: Sequence[str], scratch: Scratch) -> DataFrame:
    """The leaves' blocks with `path` (what stands above them) and known: of tops(tree, path, known), from each tree's last block down."""
    paths = None
    for floor in floors[:0:-1]:
        here = _entered(floor, tops, paths)
        rows = F.transform("rows", lambda x, i: F.struct(x["at"].alias("block"), _path(i).alias("path")))
        paths = scratch.stored(here.select("tree", *known, F.inline(rows)), "paths")
    return _entered(floors[0], tops, paths)


def _entered(floor: DataFrame, tops: DataFrame, paths: DataFrame | None) -> DataFrame:
    ends = floor.filter(F.col("n") <= BLOCK).join(tops, "tree")
    return ends if paths is None else ends.unionByName(floor.filter(F.col("n") > BLOCK).join(paths, ["tree", "block"]))


def manifest(docs: DataFrame, group: str, order: str, fields: Sequence[str], now: dict[str, Column] | None = None, with_path: bool = False) -> DataFrame:
    """A row per row of docs: `order`, leaf, subroot, root, proof_sha256, folded_root, verified, and path if asked for.

    A row's leaf is the digest of its fields (leaf()). A group's leaves stand by `order` (null first), equal
    ones by leaf; while there are several nodes, every FAN consecutive ones become the digest of their
    concatenation, the last run of what is left, even of one. The groups' roots, by group (null first, by
    bytes), make the root alike. path holds the siblings left and right of a leaf's way to the root,
    proof_sha256 the digest of them all in that order. folded_root is what the path makes of the row with
    the fields in `now` instead, verified whether that is the root.

    A null group is a group; rows without an `order` and repeated rows are leaves like others (equal rows get
    the proofs of their places). Columns that aren't named don't count. An empty table gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own, changed = leaf(*[F.col(c) for c in fields]), leaf(*[(now or {}).get(c, F.col(c)) for c in fields])
    same = F.lit(True)
    for c, x in (now or {}).items():
        same = same & x.eqNullSafe(F.col(c))
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))
    leaves = docs.select(tree.alias("tree"), F.col(order).alias("key"), own.alias("node"), F.when(~same, changed).alias("now"), F.monotonically_increasing_id().alias("row"))
    floors = _up(scratch.stored(leaves, "leaves"), ["key", "node", "row"], ["key", "now"], scratch)
    groups = scratch.stored(_roots(floors), "groups")
    top = groups.select(F.lit("").alias("tree"), F.when(F.col("tree") != "n", F.substr("tree", F.lit(2))).alias("key"), F.col("tree").alias("of"), F.col("root").alias("node"))
    above = _up(top, ["key"], ["of"], scratch)
    tops = _roots(above).select("tree", F.expr(f"cast(array() as {_PATH})").alias("path"), F.col("root").alias("whole"))
    here = _down(above, tops, ["whole"], scratch)
    tops = here.select("whole", F.inline(F.transform("rows", lambda x, i: F.struct(x["of"].alias("tree"), x["node"].alias("subroot"), _path(i).alias("path")))))
    here = _down(floors, scratch.stored(tops, "tops"), ["whole", "subroot"], scratch)

    def proven(x: Column, i: Column) -> Column:
        of = lambda path: F.struct(
            x["key"].alias("key"), x["node"].alias("leaf"), F.sha2(_joined(F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256).alias("proof_sha256"),
            folded(F.coalesce(x["now"], x["node"]), path).alias("folded_root"), *([path.alias("path")] if with_path else []),
        )
        return F.transform(F.array(_path(i)), of)[0]

    rows = here.select("subroot", F.col("whole").alias("root"), F.inline(F.transform("rows", proven)))
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    out = rows.select(F.col("key").alias(order), *names, (F.col("folded_root") == F.col("root")).alias("verified"), *(["path"] if with_path else []))
    out = stored(out, "manifest")
    scratch.drop()
    return out


def lowered(text: Column) -> Column:
    """A text with A-Z as a-z."""
    return F.translate(text, UPPER, LOWER)
