"""Near-duplicate groups: MinHash signatures, a multi-index Hamming join, and exact confirmation.

1. Each document's set of word shingles gets a signature of CHUNKS * SIZE symbols of 16 bits. Documents
   with equal sets are one node from here on, however many they are.
2. Two signatures at a distance of 2 * CHUNKS - 1 symbols or less have, by the pigeonhole principle, a
   chunk with one error or none. So each node is entered, for each chunk, under SIZE keys: the chunk
   without one of its symbols in turn. All pairs within that distance share a key. (A pair with the
   least similarity, 0.85, differs in 14.4 of 96 symbols on average, and shares no key with a
   probability of 3 in a million; more similar pairs, less.)
3. What is asked for are connected groups, so pairs are compared as far as they can still join two:
   first the nodes of a key with its head, in a second round with another head where groups meet in a key,
   at last, in blocks, every pair of a key whose groups still differ. No cap, no list of a group's pairs.
4. Each such pair that set sizes don't rule out is confirmed on full sets.

What a join gets is read from stored tables on both sides, so that a hot key (a group of copies, a hub, a
key of many nodes) is split by adaptive execution. Sets travel with blocks of bounded size only.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from highmark.llm._shared import Scratch, numbered, stored
from highmark.llm.words import mix, shingles

CHUNKS, SIZE = 12, 8
SYMBOLS = CHUNKS * SIZE
#: Nodes of a block in the last comparison, and hashes of their sets together, on average at most.
BLOCK, WEIGHT = 128, 250_000
#: Nodes whose keys one task makes.
NODES = 20_000
_rng = np.random.default_rng(20240502)
_FACTORS = _rng.integers(1 << 31, size=SYMBOLS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_ADDED = _rng.integers(1 << 32, size=SYMBOLS, dtype=np.uint32)[:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each of SYMBOLS minima of a non-empty set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, (x[at : at + 2048] * _FACTORS + _ADDED).min(axis=1))
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2")


def signed(docs: DataFrame, length: int) -> DataFrame:
    """Per row of docs(row, doc_id, text): row, doc_id, n, set_id binary(16), signature; the last two null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, ids, signs = [], [], []
            for text in b.column(2):
                own = shingles(text.as_py() or "", length)
                ns.append(len(own))
                ids.append(np.array([own.sum(), mix(own + np.uint64(1)).sum()], dtype="<u8").tobytes() if len(own) else None)
                signs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ns, pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.binary())], ["row", "doc_id", "n", "set_id", "signature"])

    return docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, "row long, doc_id long, n long, set_id binary, signature binary")


def keys(signature: Column) -> Column:
    """The keys of a signature: each chunk without one symbol, with its place."""
    symbol = lambda k: F.substring(signature, 2 * k + 1, 2)
    return F.array(
        *[F.xxhash64(F.lit(c * SIZE + left_out), *[symbol(c * SIZE + k) for k in range(SIZE) if k != left_out]) for c in range(CHUNKS) for left_out in range(SIZE)]
    )


def components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """node, root (the smallest node reachable) for all nodes of links(a, b).

    Stars are widened and narrowed in turn until each node hangs on one root, in a number of rounds that
    grows with the logarithm of the longest path; each step is stored with `keep`.
    """
    links = keep(_ordered(links).filter("a <> b"), "links")
    while not _are_stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        wide = keep(both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct(), "wide")
        least = keep(wide.groupBy("b").agg(F.min("a").alias("m")), "least")
        narrow = wide.join(least, "b")
        links = keep(narrow.select(F.col("m").alias("a"), "b").unionByName(narrow.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether each node is a root of others or has one root."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.max("up").alias("up"), F.sum("down").alias("down")).filter("down > 1 or (up > 0 and down > 0)").isEmpty()


def _stars(found: DataFrame) -> DataFrame:
    """Links (a, b) that connect what components() found connected."""
    return found.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def _fitting(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b, n_a), as ordered (a, b), those whose set sizes allow percent of the union."""
    sizes = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
    return _ordered(pairs.distinct().join(sizes, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), those whose sets(node, hashes) share at least percent of their union."""
    own = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}"))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                keep.append(_alike(np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8"), percent))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(share, "a long, b long")


def groups(docs: DataFrame, length: int = 5, percent: int = 85) -> DataFrame:
    """A row per row of docs(row, doc_id, text): row, doc_id, n_shingles, component_id, first_row.

    Rows are linked if they share percent of the union of their shingle sets: runs of `length` words,
    A-Z lower-cased, or all words where there are fewer. component_id is the smallest doc_id that can be
    reached, first_row the smallest row number, both counting the row itself. Null, empty and blank
    texts have no shingles and are linked with nothing. A null doc_id takes part but is no component_id unless
    all of a group are null. Rows of one doc_id are rows like others; an empty table gives no row. docs is
    read twice, so its row numbers should be stored (numbered()).
    """
    docs = docs.select("row", "doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    keep = scratch.stored
    rows = keep(signed(docs, length), "signed")
    own = rows.filter("set_id is not null").groupBy("set_id")
    nodes = keep(own.agg(F.min("row").alias("node"), F.min("doc_id").alias("least_doc"), F.first("n").alias("n"), F.first("signature").alias("signature")), "nodes")
    dealt = nodes.repartition(max(1, -(-nodes.count() // NODES)), "node")
    entered = dealt.select("node", "n", F.explode(keys(F.col("signature"))).alias("key"))
    heads = keep(entered.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("entered")).filter("entered > 1").select("key", "head"), "heads")
    shared = keep(entered.join(heads, "key"), "shared")

    pairs = shared.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"), F.col("n").alias("n_a"))
    tried = keep(_fitting(pairs, nodes, percent), "tried")
    texts = docs.join(shared.select(F.col("node").alias("row")).distinct(), "row", "left_semi")
    sets = keep(_hashes(texts, length), "sets")
    found = components(_confirmed(tried, sets, percent), keep)
    # a second head where groups meet in a key
    mixed = _mixed(shared, found, keep)
    if not mixed.isEmpty():
        pairs = mixed.filter("root <> large").select(F.col("node").alias("a"), F.col("other").alias("b"), F.col("n").alias("n_a"))
        pairs = keep(_fitting(pairs, nodes, percent).join(tried, ["a", "b"], "left_anti"), "tried")
        found = components(_stars(found).unionByName(_confirmed(pairs, sets, percent)), keep)
        # all that can still join two groups
        mixed = _mixed(mixed.select("key", "node", "n"), found, keep)
        if not mixed.isEmpty():
            found = components(_stars(found).unionByName(_fields(mixed, sets, percent, keep)), keep)

    placed = keep(nodes.select("set_id", "node", "least_doc").join(found, "node", "left").select("set_id", F.coalesce("root", "node").alias("first_row"), "least_doc"), "placed")
    least = keep(placed.groupBy("first_row").agg(F.min("least_doc").alias("component_id")), "least")
    labels = keep(placed.join(least, "first_row").select("set_id", "first_row", "component_id"), "labels")
    mine = ["row", "doc_id", F.col("n").alias("n_shingles")]
    alone = rows.filter("set_id is null").select(*mine, F.col("doc_id").alias("component_id"), F.col("row").alias("first_row"))
    out = stored(rows.join(labels, "set_id").select(*mine, "component_id", "first_row").unionByName(alone), "groups")
    scratch.drop()
    return out


def _mixed(shared: DataFrame, found: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """key, node, n, root, large, other: the entries of keys in which groups meet, the key's largest group and a node of it."""
    marked = keep(shared.select("key", "node", "n").join(found, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "marked")
    roots = marked.groupBy("key", "root").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key")).alias("other"))
    keys_ = roots.groupBy("key").agg(F.max_by(F.struct("root", "other"), F.struct("n", "root")).alias("large"), F.count("*").alias("n")).filter("n > 1")
    keys_ = keep(keys_.select("key", F.col("large.root").alias("large"), F.col("large.other").alias("other")), "keys")
    return keep(marked.join(keys_, "key"), "mixed")


def _fields(mixed: DataFrame, sets: DataFrame, percent: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The links (a, b) between groups that meet in a key.

    Nodes outside a key's largest group are compared with those of that group that share a key with any of them, and with all others that
    stand outside of it. That covers each pair of the key whose groups differ. Both sides go in blocks of about
    BLOCK nodes; pairs of blocks are made from their numbers, and pairs of nodes exist only within a comparison of two blocks.
    """
    outside = keep(mixed.filter("root <> large").select(F.col("large").alias("field"), "node").distinct().withColumn("side", F.lit(1)), "outside")
    inside = mixed.filter("root = large").select(F.col("large").alias("field"), "node").distinct()
    both = keep(outside.unionByName(inside.withColumn("side", F.lit(0))).join(sets, "node"), "both")
    sizes = keep(both.groupBy("field", "side").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("hashes")) / (8 * WEIGHT))).alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    blocks = keep(both.join(sizes, ["field", "side"]).select("field", "side", block, "node", "hashes").groupBy("field", "side", "block").agg(F.collect_list(F.struct("node", "hashes")).alias("rows")), "blocks")
    numbers = blocks.select("field", "side", "block")
    met = keep(numbers.filter("side = 1").select("field", F.col("block").alias("l_block")).join(numbers, "field").filter("side = 0 or block >= l_block"), "met")
    left = blocks.filter("side = 1").select("field", F.col("block").alias("l_block"), F.col("rows").alias("l_rows"))
    met = met.join(left, ["field", "l_block"]).join(blocks, ["field", "side", "block"]).select("l_rows", "rows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(rows: pa.StructArray) -> tuple[np.ndarray, list[np.ndarray]]:
            return rows.field(0).to_numpy(), [np.frombuffer(h.as_buffer(), dtype="<u8") for h in rows.field(1)]

        for b in batches:
            for at in range(b.num_rows):
                (left, l_sets), (right, r_sets) = (parts(c[at].values) for c in b.columns)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _linked(left, l_sets, right, r_sets, percent)], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def _linked(left: np.ndarray, l_sets: list[np.ndarray], right: np.ndarray, r_sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of two blocks of nodes whose sets share at least percent of their union: all sets of the right are looked up at once."""
    r_n = np.array([len(x) for x in r_sets])
    hashes = np.concatenate(r_sets)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], np.repeat(np.arange(len(r_sets)), r_n)[order]
    a, b = [], []
    for x, own in zip(left.tolist(), l_sets, strict=True):
        low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(r_sets))
        found = np.flatnonzero((both * 100 >= percent * (len(own) + r_n - both)) & (right != x))
        a.append(np.full(len(found), x))
        b.append(right[found])
    return np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)


def _alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least percent of their union."""
    at = np.searchsorted(p, q)
    both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _hashes(docs: DataFrame, length: int) -> DataFrame:
    """node (the row), hashes: the sorted set of docs(row, doc_id, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                own = [shingles(t.as_py() or "", length).astype("<u8").tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["node", "hashes"])

    return docs.select("row", F.col("text").cast("string")).mapInArrow(of, "node long, hashes binary")


def near_duplicates(docs: DataFrame, length: int = 5, percent: int = 85) -> DataFrame:
    """groups() of docs(doc_id, text), any rows."""
    scratch = Scratch(docs.sparkSession)
    out = groups(numbered(docs.select("doc_id", "text"), "row", scratch.stored), length, percent)
    scratch.drop()
    return out


def deduplicate(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with its columns, one of each group: that with the smallest doc_id (null last), then the first row.

    Null, empty and blank texts are a group each, so all such rows stay. An empty table gives none.
    """
    own = docs.columns
    rows = numbered(docs, "__hm_row")
    found = groups(rows.select(F.col("__hm_row").alias("row"), "doc_id", "text"), length, percent)
    best = stored(found.groupBy("first_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")).select(F.col("best.row").alias("__hm_row")), "best")
    return rows.join(best, "__hm_row", "left_semi").select(*[F.col(f"`{c}`") for c in own])
