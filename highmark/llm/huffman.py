"""Token ids on disk, in canonical Huffman codes of limited length made from the counts of all documents.

A folder holds `codes`, the length of each id's code, and `blocks`, rows of about BLOCK ids that can be
decoded by themselves: the documents in a block with their numbers of ids, the bits (codes from the
highest bit on), and the bit offset of every STEP-th id. Decoding follows all stretches between
such offsets at once, each step a lookup of the next bits in one table.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from highmark.llm._shared import Scratch, shared_dir
from highmark.llm.tokens import starts, tokenised

BLOCK, STEP, LONGEST = 65_536, 256, 16
_BLOCKS = "part int, ahead long, n_ids long, doc_ids array<long>, doc_ns array<long>, bits binary, offsets array<long>"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The code lengths, at most `longest`, that make the fewest bits for positive counts.

    Package-merge: `longest` times, packages of two neighbours are merged into the sorted counts; an id's
    length is how often it is among the cheapest 2n - 2 of the last list, followed down to its parts.
    The limit is raised where it can't tell so many ids apart. A lone id has a code of one bit.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.uint8)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    merged, kinds = leaves, []
    for _ in range(max(longest, int(np.ceil(np.log2(n))))):
        kinds.append(merged)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        kinds[-1] = place < n
        merged = both[place]
    kinds = [np.ones(n, dtype=bool), *kinds[:-1]]
    lengths, take = np.zeros(n, dtype=np.uint8), 2 * n - 2
    for is_leaf in reversed(kinds):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (min(take, len(is_leaf)) - own)
    out = np.empty(n, dtype=np.uint8)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes: shorter first, then smaller ids. Without any id, 0 has a code that nothing uses."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        if not len(ids):
            ids, lengths = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.longest = int(self.lengths.max(initial=1))
        width = 1 << (self.longest - self.lengths)  # entries of the table that begin with the code
        first = np.cumsum(width) - width
        self.table = np.repeat(np.arange(len(self.ids), dtype=np.int32), width)
        self.table = np.concatenate([self.table, np.zeros((1 << self.longest) - len(self.table), dtype=np.int32)])
        size = int(self.ids.max(initial=0)) + 1
        self.code_of, self.len_of = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        self.code_of[self.ids] = first >> (self.longest - self.lengths)
        self.len_of[self.ids] = self.lengths
        self.sym, self.sym_len = self.ids[self.table], self.lengths[self.table]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ids and the offset of every STEP-th: neighbouring codes are joined to up to 64 bits, then put in place."""
        code, n = self.code_of[ids], self.len_of[ids]
        ends = np.cumsum(n)
        offsets, total = (ends - n)[::STEP], int(ends[-1]) if len(ends) else 0
        for _ in range(2 if self.longest <= 16 else 1):
            if len(code) % 2:
                code, n = np.append(code, np.uint64(0)), np.append(n, 0)
            code, n = (code[::2] << n[1::2].astype(np.uint64)) | code[1::2], n[::2] + n[1::2]
        code, n = code[n > 0], n[n > 0]
        at = np.cumsum(n) - n
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        code = code << (64 - n).astype(np.uint64)
        out = np.zeros(total // 64 + 2, dtype=np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(first):
            out[word[first]] = np.bitwise_or.reduceat(code >> shift, first)
            out[word[first] + 1] |= np.bitwise_or.reduceat(np.where(shift > 0, code << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0)), first)
        return out.astype(">u8").tobytes()[: (total + 7) // 8], offsets

    def decode(self, bits: list[bytes], offsets: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """The ids of several blocks: all stretches take a step at a time."""
        base = np.cumsum([0, *(len(b) for b in bits)])[:-1]
        raw = np.frombuffer(b"".join(bits) + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
        at = np.concatenate([o + 8 * x for o, x in zip(offsets, base, strict=True)]).astype(np.int64)
        left = np.concatenate([np.minimum(STEP, n - STEP * np.arange(len(o))) for o, n in zip(offsets, counts, strict=True)])
        wide = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]
        out = np.zeros((len(at), STEP), dtype=np.uint32)
        mask = np.uint64((1 << self.longest) - 1)
        for k in range(min(STEP, int(left.max(initial=0)))):
            own = (wide[at >> 3] >> (40 - self.longest - (at & 7)).astype(np.uint64)) & mask
            out[:, k] = self.sym[own]
            at = np.minimum(at + np.where(k < left, self.sym_len[own], 0), 8 * (len(wide) - 1))
        flat = out[np.arange(STEP) < left[:, None]]
        return np.split(flat, np.cumsum(counts)[:-1])


def id_counts(ids: DataFrame, width: int) -> DataFrame:
    """id long, n long over all rows' ids: partitions count for themselves, then the counts are summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                own = np.bincount(np.frombuffer(x.as_buffer(), dtype=f"<u{width}"))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, spaced: bool = True, width: int = 2) -> None:
    """Encodes docs(doc_id, text) into folder, documents in ascending order of doc_id, null first.

    Null texts are empty: their end id alone. Rows of one doc_id stand together, in their order as read; however many
    there are (null ids, say), they are dealt over tasks. A document isn't cut
    between blocks, so a block holds BLOCK ids and at most one document more. The code lengths, one per
    id of the vocabulary, are made on the driver. width: bytes of an id between the passes, 2 for
    vocabularies of up to 65,536 ids (others are refused), else 4. An empty table gives files without documents.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    ids = tokenised(docs, path, end_id, spaced, width, scratch.stored)
    counts = sorted(map(tuple, id_counts(ids, width).collect()))
    used, n = (np.array(x, dtype=np.int64) for x in zip(*counts, strict=True)) if counts else (np.zeros(0, dtype=np.int64),) * 2
    lengths = code_lengths(n)
    spark.createDataFrame([*zip(used.tolist(), lengths.tolist(), strict=True)], "id long, length int").coalesce(1).write.parquet(f"{folder}/codes")
    codes = Codes(used, lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ahead = TaskContext.get().partitionId(), 0
        docs_in, ns, held, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            bits, offsets = codes.encode(np.concatenate(held))
            row = {"part": part, "ahead": ahead, "n_ids": total, "doc_ids": docs_in, "doc_ns": ns, "bits": bits, "offsets": offsets.tolist()}
            return pa.RecordBatch.from_pylist([row], schema=_arrow)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), dtype=f"<u{width}")
                docs_in.append(doc)
                ns.append(len(own))
                held.append(own.copy())
                total += len(own)
                if total >= BLOCK:
                    yield block()
                    ahead += total
                    docs_in, ns, held, total = [], [], [], 0
        if held:
            yield block()

    place = ["doc_id", "part", "ahead"]
    ordered = ids.select(*place, "ids").repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "ids")
    ordered.mapInArrow(encode, _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    scratch.drop()


_arrow = pa.schema(
    [("part", pa.int32()), ("ahead", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ns", pa.list_(pa.int64())), ("bits", pa.binary()), ("offsets", pa.list_(pa.int64()))]
)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document of a written folder: doc_id, start (ids of all documents before it), n_tokens, ids binary.

    Null and repeated doc_ids come back as they were written; a folder without documents gives no row.
    """
    rows = spark.read.schema("id long, length int").parquet(f"{folder}/codes").collect()
    codes = Codes(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                b = {k: v.to_pylist() for k, v in zip(whole.schema.names, whole.slice(at, 16).columns, strict=True)}
                found = codes.decode(b["bits"], [np.array(o, dtype=np.int64) for o in b["offsets"]], b["n_ids"])
                doc_ids, places, ns, ids = [], [], [], []
                for k, all_ids in enumerate(found):
                    ends = np.cumsum(b["doc_ns"][k])
                    doc_ids += b["doc_ids"][k]
                    ns += b["doc_ns"][k]
                    places += (b["ahead"][k] + ends - b["doc_ns"][k]).tolist()
                    ids += [x.astype("<u4").tobytes() for x in np.split(all_ids, ends[:-1])]
                parts = [p for p, d in zip(b["part"], b["doc_ids"], strict=True) for _ in d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(places, pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, pa.binary())], ["part", "doc_id", "place", "n_tokens", "ids"]
                )

    docs = blocks.mapInArrow(decode, "part int, doc_id long, place long, n_tokens long, ids binary")
    base = starts(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")))
    return docs.join(base, "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) written to a new shared folder and read back, each row once; see write() and read() for odd rows."""
    folder = shared_dir(docs.sparkSession)
    write(docs, folder, path, end_id)
    return read(docs.sparkSession, folder)
