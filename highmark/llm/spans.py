"""Repeated passages: runs of consecutive sentences that stand in more than one place.

A sentence ends at . ! or ? before white space, or at a line feed. Long ones are cut in two ways: into
pieces of PIECE words, counted from their start, and before the word with the least hash of each NEAR
words in a row, which doesn't depend on where the sentence starts. From each cut of either way, and
back from each, the shortest run of at least RUN pieces with at least WORDS words is hashed (words only,
A-Z lower-cased), so the runs within a passage cover it from its first cut to its last. All documents' hashes meet by hash, which finds the first document of each; the others lose the words of the run.

Most runs stand once, and anchors tell which: of any WORDS words in a row the ANCHOR in a row with the least hash are
one. So where a run stands again, each WORDS words within it have the same anchor there. Anchors meet first, about one for four runs;
only runs of which all these anchors stand twice are hashed and meet. None that repeats is lost by it.

The second way leaves at most NEAR words between cuts, and its cuts differ only near the ends of a passage
that stands between other words. So any passage of 4 * NEAR + WORDS - 2 words (50) shares a run wherever it stands.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from highmark.llm._shared import Scratch, numbered, release, stored
from highmark.llm.words import _P, LOWER, _up_to, mix, range_hashes, word_spans

RUN, WORDS, PIECE = 3, 24, 12
#: Words in a row of which one is a cut.
NEAR = 7
#: Words of an anchor.
ANCHOR = 8
#: Bytes of short texts that are read at a time.
_TOGETHER = 1 << 18
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".!?"]] = True
_CLOSES = np.zeros(256, dtype=bool)
_CLOSES[[*b"\"')]"]] = True


def _near_cuts(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Numbers of the words at sentences' starts, and of the last least one of each NEAR words within a sentence, by hashes with the next word."""
    n, cuts = len(words), begins.copy()
    if n >= NEAR:
        score = words.copy()
        score[:-1] = mix(words[:-1] * _P + words[1:])
        least = np.lib.stride_tricks.sliding_window_view(score[::-1], NEAR).argmin(axis=1)[::-1]
        sentence = np.cumsum(begins)
        cuts[(np.arange(NEAR - 1, n) - least)[sentence[: n - NEAR + 1] == sentence[NEAR - 1 :]]] = True
    return np.flatnonzero(cuts)


def _runs_of(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of the shortest run from each of edges on, and of the shortest up to each."""
    index = np.arange(len(edges))
    to = np.maximum(index + RUN, np.searchsorted(edges, edges + WORDS))
    at = np.minimum(index - RUN, np.searchsorted(edges, edges - WORDS, side="right") - 1)
    on, back = to < len(edges), at >= 0
    return np.append(edges[on], edges[at[back]]), np.append(edges[to[on]], edges[back])


def _sliding(x: np.ndarray, f: np.ufunc, size: int) -> np.ndarray:
    """f over each `size` values in a row, for a minimum or maximum."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def _least(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (never 0) of each ANCHOR words in a row, and the least of those within each WORDS words in a row (0 for words of two texts), from hashes of words and each one's text."""
    n = len(words)
    if n < WORDS:
        return words[:0], words[:0]
    score = words[: n - ANCHOR + 1].copy()
    for k in range(1, ANCHOR):
        score = score * _P + words[k : n - ANCHOR + 1 + k]
    score = mix(score) | np.uint64(1)
    least = _sliding(score, np.minimum, WORDS - ANCHOR + 1)
    least[text_of[: n - WORDS + 1] != text_of[WORDS - 1 :]] = 0
    return score, least


def anchors(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each anchor, from hashes of words and the number of each one's text, ascending."""
    score, least = _least(words, text_of)
    edge = np.zeros(WORDS - ANCHOR if len(score) else 0, dtype=np.uint64)
    at = np.flatnonzero(score == _sliding(np.concatenate([edge, least, edge]), np.maximum, len(edge) + 1))
    return at, score[at]


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Texts in parts of about _TOGETHER bytes or one long text: numbers of the first and of the one past the last, their bytes with a line feed after each text (null: empty), and where each starts."""
    large = [pa.scalar(x, pa.large_string()) for x in ("", "\n")]
    lines = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), large[0]), *large)
    if not len(lines):
        return
    offsets = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset :][: len(lines) + 1]
    data, at = memoryview(lines.buffers()[2]), 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _TOGETHER, side="right")) - 1)
        yield at, to, bytes(data[offsets[at] : offsets[to]]), offsets[at:to] - offsets[at]
        at = to


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different anchors of rows (id, text), with the id, and whether each stands once or more often (2) in its text."""
    for b in batches:
        every = b.column(0).to_numpy()
        for at, to, part, begin in _parts(b.column(1)):
            raw = np.frombuffer(part.translate(LOWER), dtype=np.uint8)
            starts, ends = word_spans(raw)
            text_of = np.searchsorted(begin, starts, side="right") - 1
            first, hashes = anchors(mix(range_hashes(raw, starts, ends)), text_of)
            owner = text_of[first]
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order].view(np.int64)
            new = np.ones(len(order), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
            place = np.flatnonzero(new)
            n = np.minimum(np.diff(np.append(place, len(order))), 2)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[place]), pa.array(every[at:to][owner[place]]), pa.array(n.astype(np.int64))], ["hash", "id", "n"])


def _sentences(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's bytes, starts and ends of its words, which of them begin a sentence, and word offsets of its sentences and pieces (and its end)."""
    raw = np.frombuffer(text.translate(LOWER), dtype=np.uint8)
    starts, ends = word_spans(raw)
    n = len(starts)
    begins = np.ones(n, dtype=bool)
    if n == 0:
        return raw, starts, ends, begins, np.array([0])
    last = raw[ends - 1]
    closed = _ENDS[last] | (_CLOSES[last] & (ends - starts > 1) & _ENDS[raw[np.maximum(ends - 2, 0)]])
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    begins[1:] = closed[:-1] | (feeds[starts[1:]] > feeds[ends[:-1]])
    index = np.arange(n)
    first = np.flatnonzero((index - np.maximum.accumulate(np.where(begins, index, 0))) % PIECE == 0)
    return raw, starts, ends, begins, np.append(first, n)


def runs(text: str, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a text: byte offsets of its words (and its end), word offsets of its sentences (and its end), and first word, end word and hash of each run, or of those of which the anchor of each WORDS words has a hash of common."""
    raw, starts, ends, begins, sentences = _sentences(text.encode())
    n = len(starts)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return np.array([0]), sentences, none, none, none.astype(np.uint64)
    words = mix(range_hashes(raw, starts, ends))
    powers, inverse = _up_to(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers[:n], out=total[1:])
    found = [_runs_of(sentences), _runs_of(np.append(_near_cuts(words, begins), n))]
    both = np.unique(np.concatenate([a * (n + 1) + b for a, b in found]))
    at, to = both // (n + 1), both % (n + 1)
    if common is not None:
        least = _least(words, np.zeros(n, dtype=np.int64))[1]
        own = np.append(0, np.cumsum(~np.isin(least.view(np.int64), common)))
        shared = own[to - WORDS + 1] == own[at]
        at, to = at[shared], to[shared]
    hashes = mix((total[to] - total[at]) * inverse[at] + (to - at).astype(np.uint64) * _P)
    return np.append(starts, len(raw)), sentences, at, to, hashes


def _repeats(hashes: np.ndarray) -> np.ndarray:
    """Which hashes stood before in the same text."""
    again = np.ones(len(hashes), dtype=bool)
    again[np.unique(hashes, return_index=True)[1]] = False
    return again


def clean(docs: DataFrame) -> DataFrame:
    """docs with its columns, text without repeated passages, and n_sentences, n_removed, n_words_removed (long).

    A word goes if a run that covers it also stands earlier: earlier in the same text, or in a document
    with a smaller doc_id. n_sentences counts sentences and pieces of PIECE words, n_removed those of them that lost words. Rows of one doc_id count as one document and don't take each other's
    passages; rows without a doc_id come last, in the order of the scan. Null texts stay null, texts
    without a run (fewer than RUN sentences or WORDS words) stay as they are; a text that is nothing
    but repeats becomes empty. Columns of docs named like the new ones are replaced. An empty table gives no row.

    Rows are numbered in a stored table. Hashes meet in joins of plain rows, so that a passage of many
    documents is split; they are made anew for the second join, as they would take more room than the texts.
    Texts whose anchors all stand once are hashed no further and never move again, and only texts that lose something are cut.
    """
    counts = ["n_sentences", "n_removed", "n_words_removed"]
    docs = docs.drop(*counts)
    own = docs.columns
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = numbered(docs.withColumn("text", F.col("text").cast("string")), "__hm_row", scratch.stored)
    marks = rows.select("__hm_row", "text").mapInArrow(_marks, "hash long, id long, n long")
    common = scratch.stored(marks.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash"), "common")
    release(spark)
    marked = marks.join(common, "hash").groupBy(F.col("id").alias("__hm_row")).agg(F.collect_list("hash").alias("__hm_marks"))
    rows = stored(rows.join(marked, "__hm_row", "left"), "marked")
    scratch.drop()
    release(spark)  # what anchors took goes before runs are written
    several = rows.filter("__hm_marks IS NOT NULL")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1) - F.col("__hm_row")).alias("key")

    def hashed(batches: Iterator[pa.RecordBatch], both: bool) -> Iterator[pa.RecordBatch]:
        """Each hash of a text with its id. One that stands in the text again comes twice, or if not both, once with the complement of the id."""
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                hashes, ids = [], []
                for id_, t, common_here in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                    own_hashes, n = np.unique(runs(t.as_py(), common_here.values.to_numpy())[4], return_counts=True)
                    hashes.append(np.repeat(own_hashes, np.minimum(n, 2)) if both else own_hashes)
                    ids.append(np.full(len(hashes[-1]), id_) if both else np.where(n > 1, ~id_, id_))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64))], ["hash", "id"])

    seen = lambda id_, both: several.select(id_, "text", "__hm_marks").mapInArrow(lambda batches: hashed(batches, both), "hash long, id long")
    firsts = stored(seen(key, True).groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("hash", "first"), "firsts")
    release(spark)  # the first shuffle of hashes goes before the second is written
    again = F.col("id") < 0
    found = seen(F.col("__hm_row"), False).join(firsts, "hash").select(F.when(again, F.bitwise_not("id")).otherwise(F.col("id")).alias("__hm_row"), "hash", "first", again.alias("again"))
    later = found.groupBy("__hm_row").agg(F.collect_list(F.struct("hash", "first")).alias("__hm_runs"), F.max("again").alias("__hm_again"))
    gone = F.transform(F.filter("__hm_runs", lambda r: r["first"] < key), lambda r: r["hash"])
    gone = F.transform(F.array(gone), lambda x: F.when((F.size(x) > 0) | F.col("__hm_again"), x))[0].alias("__hm_gone")
    both = several.join(later, "__hm_row", "left").select(*[F.col(f"`{c}`") for c in own], gone)
    text_at = own.index("text")
    schema = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in docs.schema.fields] + [T.StructField(c, T.LongType()) for c in counts])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts, numbers = [], []
                for text, gone in zip(b.column(text_at).to_pylist(), b.column(len(own)), strict=True):
                    text, now = _without(text, gone.values.to_numpy() if gone.is_valid else None)
                    texts.append(text)
                    numbers.append(now)
                columns = [c if k != text_at else pa.array(texts, pa.string()) for k, c in enumerate(b.columns[:-1])]
                columns += [pa.array([x[k] for x in numbers], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(columns, [*own, *counts])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, dtype=np.int64)
            for at, to, part, begin in _parts(b.column(text_at)):
                _, starts, _, _, sentences = _sentences(part)
                text_of = np.searchsorted(begin, starts[sentences[:-1]], side="right") - 1
                n[at:to] = np.bincount(text_of, minlength=to - at)
            none = pa.array(np.zeros(b.num_rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), none, none], [*own, *counts])

    whole = rows.filter("__hm_marks IS NULL").select(*[F.col(f"`{c}`") for c in own])
    return whole.mapInArrow(kept, schema).union(both.mapInArrow(cut, schema))


def _without(text: str | None, gone: np.ndarray | None) -> tuple[str | None, tuple[int, int, int]]:
    """A text without the runs that it repeats or whose hashes are gone; its sentences, and how many sentences and words lose by it.

    gone is None for a text that neither repeats a run nor has one that is gone.
    """
    if text is None:
        return None, (0, 0, 0)
    if gone is None:
        return text, (len(_sentences(text.encode())[4]) - 1, 0, 0)
    starts, sentences, at, to, hashes = runs(text)
    n = len(starts) - 1
    out = _repeats(hashes) | np.isin(hashes.view(np.int64), gone)
    covered = np.cumsum(np.bincount(at[out], minlength=n + 1) - np.bincount(to[out], minlength=n + 1))[:n] > 0
    raw = text.encode()
    edges = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]])))  # kept stretches start and end
    kept = raw[: starts[0]] + b"".join(raw[starts[a] : starts[b]] for a, b in edges.reshape(-1, 2))
    return kept.decode(), (len(sentences) - 1, int(np.add.reduceat(covered, sentences[:-1], dtype=np.int64).astype(bool).sum()), int(covered.sum()))
