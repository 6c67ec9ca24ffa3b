"""Benchmark decontamination: test items' word windows found in texts by one Aho-Corasick automaton.

Items and texts are read as words: runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. Each
window of WINDOW consecutive words of an item is a key of the automaton, spelled in word numbers; so a text,
whose words are looked up once, is scanned once, whatever the number of windows. Nothing is shuffled.

The automaton goes to all tasks, so its size is checked: items of more than MOST_WORDS words together are
dealt by hash into blocks of about that size, and texts are scanned once a block.
"""

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from highmark.llm._shared import numbered, stored

WINDOW, MOST_WORDS = 10, 200_000
#: All ASCII but digits and letters to spaces, A-Z to a-z.
_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORD_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode().translate(_WORDS).split()


class Automaton:
    """The windows of items (name, texts): finds in a text which words lie in one, and whose items' windows occur."""

    def __init__(self, items: Sequence[tuple[str | None, str]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.names: list[frozenset[str | None]] = []
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for name, text in items:
            own = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text))
            for k in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(own[k : k + window], set()).add(name)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in owners.items():
            self.machine.add_word(key, (len(key), len(self.names)))
            self.names.append(frozenset(names))
        if owners:
            self.machine.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """How many words the text has, the stretches (first word, end) that windows cover, and the items that they are of."""
        own = words(text)
        if not self.names:
            return len(own), [], set()
        number = self.numbers.get
        found = list(self.machine.iter(tuple([number(w, 0) for w in own])))
        if not found:
            return len(own), [], set()
        edges = np.zeros(len(own) + 1, np.int64)
        for last, (length, _) in found:
            edges[last + 1 - length] += 1
            edges[last + 1] -= 1
        turns = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(edges) > 0, [False]]).astype(np.int8)))
        return len(own), [(int(a), int(b)) for a, b in turns.reshape(-1, 2)], set().union(*[self.names[k] for k in {k for _, (_, k) in found}])


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[str | None, str], ...], window: int) -> Automaton:
    """Built once per worker, not per task."""
    return Automaton(items, window)


def offsets(text: str, stretches: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as characters of the original text."""
    at = [m.span() for m in _ORIGINAL.finditer(text)] if stretches else []
    return [(at[a][0], at[b - 1][1]) for a, b in stretches]


_SPANS = "array<struct<first: long, end: long, start: long, stop: long>>"


def _scanned(texts: DataFrame, items: list[tuple[str | None, str]], window: int) -> DataFrame:
    """texts(..., text last) with n_words, spans (of words and of characters) and items instead of the text."""
    held = texts.sparkSession.sparkContext.broadcast(tuple(items))
    at = len(texts.columns) - 1
    more = T.StructType.fromDDL(f"n_words long, spans {_SPANS}, items array<string>")
    kinds = [pa.int64(), pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "end", "start", "stop")])), pa.list_(pa.string())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(held.value, window)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                rows = []
                for x in part.column(at):
                    text = x.as_py() or ""
                    n, stretches, names = machine.scan(text)
                    spans = [{"first": p, "end": q, "start": u, "stop": v} for (p, q), (u, v) in zip(stretches, offsets(text, stretches), strict=True)]
                    rows.append((n, spans, sorted(x for x in names if x is not None)))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *[pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]], [*part.schema.names[:at], *more.names])

    return texts.mapInArrow(scan, T.StructType([*texts.schema.fields[:at], *more.fields]))


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap or touch in words as one."""

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"), last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        joins = (F.size(acc) > 0) & (x["first"] <= last["end"])
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as {_SPANS})"), add)


def find(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", parts: Sequence[str] = ("text",), window: int = WINDOW, most_words: int = MOST_WORDS) -> DataFrame:
    """docs without their text, with leak_words, leak_spans and leak_items: how many words a text has, and what it shares with items.

    parts are the items' columns (a question, an answer); each is a text of its own. A window is `window` words
    in a row, or a part's whole words where it has fewer; parts without words have none. leak_spans are the
    stretches of words covered by windows: words first to end, which are characters start to stop of the original text.
    leak_items are the sorted names, as strings, of items whose windows occur. Rows of one name are one item; a
    null name is in no list, though its windows make spans. Null and empty texts have no words. Repeated rows are
    rows like others; docs' columns of the new names are replaced. Without documents there is no row, without items no span.
    """
    names = ["leak_words", "leak_spans", "leak_items"]
    docs = docs.drop(*names)
    own = [c for c in docs.columns if c != text]
    each = items.select(F.col(item).cast("string").alias("item"), F.inline(F.array(*[F.struct(F.col(c).cast("string").alias("text")) for c in parts]))).filter("text is not null")
    size = each.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(_WORD_SQL))), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // most_words))
    of = lambda k: sorted({(r.item, r.text) for r in each.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()}, key=repr)
    apart = docs.select(*[F.col(f"`{c}`").alias(f"own_{k}") for k, c in enumerate(own)], F.col(f"`{text}`").cast("string").alias("text"))
    back = [F.col(f"own_{k}").alias(c) for k, c in enumerate(own)]
    if blocks == 1:
        found = _scanned(apart, of(0), window)
        return found.select(*back, *[F.col(a).alias(b) for a, b in zip(("n_words", "spans", "items"), names, strict=True)])
    rows = numbered(apart, "row")
    met = stored(_scanned(rows.select("row", "text"), of(0), window), "block-0")
    for k in range(1, blocks):
        met = met.unionByName(stored(_scanned(rows.select("row", "text"), of(k), window).filter("size(spans) > 0"), f"block-{k}"))
    flat = lambda c: F.flatten(F.collect_list(c))
    met = met.groupBy("row").agg(F.max("n_words").alias("leak_words"), _merged(flat("spans")).alias("leak_spans"), F.array_sort(F.array_distinct(flat("items"))).alias("leak_items"))
    return rows.join(met, "row").select(*back, *names)
