"""Token ids of whole texts, made once and stored, with each partition's running positions."""

import gc
import itertools
import json
import re
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from highmark.llm._shared import stored

#: Bytes of texts that are encoded together, at least one text; chunks and pieces that a worker remembers, anew beyond that.
TOGETHER, CHUNKS, PIECES = 1 << 23, 1_000_000, 1_000_000
_SPACED = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: A word and the signs after it: one piece each.
_WORD = re.compile(rb"( ?[A-Za-z]+)([!-/:-@[-`{-~]*)").fullmatch
#: White space to a tokenizer beyond ASCII's: texts that have any are encoded as a whole.
_SEPARATORS = "\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = re.compile(f"[{_SEPARATORS}]")
#: Texts that a split at single spaces wouldn't cut as _SPACED does, or that _WIDE finds.
_ODD = f"[{_SEPARATORS}]|[ \t\n\r\x0b\x0c][ \t\n\r\x0b\x0c]"
#: Chunks of ASCII and of letters for Western Europe, whose classes are beyond doubt, are cut into pieces here.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[ \n\r\t!-~{_LETTERS}]+").fullmatch
#: How the two tokenizers cut such chunks into pieces (fixed by their files).
_CUTS = {
    True: re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+").findall,
    False: re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+").findall,
}
#: The normaliser and the pre-tokenizer that _CUTS stands for (fixed by the same files); vocabularies with others go to the library whole.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_MADE_FOR = {
    True: (None, _BYTE_LEVEL),
    False: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [_WORD_CUT, _BYTE_LEVEL | {"use_regex": False}]},
    ),
}
#: The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _OWN} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _OWN)}
_ID = attrgetter("id")
_encoders: dict[tuple[str, bool], "Encoder"] = {}


def _made(part: object) -> object:
    """What a normaliser or pre-tokenizer of a tokenizer is made of."""
    return None if part is None else json.loads(part.__getstate__())


class _Known(dict[bytes, bytes]):
    """Ids by chunk or piece, found when first asked for."""

    def __init__(self, find: Callable[[bytes], bytes], most: int) -> None:
        self.find, self.most = find, most

    def __missing__(self, key: bytes) -> bytes:
        self[key] = ids = self.find(key)
        return ids

    def shrink(self) -> None:
        if len(self) > self.most:
            self.clear()


class Encoder:
    """Ids as little-endian 32-bit integers, the same as of tokenizers' encode() of the whole text.

    Neither kind of tokenizer joins anything across the start of a run of white space, so texts are cut
    there, and each different chunk is encoded once: plain ones by the tokenizer's model, piece by piece,
    others by all of it. Where no white space follows white space, a plain split at spaces cuts the same.
    A text that holds the string of an added token, in any case of letters, goes to the tokenizer as a
    whole. spaced: chunks keep the white space before them, as byte-level vocabularies need it; otherwise
    white space is dropped and letters are lower-cased, as by tokenizers that end words. A vocabulary whose file cuts
    or changes texts in another way than is known for its kind has all texts encoded as a whole.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        begin = commonprefix(added)
        self.mark = "".join(itertools.takewhile(lambda c: c.lower() == c.upper(), begin))  # what all begin with, in any case of letters
        self.may_hold_added = bool(added)
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else lambda _: None
        self.size = self.tokenizer.get_vocab_size()
        self.model, self.spaced = self.tokenizer.model, spaced
        t = self.tokenizer
        self.is_known = (_made(t.normalizer), _made(t.pre_tokenizer)) == _MADE_FOR[spaced] and t.truncation is None and t.padding is None
        self.pieces, self.chunks, self.after_space = _Known(self.piece, PIECES), _Known(self.chunk, CHUNKS), _Known(self.spaced_chunk, CHUNKS)

    def piece(self, piece: bytes) -> bytes:
        if piece.isalpha():
            raw = piece.decode()
        elif piece[:1] == b" " and piece[1:].isalpha():
            raw = _BYTES[32] + piece[1:].decode()
        else:
            raw = "".join(map(_BYTES.__getitem__, piece))
        return array("I", map(_ID, self.model.tokenize(raw))).tobytes()

    def chunk(self, chunk: bytes) -> bytes:
        if word := _WORD(chunk if self.spaced else chunk.lower()):
            head, tail = word.groups()
            return self.pieces[head] + self.pieces[tail] if tail else self.pieces[head]
        text = chunk.decode()
        if not _PLAIN(text):
            return self.whole(text)
        cuts = _CUTS[self.spaced](text if self.spaced else text.lower())
        return b"".join([self.pieces[x.encode()] for x in cuts])

    def spaced_chunk(self, chunk: bytes) -> bytes:
        """Of a chunk whose line feed, or else the space before it, is the only white space."""
        return self.chunk(chunk if chunk[:1] == b"\n" else b" " + chunk)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        if not self.is_known or self.mark in text and self.added(text) or self.spaced and _WIDE.search(text):
            return self.whole(text)
        raw = text.encode()
        return b"".join(map(self.chunks.__getitem__, _SPACED.findall(raw) if self.spaced else raw.split()))

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, n = self.batch(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])][: len(n)]

    def batch(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has; null texts have none."""
        for known in self.pieces, self.chunks, self.after_space:
            known.shrink()
        texts = texts.fill_null("")
        odd = pc.match_substring(texts, self.mark) if self.is_known and self.may_hold_added else pa.array(np.full(len(texts), not self.is_known))
        if self.spaced:
            odd = pc.or_(odd, pc.match_substring_regex(texts, _ODD))
            words = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        else:
            words = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        at, flat = words.offsets.to_numpy() - words.offsets[0].as_py(), words.flatten().cast(pa.binary()).dictionary_encode()
        rest = self.after_space if self.spaced else self.chunks
        found = [rest[x] for x in flat.dictionary.to_pylist()]
        code = flat.indices.to_numpy().astype(np.int64)  # of each word, in found
        begin = flat.take(pa.array(at[:-1])).to_pylist()
        odd = odd.to_numpy(zero_copy_only=False)
        code[at[:-1]] = len(found) + np.arange(len(texts))  # nothing stands before a text's first word; an odd text has one, empty
        for k, (first, whole) in enumerate(zip(begin, odd.tolist(), strict=True)):
            found.append(self.text(texts[k].as_py()) if whole else self.chunks[first] if first else b"")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        table, base = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(size) - size
        n = size[code]
        ends = np.cumsum(n)
        ids = table[np.repeat(base[code] - (ends - n), n) + np.arange(n.sum())]
        return ids, np.diff(np.concatenate([[0], ends])[at])


def encoder(path: str, spaced: bool) -> Encoder:
    """One for each worker process and vocabulary."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in a row whose texts have up to TOGETHER bytes, or one row whose text has more."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
        yield batch.slice(at, to - at)
        at = to


def tokenised(docs: DataFrame, path: str, end_id: int, spaced: bool, width: int = 4, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """docs(doc_id, text) as a stored table: part int, ahead long, doc_id, n long, ids binary.

    ids: the text's ids and end_id, as little-endian integers of `width` bytes (2 where all ids are below
    65,536, which is checked, or 4); a null text has end_id alone. ahead: the ids that stand before a row in its partition. Null doc_ids and
    repeated rows are rows like others; an empty table gives none.
    """
    schema = "part int, ahead long, doc_id long, n long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, ahead = encoder(path, spaced), TaskContext.get().partitionId(), 0
        if width == 2 and max(own.size - 1, end_id) >= 1 << 16:
            raise ValueError(f"{own.size} ids don't fit in two bytes")
        gc.disable()  # millions of small byte strings, none in a cycle
        for whole in batches:
            for b in _slices(whole):
                text_ids, n = own.batch(b.column(1))
                ids = np.insert(text_ids.astype(f"<u{width}"), np.cumsum(n), end_id)
                n = n + 1
                ends = np.cumsum(n)
                places = np.concatenate([[0], ends * width])
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(places), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(ahead + ends - n), b.column(0).cast(pa.int64()), pa.array(n), raw.cast(pa.binary())], ["part", "ahead", "doc_id", "n", "ids"]
                )
                ahead += int(ends[-1])
        gc.enable()

    return keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema), "ids")


def starts(totals: DataFrame) -> DataFrame:
    """totals(part, n), one row per partition of a table: part, base (the ids of all partitions before).

    The rows, at most one per partition of a stored table, pass through the driver; the result is marked
    for broadcast where there are at most 100,000, a few MB.
    """
    rows, base = [], 0
    for part, n in sorted(map(tuple, totals.select("part", "n").collect())):
        rows.append((part, base))
        base += n
    out = totals.sparkSession.createDataFrame(rows, "part int, base long")
    return F.broadcast(out) if len(rows) <= 100_000 else out
