"""Language of words and documents by a linear-chain conditional random field.

A word's score for a language is the sum of weights of its features: the word itself where it is in the
lexicon, its prefixes and suffixes of 2 and 3 letters, and its 2- and 3-letter n-grams. Learned transition
weights link neighbours, and forward-backward gives each word's chances in its context, also where a text
switches between languages. A document's language is the one with the highest mean chance.

The model is fitted in one task on a bounded sample of all labelled windows of text (SAMPLE of each
language, less where TOTAL would be passed). Prediction goes over whole texts, a chain each, in numpy operations over all words of a batch at once.
"""

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from highmark.llm.words import _P, _up_to, mix

#: Windows for fitting per language, of all languages together (but LEAST of each), and characters of a window.
SAMPLE, TOTAL, LEAST, WINDOW = 500, 32_000, 20, 2_000
#: Bits of the feature table's index, and how often a word is seen at least to be in the lexicon.
BITS, SEEN = 17, 3
#: Bytes of texts that are labelled together.
TOGETHER = 300_000
UNKNOWN = "und"
_LEXICON_BITS = 16
_tables: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters() -> list[np.ndarray]:
    """For each code point, whether it is a letter, and its lower case."""
    if not _tables:
        points = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
        _tables.append(np.array([c.isalpha() for c in points]))
        _tables.append(np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in points], dtype=np.uint32))
    return _tables


@dataclass
class Words:
    """The words of several texts: hashes of each, of its affixes, and of the n-grams at each letter."""

    text: np.ndarray  # of each word
    starts: np.ndarray
    ends: np.ndarray
    whole: np.ndarray
    affixes: list[np.ndarray]
    grams: list[tuple[np.ndarray, np.ndarray]]  # hash at each character, and whether the gram lies in a word


def find_words(texts: list[str]) -> Words:
    """Words are runs of letters, lower-cased."""
    is_letter, lower = _letters()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    mask = is_letter[points]
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.array([len(t) + 1 for t in texts])
    text = np.searchsorted(np.cumsum(lengths), starts, side="right")
    own = mix(lower[points].astype(np.uint64) + np.uint64(1))
    n = len(points)
    powers, inverse = _up_to(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(own * powers[:n], out=total[1:])
    of = lambda a, b, seed: mix((total[b] - total[a]) * inverse[a] + np.uint64(seed << 32))
    affixes = [of(starts, np.minimum(starts + k, ends), k) for k in (2, 3)] + [of(np.maximum(ends - k, starts), ends, 10 + k) for k in (2, 3)]
    grams = []
    for k in (2, 3):
        if n >= k:
            hashed, inside = own[: n - k + 1].copy(), mask[: n - k + 1].copy()
            for j in range(1, k):
                hashed = hashed * _P + own[j : n - k + 1 + j]
                inside &= mask[j : n - k + 1 + j]
            grams.append((hashed ^ (hashed >> np.uint64(29)), inside))
    return Words(text, starts, ends, of(starts, ends, 0), affixes, grams)


def _slot(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # 2 ** BITS by languages
    lexicon: np.ndarray  # hashes by slot
    lexicon_weights: np.ndarray
    moves: np.ndarray  # from, to: log weights
    first: np.ndarray

    def scores(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.starts), len(self.languages)), dtype=np.float32)
        bits = len(self.weights).bit_length() - 1
        for a in w.affixes:
            out += self.weights[_slot(a, bits)]
        for hashed, inside in w.grams:
            at = np.flatnonzero(inside)
            word = np.searchsorted(w.ends, at, side="right")
            slots = _slot(hashed[at], bits)
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(word, weights=self.weights[slots, k], minlength=len(out))
        slots = _slot(w.whole, _LEXICON_BITS)
        out += np.where((self.lexicon[slots] == w.whole)[:, None], self.lexicon_weights[slots], 0)
        return out

    def chances(self, scores: np.ndarray, chain: np.ndarray) -> np.ndarray:
        """Of each word by forward-backward. chain: numbers of words, in order."""
        return chances_in_pieces(scores, chain, self.moves, self.first)


def chances_in_pieces(scores: np.ndarray, chain: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word's chances by forward-backward over whole chains, the same as forward_backward() gives.

    Chains are cut in pieces, and all pieces take a step at a time. What a piece does to a forward or
    backward message is a matrix, the product of its words'; with these, messages pass from piece to piece.
    """
    k, longest = scores.shape[1], int(chain.max(initial=0))
    if longest == 0:
        return np.zeros((0, k))
    size = max(16, int(np.ceil(np.sqrt(longest))))
    pieces = -(-chain // size)  # of each chain
    n, top = int(pieces.sum()), int(pieces.max())
    of = np.repeat(np.arange(len(chain)), pieces)
    nth = np.arange(n) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(chain) - chain, pieces) + nth * size
    length = np.minimum(size, chain[of] - nth * size)
    order = np.argsort(-length, kind="stable")  # whole pieces first, so that a step takes the first of them
    start, live = start[order], [int(np.searchsorted(-length[order], -t, side="left")) for t in range(size)]
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    a = np.exp(moves)
    through = np.broadcast_to(np.eye(k), (n, k, k)) * e[start][:, None, :]
    for t in range(1, size):
        m = live[t]
        if not m:
            break
        now = (through[:m].reshape(-1, k) @ a).reshape(m, k, k) * e[start[:m] + t][:, None, :]
        through[:m] = now / now.max(axis=(1, 2), keepdims=True)
    # messages into each piece: from the left before its first word, from the right behind its last
    come, back = np.empty((n, k)), np.ones((n, k))
    begin = np.cumsum(pieces) - pieces
    by_pieces = np.argsort(-pieces, kind="stable")
    chains = [int(np.searchsorted(-pieces[by_pieces], -j, side="left")) for j in range(top)]
    message = np.broadcast_to(np.exp(first), (len(chain), k))
    for j in range(top):
        at = place[begin[by_pieces[: chains[j]]] + j]
        come[at] = message[: chains[j]]
        if j + 1 < top:
            message = np.einsum("ni,nij->nj", come[at[: chains[j + 1]]], through[at[: chains[j + 1]]]) @ a
            message /= message.sum(axis=1, keepdims=True)
    for j in range(top - 1, 0, -1):
        at = place[begin[by_pieces[: chains[j]]] + j]
        message = np.einsum("nij,nj->ni", through[at], back[at]) @ a.T
        back[place[begin[by_pieces[: chains[j]]] + j - 1]] = message / message.sum(axis=1, keepdims=True)
    forward = np.empty_like(e)
    now = come * e[start]
    forward[start] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, size):
        if not (m := live[t]):
            break
        now = (forward[start[:m] + t - 1] @ a) * e[start[:m] + t]
        forward[start[:m] + t] = now / now.sum(axis=1, keepdims=True)
    out = np.empty_like(e)
    for t in range(size - 1, -1, -1):
        if not (m := live[t]):
            continue
        at = start[:m] + t
        if t + 1 < size and live[t + 1]:
            ahead = (e[at[: live[t + 1]] + 1] * back[: live[t + 1]]) @ a.T
            back[: live[t + 1]] = ahead / ahead.sum(axis=1, keepdims=True)
        out[at] = forward[at] * back[:m]
    return out / out.sum(axis=1, keepdims=True)


def forward_backward(scores: np.ndarray, chain: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's chances, the expected moves and the expected first labels, over all chains a step at a time."""
    order = np.argsort(-chain, kind="stable")
    begins = (np.cumsum(chain) - chain)[order]
    sizes = chain[order]
    k, steps = scores.shape[1], int(sizes.max(initial=0))
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    a, f = np.exp(moves), np.exp(first)
    forward = np.empty_like(e)
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # chains longer than t
    now = None
    for t in range(steps):
        at = begins[: live[t]] + t
        now = e[at] * (f if t == 0 else now[: live[t]] @ a)
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    behind, moved = np.empty_like(e), np.zeros((k, k))
    back = np.ones((live[0] if steps else 0, k))
    for t in range(steps - 1, -1, -1):
        at = begins[: live[t]] + t
        if t + 1 < steps and live[t + 1]:
            m = live[t + 1]
            ahead = e[begins[:m] + t + 1] * back[:m]
            moved += forward[at[:m]].T @ (ahead / ((forward[at[:m]] @ a) * ahead).sum(axis=1, keepdims=True)) * a
            b = ahead @ a.T
            back[:m] = b / b.sum(axis=1, keepdims=True)
        behind[at] = back[: live[t]]
    out = forward * behind
    out /= out.sum(axis=1, keepdims=True)
    return out, moved, out[begins].sum(axis=0) if steps else np.zeros(k)


def _features(w: Words, first_text: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its text and hash and how many features it has, and the slots of all words' features in order."""
    n = len(w.starts)
    words, slots = [np.arange(n)] * len(w.affixes), [_slot(a, bits) for a in w.affixes]
    for hashed, inside in w.grams:
        at = np.flatnonzero(inside)
        words.append(np.searchsorted(w.ends, at, side="right"))
        slots.append(_slot(hashed[at], bits))
    of = np.concatenate(words)
    return w.text + first_text, w.whole, np.bincount(of, minlength=n), np.concatenate(slots)[np.argsort(of, kind="stable")].astype(np.int32)


def fit(samples: list[tuple[str, str]], rounds: int = 6, seed: int = 1) -> Model:
    """A model of (language, text) samples.

    Stretches of the samples' words are joined at random into chains that switch languages, so that
    transitions are learned too. The log-likelihood's gradient (what was seen less what is expected) is followed
    in steps scaled by the past gradients of each weight. Beyond 64 languages the feature table gets shorter, so that it keeps its size.
    """
    languages = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    k = max(1, len(languages))
    model = Model(languages or [UNKNOWN], np.zeros((1 << max(10, BITS - max(0, (k - 1).bit_length() - 6)), k), dtype=np.float32), np.zeros(1 << _LEXICON_BITS, dtype=np.uint64), np.zeros((1 << _LEXICON_BITS, k), dtype=np.float32), np.zeros((k, k)), np.zeros(k))
    bits = len(model.weights).bit_length() - 1
    parts = [_features(find_words([t for _, t in samples[at : at + 64]]), at, bits) for at in range(0, len(samples), 64)]
    text, whole, sizes, slots = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 4
    n = len(text)
    if n == 0:
        return model
    labels = np.array([languages.index(lang) for lang, _ in samples], dtype=np.int64)[text]
    bounds = np.append(0, np.cumsum(sizes))
    known, counts = np.unique(whole, return_counts=True)
    known, counts = known[counts >= SEEN], counts[counts >= SEEN]
    known = known[np.argsort(counts, kind="stable")]
    model.lexicon[_slot(known, _LEXICON_BITS)] = known  # the more frequent one has a shared slot
    word_slot = _slot(whole, _LEXICON_BITS)
    in_lexicon = model.lexicon[word_slot] == whole
    # stretches of up to 16 words of one sample, shuffled; chains take a few each
    stretch = np.flatnonzero(np.diff(text, prepend=-1) | (np.arange(n) % 16 == 0))
    past, past_lexicon, past_moves, past_first = (np.full(x.shape, 1e-2) for x in (model.weights, model.lexicon_weights, model.moves, model.first))
    ends = np.append(stretch[1:], n)
    for turn in range(rounds):
        order = rng.permutation(len(stretch))
        for batch in np.array_split(order, max(1, len(order) // 256)):
            at = np.concatenate([np.arange(stretch[s], ends[s]) for s in batch])
            sizes = np.array([chunk.sum() for chunk in np.array_split(ends[batch] - stretch[batch], max(1, len(batch) // 4))])
            row = np.concatenate([np.arange(bounds[x], bounds[x + 1]) for x in at])
            of = np.repeat(np.arange(len(at)), bounds[at + 1] - bounds[at])
            used = slots[row]
            scores = np.stack([np.bincount(of, weights=model.weights[used, c], minlength=len(at)) for c in range(k)], axis=1)
            scores += np.where(in_lexicon[at][:, None], model.lexicon_weights[word_slot[at]], 0)
            chances, moved, first = forward_backward(scores, sizes, model.moves, model.first)
            gap = -chances
            gap[np.arange(len(at)), labels[at]] += 1
            begin = np.zeros(len(at), dtype=bool)
            begin[np.cumsum(sizes) - sizes] = True
            follows = np.flatnonzero(~begin)
            seen = np.zeros((k, k))
            np.add.at(seen, (labels[at][follows - 1], labels[at][follows]), 1)
            touched, inverse = np.unique(used, return_inverse=True)
            step = np.stack([np.bincount(inverse, weights=gap[of, c], minlength=len(touched)) for c in range(k)], axis=1) / 16 - 1e-4 * model.weights[touched]
            past[touched] += step**2
            model.weights[touched] += (0.1 * step / np.sqrt(past[touched])).astype(np.float32)
            mine = np.flatnonzero(in_lexicon[at])
            touched, inverse = np.unique(word_slot[at][mine], return_inverse=True)
            step = np.stack([np.bincount(inverse, weights=gap[mine, c], minlength=len(touched)) for c in range(k)], axis=1) / 16 - 1e-4 * model.lexicon_weights[touched]
            past_lexicon[touched] += step**2
            model.lexicon_weights[touched] += (0.1 * step / np.sqrt(past_lexicon[touched])).astype(np.float32)
            for weights, old, step in ((model.moves, past_moves, (seen - moved) / len(sizes)), (model.first, past_first, (np.bincount(labels[at][begin], minlength=k) - first) / len(sizes))):
                old += step**2
                weights += 0.1 * step / np.sqrt(old)
    return model


def learn(docs: DataFrame) -> Model:
    """A model of docs(doc_id, text, lang): rows with text and lang that aren't held out.

    Their whole texts are cut in windows of WINDOW characters, and of each language's windows about SAMPLE, SAMPLE
    at most, are drawn by a hash of doc_id and the window's number, so every part of every text has the
    same chance. Only the sample reaches the task that fits, and only the model the driver. Every language is
    learned: beyond TOTAL / SAMPLE languages, each has fewer windows. Rows without a doc_id teach
    nothing, nor do rows with a null text or lang; repeated rows are drawn together. Without any window the model knows no language.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    windows = F.greatest(F.ceil(F.length("text") / WINDOW), F.lit(1))
    counts = rows.groupBy("lang").agg(F.sum(windows).alias("n")).collect()
    if not counts:
        return fit([])
    most = max(LEAST, min(SAMPLE, TOTAL // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, 1.25 * most / r["n"]) * (1 << 30)))])
    draw = lambda i: F.pmod(F.xxhash64("doc_id", i, F.lit(11)), F.lit(1 << 30))
    chosen = F.filter(F.sequence(F.lit(1), windows.cast("int")), lambda i: draw(i) < share[F.col("lang")])
    drawn = F.explode(F.transform(chosen, lambda i: F.struct(draw(i).alias("draw"), F.substring("text", (i - 1) * WINDOW + 1, F.lit(WINDOW)).alias("text"))))
    drawn = rows.select("lang", drawn.alias("w")).select("w.draw", "lang", "w.text")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: Counter = Counter()
        samples = []
        for draw, lang, text in sorted((r["draw"], r["lang"], r["text"]) for b in batches for r in b.to_pylist()):
            taken[lang] += 1
            if taken[lang] <= most:
                samples.append((lang, text))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(samples))], pa.binary())], ["model"])

    made = drawn.repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([])


def _chains(text: np.ndarray) -> np.ndarray:
    """Numbers of words of chains, in order: one chain for each text that has words."""
    return np.diff(np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text)))


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language and mean chance of each text."""
    w = find_words(texts)
    chances = model.chances(model.scores(w), _chains(w.text))
    total = np.stack([np.bincount(w.text, weights=chances[:, c], minlength=len(texts)) for c in range(chances.shape[1])], axis=1)
    n = np.bincount(w.text, minlength=len(texts))
    mean = total / np.maximum(n, 1)[:, None]
    best = mean.argmax(axis=1)
    return [model.languages[b] if x else UNKNOWN for b, x in zip(best, n, strict=True)], np.where(n > 0, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Stretches of a text whose words have one language: start, end (characters), language."""
    w = find_words([text])
    best = model.chances(model.scores(w), _chains(w.text)).argmax(axis=1)
    out: list[tuple[int, int, str]] = []
    for s, e, b in zip(w.starts.tolist(), w.ends.tolist(), best.tolist(), strict=True):
        if out and out[-1][2] == model.languages[b]:
            out[-1] = out[-1][0], e, out[-1][2]
        else:
            out.append((s, e, model.languages[b]))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with its columns, lang_pred string and score double (which replace columns of these names).

    Only text is looked at. Null texts and texts without a letter are UNKNOWN with score 0. Of
    languages with equal chances the first by code point is taken. Texts go whole, a batch of them at a time.
    """
    docs = docs.drop("lang_pred", "score")
    own = docs.columns
    at = own.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy())
            start = 0
            while start < whole.num_rows:  # some hundred thousand characters at a time
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + TOGETHER, side="right")))
                langs, scores = predict(model, [t or "" for t in whole.column(at).slice(start, end - start).to_pylist()])
                yield pa.RecordBatch.from_arrays([*whole.slice(start, end - start).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*own, "lang_pred", "score"])
                start = end

    return docs.mapInArrow(label, schema)
