"""Literal, random and odd cases of the operators of the llm subpackage."""

import collections
import gzip
import heapq
import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from highmark.llm import chat, huffman, langid, lines, mixing, neardup, packing, spans, tokens, topk, warc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers


def saved(df, folder, name="t"):
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


# WARC


PAGES = [(3, "http://a/", "x" * 300), (1, "http://b/\r\nEvil: yes", "x" * 300), (2, None, "é" * 5000), (None, "http://c/", "x" * 300), (4, "http://d/", None), (5, "http://e/", "short"), (6, "http://f/", "short"), (6, "http://f/", "short"), (7, "u", "")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("warc")
    pages = saved(spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("mine")), folder)
    warc.write(pages, f"{folder}/archives", segment=64)
    return f"{folder}/archives"


def test_archives_give_pages_back(spark, archive):
    rows = warc.read(spark, archive).collect()
    assert len(rows) == len(PAGES) and all(r.problem is None for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    assert by[1][0].type == "response" and bytes(by[1][0].payload) == b"x" * 300
    assert all(by[k][0].type == "revisit" and by[k][0].payload is None and by[k][0].refers_to == by[1][0].record_id for k in (3, None))
    assert bytes(by[2][0].payload) == "é".encode() * 5000
    assert bytes(by[4][0].payload) == b"" and bytes(by[7][0].payload) == b""
    assert [(r.type, bytes(r.payload)) for k in (5, 6) for r in by[k]] == [("response", b"short")] * 3


def test_broken_segments_are_told(spark, archive):
    parts = warc.read_records(spark, archive)
    origin = parts.filter("page_id = 2").first().record_id
    mine = F.coalesce("origin_id", "record_id") == origin
    of = lambda df: warc.payloads(warc.reassemble(df)).filter(F.col("record_id") == origin).first()
    assert of(parts.filter(~(mine & (F.col("segment") == 3)))).problem == "segments"
    assert of(parts.filter(~(mine & F.col("total").isNotNull()))).problem == "segments"
    assert of(parts.withColumn("total", F.col("total") + 1)).problem == "length"
    assert of(parts.unionByName(parts)).problem is None  # segments found twice count once
    assert of(parts.orderBy(F.rand(3))).problem is None
    assert of(parts.filter("false")) is None


def test_chunked_framing():
    assert warc.dechunk(b"3\r\nabc\r\nA;x=y\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    for broken in (b"", b"3\r\nab", b"x\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.dechunk(broken) is None


def test_no_pages(spark, tmp_path):
    warc.write(saved(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path), f"{tmp_path}/a")
    assert warc.read(spark, f"{tmp_path}/a").count() == 0


def warc_record(block, head=b"WARC-Type: response\r\n", length=None):
    return b"WARC/1.0\r\n" + head + b"Content-Length: " + (b"%d" % len(block) if length is None else length) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_and_damaged_archives(spark, tmp_path):
    low = b"WARC/1.0\r\nwarc-type:response\r\nWARC-record-ID:<a>\r\nwarc-page-id:7\r\ncontent-length:5\r\n\r\nhello\r\n\r\n"
    good = [warc_record(b"x" * k) for k in (3, 0, 70_000)]
    files = {
        "lower": low, "bad": good[0] + warc_record(b"lost", length=b"x") + b"rubbish\r\n\r\n" + good[1], "short": good[0] + good[2][:500], "head": good[0] + b"WARC/1.0\r\nWARC-Type: resp",
        "noise": b"\x00\x01 no archive", "empty": b"", "members": b"".join(map(gzip.compress, good)), "cut": gzip.compress(good[0]) + gzip.compress(bytes(range(256)) * 4000)[:900],
        "damaged": gzip.compress(good[0]) + gzip.compress(good[1])[:-12] + b"damage" * 5, "padded": gzip.compress(good[1]) + b"\0" * 600,
    }
    got = {}
    for name, raw in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(raw)
        got[name] = [(r.problem, None if r.block is None else len(r.block)) for r in warc.read_records(spark, f"{tmp_path}/{name}").collect()]
    first = (None, 3)
    assert got == {
        "lower": [(None, 5)], "bad": [first, ("header", None), (None, 0)], "short": [first, ("truncated", None)], "head": [first, ("truncated", None)], "noise": [("header", None)], "empty": [],
        "members": [first, (None, 0), (None, 70_000)], "cut": [first, ("header", None)], "damaged": [first, ("truncated", None)], "padded": [(None, 0)],
    }
    r = warc.read(spark, f"{tmp_path}/lower").first()
    assert (r.record_id, r.type, r.page_id, r.problem) == ("<a>", "response", 7, None)
    assert [r.problem for r in warc.read(spark, f"{tmp_path}/short").collect()] == [None, "truncated"]


def test_parsing_takes_time_in_proportion():
    def took(n):
        raw = warc_record(b"y" * 100) * n
        began = time.process_time()
        assert sum(1 for _ in warc._parse(iter([raw]))) == n
        return time.process_time() - began

    took(100)
    assert took(16_000) < 12 * took(4_000) + 0.2  # 16 times, if it were by the square


# language


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    scores, moves, first = rng.normal(size=(7, 3)).astype(np.float32), rng.normal(size=(3, 3)), rng.normal(size=3)
    chances, moved, begun = langid.forward_backward(scores, np.array([4, 1, 2]), moves, first)
    at, all_moved, all_begun = 0, np.zeros((3, 3)), np.zeros(3)
    for n in (4, 1, 2):
        own, total, m, b = np.zeros((n, 3)), 0.0, np.zeros((3, 3)), np.zeros(3)
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(first[path[0]] + sum(scores[at + t, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path)))
            total += w
            b[path[0]] += w
            for t, y in enumerate(path):
                own[t, y] += w
            for x, y in itertools.pairwise(path):
                m[x, y] += w
        assert chances[at : at + n] == pytest.approx(own / total, abs=1e-5)
        assert langid.chances_in_pieces(scores[at : at + n], np.array([n]), moves, first) == pytest.approx(own / total, abs=1e-5)
        all_moved, all_begun, at = all_moved + m / total, all_begun + b / total, at + n
    assert moved == pytest.approx(all_moved, abs=1e-5) and begun == pytest.approx(all_begun, abs=1e-5)


@pytest.mark.parametrize("chain", [[4, 1, 2], [1], [300, 17, 16, 33, 1, 2000], [50] * 30, [256], [257, 16], [5000]])
def test_chains_in_pieces_are_exact(chain):
    rng = np.random.default_rng(7)
    scores, moves, first = rng.normal(size=(sum(chain), 4)).astype(np.float32) * 3, rng.normal(size=(4, 4)), rng.normal(size=4)
    want = langid.forward_backward(scores, np.array(chain), moves, first)[0]
    assert langid.chances_in_pieces(scores, np.array(chain), moves, first) == pytest.approx(want, abs=1e-9)


def test_every_language_is_learned(spark, tmp_path):
    rows = [(k, f"w{k % 70}x " * 30 + ("tail" * 4 + " ") * (600 if k == 1 else 0), f"l{k % 70}") for k in range(700)] + [(None, "no id", "zz"), (800, None, "zz"), (801, "no lang", None)]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string, lang string"), tmp_path)
    model = langid.learn(docs)
    assert model.languages == sorted({f"l{k}" for k in range(70)}) and len(model.weights) < 1 << langid.BITS
    assert langid.learn(docs.limit(0)).languages == ["und"] == langid.learn(docs.filter("lang = 'zz'")).languages


def test_switches_are_found():
    en, de = "the house and the garden were with them when that happened there ", "das haus und der garten waren nicht bei uns als wir sie gesehen haben "
    model = langid.fit([("en", en * 20), ("de", de * 20)] * 10)
    text = en + de
    found = langid.spans(model, text)
    assert [lang for _, _, lang in found] == ["en", "de"] and abs(found[1][0] - len(en)) < 8
    assert langid.predict(model, [en, de, "", "123"])[0] == ["en", "de", "und", "und"]
    assert langid.predict(langid.fit([]), ["words"])[0] == ["und"]


def test_a_text_is_one_chain():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["aaa", "bbb", "ccc"], n)) for n in (200, 3, 0, 65)]
    model = langid.fit([("x", "aaa ccc " * 50), ("y", "bbb ccc " * 50)] * 5)
    model.moves, model.first = np.log([[0.95, 0.05], [0.2, 0.8]]), np.log([0.1, 0.9])
    langs, got = langid.predict(model, texts)
    for lang, score, t in zip(langs, got, texts, strict=True):
        if not t:
            assert (lang, score) == ("und", 0)
            continue
        e = model.scores(langid.find_words([t])).astype(float)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        n, a = len(e), np.exp(model.moves)
        f, b = [np.exp(model.first) * e[0]], [np.ones(2)]
        for k in range(1, n):
            f.append((f[-1] @ a) * e[k])
            f[-1] /= f[-1].sum()
            b.append(a @ (e[n - k] * b[-1]))
            b[-1] /= b[-1].sum()
        p = np.array(f) * np.array(b[::-1])
        mean = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
        assert (lang, score) == (model.languages[mean.argmax()], pytest.approx(mean.max(), abs=1e-6))


# top-k


def brute_top(rows, k):
    out = []
    fit = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in fit:
        if q % 10 == 0:
            found = sorted((-sum(map(int.__mul__, a, b)), i) for i, b in fit if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "ties", "few", "odd", "none"])
def test_top_k(spark, kind, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    if kind == "ties":
        rows = [(i, [float(x) for x in rng.integers(-1, 2, size=8)]) for i in range(300)]
    if kind == "few":
        rows = rows[:4]
    if kind == "none":
        rows = []
    if kind == "odd":
        rows[5], rows[6], rows[7], rows[8], rows[9] = (5, None), (6, [None] * 8), (7, [float("nan")] * 8), (8, [float("-inf")] * 8), (None, rows[9][1])
        rows += [(11, rows[11][1]), (20, rows[20][1]), (400, [1.0, 2.0]), (401, [1.0, -2.0]), (402, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 10 = 0").dropDuplicates(["vec_id"]), k=7, spread=3).collect()))
    want = brute_top(rows, 7)
    if kind == "odd":  # the repeated query row is asked once
        want = sorted({*want})
    assert got == want


@pytest.mark.parametrize("high", [3, 100])
def test_bounds_pass_between_blocks(spark, high):
    rng = np.random.default_rng(high)
    rows = [(i, [float(x) for x in rng.integers(-high, high, size=6)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 10 = 0"), k=7, spread=29).collect())) == brute_top(rows, 7)


def test_a_block_returns_only_what_reaches_the_bound():
    rng = np.random.default_rng(3)
    rows = rng.integers(-50, 50, size=(400, 8))
    block = topk.Lists(np.arange(400), rows)
    for q in rows[:20]:
        scores = np.sort(rows @ q)[::-1]
        for least in (int(scores[0]), int(scores[4]), int(scores[4]) + 1, int(scores[0]) + 1, int(scores[300])):
            ids, got, _ = block.top(-1, q, 10, least)
            assert got.tolist() == [x for x in scores[:10].tolist() if x >= least] and (rows[ids] @ q == got).all()
        assert block.top(-1, q, 10, int(scores[0]))[2] <= block.top(-1, q, 10)[2]


def test_reading_stops_early_and_stays_exact():
    rng = np.random.default_rng(1)
    for rows in (rng.integers(-9, 10, size=(500, 6)), (rng.pareto(1.0, size=(500, 6)) * 100).astype(np.int64), rng.integers(-(1 << 28), 1 << 28, size=(60, 16))):
        block, depths = topk.Lists(np.arange(len(rows)), rows), []
        for q in rng.integers(-9, 10, size=(40, rows.shape[1])):
            ids, scores, depth = block.top(-1, q, 5)
            depths.append(depth / len(rows))
            want = sorted((-int(r @ q), i) for i, r in enumerate(rows))[:5]
            assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] == want
        assert len(rows) < 100 or np.mean(depths) < 0.95 and min(depths) < 0.9


def test_reading_stops_early_on_given_vectors(sf):
    vectors = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    rows = np.array([[int(np.floor(1024 * float(x))) for x in v["embedding"]] for v in vectors if v["embedding"] and None not in v["embedding"]])
    block = topk.Lists(np.arange(len(rows)), rows)
    for q in range(0, len(rows), 100):
        ids, scores, depth = block.top(q, rows[q], 10)
        want = sorted((-int(r @ rows[q]), i) for i, r in enumerate(rows) if i != q)[:10]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] == want and depth < len(rows)


# near duplicates


def test_signatures_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for _ in range(200):
        a = rng.integers(1 << 16, size=neardup.SYMBOLS).astype("<u2")
        b = a.copy()
        b[rng.choice(neardup.SYMBOLS, 2 * neardup.CHUNKS - 1, replace=False)] ^= 1
        pairs.append((a.tobytes(), b.tobytes()))
    df = spark.createDataFrame(pairs, "a binary, b binary").select(F.arrays_overlap(neardup.keys(F.col("a")), neardup.keys(F.col("b"))).alias("met"))
    assert df.filter("not met").count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}


def shingle_set(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in text.replace("\x0b", " ").split()] if text else []
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_groups_of_near_copies(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n", "One two", "one TWO", "one", "É a", "é a"]
    for base in range(6):
        words = [f"w{base}_{k}" for k in range(rng.choice([30, 80, 200]))]
        for _ in range(12):  # chains: each a little further from the last
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts += [texts[-1]] * 5
    rows = [(k if k % 17 else None, t) for k, t in enumerate(texts)]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string").coalesce(3).withColumn("row", F.lit("mine")), tmp_path)
    sets, root = [shingle_set(t) for _, t in rows], [*range(len(rows))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {}
    for k in range(len(rows)):
        want.setdefault(find(k), []).append(k)
    ids = {k: min((rows[x][0] for x in group if rows[x][0] is not None), default=None) for group in want.values() for k in group}
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted((rows[k][0] or -1, len(sets[k]), ids[k] or -1) for k in range(len(rows)))
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_find_the_links_of_all_pairs():
    rng = random.Random(21)
    sets = []
    for base in range(5):
        words = [rng.getrandbits(63) for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(8):
            sets.append(np.unique(np.array(words, dtype="<u8")))
            words[rng.randrange(len(words))] = rng.getrandbits(63)
    left, right = [*range(0, 25)], [*range(15, 40)]
    got = {*zip(*map(np.ndarray.tolist, neardup._linked(np.array(left), [sets[k] for k in left], np.array(right), [sets[k] for k in right], 85)), strict=True)}
    assert got == {(a, b) for a in left for b in right if a != b and 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})} and got


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_of_the_least_similarity_share_a_key(percent):
    rng = np.random.default_rng(percent)
    met, n = 0, 1500
    for _ in range(n):
        both, each = percent * 2, (200 - percent * 2) // 2
        words = rng.integers(1 << 62, size=both + 2 * each, dtype=np.uint64)
        same = neardup.signature(words[: both + each]) == neardup.signature(np.append(words[:both], words[both + each :]))
        met += bool((same.reshape(neardup.CHUNKS, neardup.SIZE).sum(axis=1) >= neardup.SIZE - 1).any())
    assert met == n


# mixing


def test_targets(spark):
    df = spark.createDataFrame([("a", 100), ("b", 900), ("c", 10), (None, 90)], "source string, size long")
    got = {r.key: r.target for r in mixing.source_targets(df).collect()}
    # weights 5, 2, 1, 5; 1100 words; a, c and null stop at three times their sizes
    assert got == {"sa": 300.0, "sc": 30.0, "n": 270.0, "sb": pytest.approx(500.0)}
    assert {r.target for r in mixing.source_targets(df.withColumn("size", F.lit(0))).collect()} == {0.0}


def test_mixing_odd_rows(spark, tmp_path):
    docs = saved(spark.createDataFrame([(1, None, None), (1, None, None), (None, "a b", "x"), (2, "", "x"), (3, "word " * 30_000, "y")], "doc_id long, text string, source string").withColumn("size", F.lit("mine")), tmp_path)
    plan = mixing.mix_plan(docs).collect()
    assert sorted((r.doc_id or 0, r["size"], r.source_size) for r in plan) == [(0, 2, 2), (1, 0, 0), (1, 0, 0), (2, 0, 2), (3, 30_000, 30_000)]
    # sources x, y, null weigh 5, 2, 1 and may grow to 6, 90,000 and 0 words: x and null stop there, y has the rest of 30,002
    assert {r.doc_id: r.target for r in plan} == {None: 6.0, 2: 6.0, 1: 0.0, 3: 29_996.0}
    assert {r.doc_id: r.taken for r in plan if r.doc_id != 3} == {None: 6, 2: 0, 1: 0} and sum(r.taken for r in plan if r.doc_id == 3) in (0, 30_000)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mixing_many_null_ids(spark, tmp_path):
    """Rows without an id and of one size: taken near the target, alike each time."""
    docs = saved(spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source")), tmp_path)
    runs = [sorted(map(tuple, mixing.mix_plan(docs).groupBy("source_size", "target").agg(F.sum("taken"), F.count("*")).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and [r[3] for r in runs[0]] == [1000, 2000]
    assert all(abs(r[1] - r[2]) <= 3 for r in runs[0])


# packing and token files


TEXTS = ["", " ", "Hello, World!", "it's  we'll\n\n\tx", "é ñ ß", "日本 語", "a\xa0b \xa0 c", "\x1c\x85 x", "<|endoftext|> [PAD]", "hello <|endoftext|> world", "a<|startoftext|>b<|ENDOFTEXT|>", "x" * 3000, "a" + " " * 500 + "b", "1234567 3.14", "😀👍🏽", "\x00\x01", "Don't STOP\r\nnow", "Ⅳ ² ½ ǅ İ"]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_gives_the_tokenizers_ids(name, spaced):
    own, library = tokens.Encoder(public_tokenizers.path(name), spaced), Tokenizer.from_file(public_tokenizers.path(name))

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'sS.é\xa0")), max_size=60), st.sampled_from(["", "", "<|endoftext|>", " <|startoftext|>", "<|EndOfText|>"]))
    def same(text, more):
        text = text[:30] + more + text[30:]
        assert np.frombuffer(own([text])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids

    for t in TEXTS:
        assert np.frombuffer(own([t])[0], dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    same()


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_other_vocabularies_go_to_the_library(name, spaced, tmp_path):
    """A file that changes or cuts texts in another way, or is said to be of the other kind, still gives the library's ids."""
    own = tokens.Encoder(public_tokenizers.path(name), spaced)
    assert own.is_known
    lower, digits, short = (Tokenizer.from_file(public_tokenizers.path(name)) for _ in range(3))
    lower.normalizer = normalizers.Sequence([normalizers.NFKC(), normalizers.Lowercase()])
    digits.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=True)])
    short.enable_truncation(3)
    for k, other in enumerate((lower, digits, short)):
        other.save(f"{tmp_path}/{k}.json")
        own = tokens.Encoder(f"{tmp_path}/{k}.json", spaced)
        assert not own.is_known
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in own(TEXTS)] == [other.encode(t, add_special_tokens=False).ids for t in TEXTS]
    wrong, library = tokens.Encoder(public_tokenizers.path(name), not spaced), Tokenizer.from_file(public_tokenizers.path(name))
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in wrong(TEXTS)] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_cuts_at_any_white_space(name, spaced, monkeypatch):
    """White space of each kind, alone and in pairs and threes, before, between and after words, with memories that are often emptied."""
    monkeypatch.setattr(tokens, "CHUNKS", 20)
    monkeypatch.setattr(tokens, "PIECES", 20)
    own, library = tokens.Encoder(public_tokenizers.path(name), spaced), Tokenizer.from_file(public_tokenizers.path(name))
    for n in (1, 2, 3):
        for space in map("".join, itertools.product(" \n\t\r\x1c\x1f", repeat=n)):
            texts = [f"{space}It's one, two{space}Three_3 's{space}", f"größe{space}a b\nc", space]
            assert [np.frombuffer(x, dtype="<u4").tolist() for x in own(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, (own.pieces, own.chunks, own.after_space))) < 60


def test_sequences_are_full(spark, tmp_path):
    docs = saved(spark.createDataFrame([(k if k % 5 else None, t) for k, t in enumerate([*TEXTS, None] * 3)], "doc_id long, text string").repartition(3), tmp_path)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=64)
    rows = packing.sequences(pieces, 64, pad=7).collect()
    assert all(len(r.ids) == 256 for r in rows) and sum(r.n_ids < 64 for r in rows) <= 1
    assert pieces.filter("first").count() == pieces.filter("last").count() == docs.count()
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def huffman_bits(counts):
    heap = [*counts]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def least_bits(counts, longest):
    """The fewest bits over all sets of code lengths, by trying them."""
    best = None
    for lengths in itertools.product(range(1, longest + 1), repeat=len(counts)):
        if sum(2.0**-x for x in lengths) <= 1:
            bits = sum(n * x for n, x in zip(counts, lengths, strict=True))
            best = bits if best is None else min(best, bits)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=2, max_size=6), st.integers(3, 5))
def test_code_lengths_are_best(counts, longest):
    lengths = huffman.code_lengths(np.array(counts), longest)
    assert lengths.max() <= longest and sum(2.0 ** -int(x) for x in lengths) <= 1
    assert int(lengths @ np.array(counts)) == least_bits(counts, longest)
    assert int(huffman.code_lengths(np.array(counts), 40).astype(int) @ np.array(counts)) == huffman_bits(counts)


def test_codes_give_ids_back():
    rng = np.random.default_rng(6)
    for size, n in ((1, 10), (2, 1000), (300, 5000), (40_000, 70_000)):
        ids = np.concatenate([np.arange(size), (rng.pareto(0.7, size=n) % size).astype(np.int64)])
        used, counts = np.unique(ids, return_counts=True)
        codes = huffman.Codes(used, huffman.code_lengths(counts))
        blocks = [ids[:257], ids[257:], ids[:1]] if len(ids) > 257 else [ids]
        encoded = [codes.encode(b) for b in blocks]
        back = codes.decode([e[0] for e in encoded], [e[1] for e in encoded], [len(b) for b in blocks])
        assert all((x == y).all() for x, y in zip(back, blocks, strict=True))


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k // 2 if k else None, t) for k, t in enumerate([*TEXTS, None, "long text here " * 20_000])]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("mine")).repartition(3), tmp_path)
    got = huffman.round_trip(docs, path).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
    want = sorted((d is not None, d or 0, zlib.crc32(ids(t))) for d, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(r.ids)) for r in got) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert huffman.round_trip(docs.limit(0), path).count() == 0


def test_rows_without_an_id_are_dealt_over_tasks(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = saved(spark.range(0, 2000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")), tmp_path)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        huffman.write(docs, f"{tmp_path}/ids", path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = spark.read.parquet(f"{tmp_path}/ids/blocks").select("part", F.explode("doc_ids").alias("doc_id")).filter("doc_id is null").groupBy("part").count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == docs.filter("doc_id is null").count()
    got = huffman.read(spark, f"{tmp_path}/ids").orderBy("start").collect()
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_ids_that_need_more_bytes(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = saved(spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string"), tmp_path)
    huffman.write(docs, f"{tmp_path}/wide", path, end_id=70_000, width=4)
    got = huffman.read(spark, f"{tmp_path}/wide").orderBy("doc_id").collect()
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(r.ids, dtype="<u4").tolist() for r in got] == [[*library.encode(t, add_special_tokens=False).ids, 70_000] for t in TEXTS]
    with pytest.raises(Exception, match="two bytes"):
        huffman.write(docs, f"{tmp_path}/narrow", path, end_id=70_000)


# passages


def test_passages(spark, tmp_path):
    p = "This passage stands in several documents of the set. It has some twenty words or more in all. It will go from later ones. "
    rows = [(2, f"Second begins. {p}Second ends."), (1, f"First begins. {p}First ends."), (3, f"{p}Between. {p}"), (None, p.upper()), (4, None), (4, "")]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("replaced")), tmp_path)
    got = {(r.doc_id, r.text, r.n_removed) for r in spans.clean(docs).collect()}
    assert got == {(1, rows[1][1], 0), (2, "Second begins. Second ends.", 3), (3, "Between. ", 6), (None, "", 3), (4, None, 0), (4, "", 0)}


def test_passages_without_a_full_stop_go_wherever_they_stand(spark, tmp_path):
    rng = random.Random(3)
    said = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, kept = [], {}
    for k in range(30):
        p, before, after = said(51 + k), said(k), said(k % 13)
        rows += [(2 * k, f"{said(k % 7)} {p} {said(5)}"), (2 * k + 1, f"{before} {p} {after}")]
        kept[2 * k + 1] = (before.split(), p.split(), after.split())
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    got = {r.doc_id: r for r in spans.clean(docs).collect()}
    for k, (before, p, after) in kept.items():
        left = got[k].text.split()
        assert left[: len(before)] == before and left[len(left) - len(after) :] == after
        assert len(before) + len(p) + len(after) - len(left) == got[k].n_words_removed >= spans.WORDS and got[k].n_removed
        assert got[k - 1].text == dict(rows)[k - 1]


def test_short_sentences_at_the_end_of_a_passage_go(spark, tmp_path):
    p = " ".join(" ".join(f"s{k}x{j}" for j in range(n)) + "." for k, n in enumerate([6, 6, 6, 6, 1, 1, 1])) + " "
    rows = [(1, f"First it begins. {p}Then the first one ends."), (2, f"So the second begins. {p}Now it ends in another way.")]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    got = {(r.doc_id, r.text, r.n_removed, r.n_words_removed) for r in spans.clean(docs).collect()}
    assert got == {(1, rows[0][1], 0, 0), (2, "So the second begins. Now it ends in another way.", 7, 27)}


@pytest.mark.parametrize("together", [1, 300, 1 << 18])
def test_no_run_that_repeats_is_lost_by_anchors(monkeypatch, together):
    monkeypatch.setattr(spans, "_TOGETHER", together)
    rng = random.Random(7)
    said = lambda n, vocabulary: " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', '', '.'])}" for _ in range(n))
    passages = [said(n, 10**9) for n in (24, 30, 51, 200)]
    texts = [" ".join([said(rng.randrange(40), 10**9), rng.choice(passages), said(rng.randrange(60), v), rng.choice(passages)]) for v in (1, 2, 3, 50, 10**9) for _ in range(20)]
    texts += [None, "", "a", "a " * 23, "a " * 24, "Ω. " * 3000, said(3000, 10**9)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    found = [r for b in spans._marks(iter([batch])) for r in b.to_pylist()]
    assert len({(r["id"], r["hash"]) for r in found}) == len(found)
    times = collections.Counter()
    for r in found:
        times[r["hash"]] += r["n"]
    common = {}
    for r in found:
        if times[r["hash"]] > 1:
            common.setdefault(r["id"], []).append(r["hash"])
    every = [spans.runs(t or "")[4] for t in texts]
    count = collections.Counter(h for hashes in every for h in hashes.tolist())
    for k, (text, hashes) in enumerate(zip(texts, every, strict=True)):
        kept = spans.runs(text or "", np.array(common.get(k, []), dtype=np.int64))[4]
        assert [h for h in hashes.tolist() if count[h] > 1] == [h for h in kept.tolist() if count[h] > 1]
    assert len(every[-1]) > 1000 and len(kept) == 0  # the last text shares nothing


# languages


def test_letters_of_all_planes(spark):
    assert len(langid.find_words([chr(0x30000) + chr(0x30001), "a\U0001F600b"]).starts) == 3


# near duplicates with hubs


def test_outsiders_meet_a_large_group(spark, tmp_path):
    draw = random.Random(9)
    base = [f"w{k}" for k in range(120)]

    def changed(words, n):
        out = list(words)
        for at in draw.sample(range(len(out)), n):
            out[at] = f"x{draw.randrange(10**9)}"
        return " ".join(out)

    texts = [changed(base, draw.choice([0, 1, 1, 1])) for _ in range(600)] + [changed(base, draw.choice([2, 3, 4])) for _ in range(60)]
    docs = saved(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row long, text string").withColumn("doc_id", F.col("row")), tmp_path)
    sets = [set(neardup.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and (x := top(a)) != (y := top(b)):
            root[max(x, y)] = min(x, y)
    plain = {k: top(k) for k in range(len(texts))}
    assert {r.row: r.component_id for r in neardup.groups(docs, percent=85).collect()} == plain


# lines


def test_lines(spark):
    body = "\n".join("Line " + " ".join(f"w{k}x{j}" for j in range(12)) + "." for k in range(5))
    bad = ["Home | About | News | Contact", "All rights reserved 2024", "#### **** $$$$", "Too short"]
    rows = [(1, body), (2, body + "\n" + "\n".join(bad)), (3, "\n".join(bad * 30)), (4, None), (5, ""), (6, "same words again " * 60)]
    got = {r.doc_id: r for r in lines.judge(spark.createDataFrame(rows, "doc_id long, text string").withColumn("__w", F.lit(1))).collect()}
    assert [k for k in got if got[k].kept] == [1, 2] and got[2].line_kept == body and got[2].n_words > got[1].n_words
    assert got[4].n_words == got[5].n_words == 0 and got[4].base_failed and got[6].base_failed and got[6].n_repeat_words == 180
    assert got[3].n_dup_lines == 4 * 29


def test_notices_in_four_languages(spark):
    body = "Zeile " + " ".join(f"w{j}" for j in range(60)) + "."
    notices = ["Alle Rechte vorbehalten. Impressum.", "Tous droits réservés. Nous utilisons des cookies, vous acceptez.", "TODOS LOS DERECHOS RESERVADOS, aviso legal.", "All rights reserved. Imprint here.", "POLÍTICA DE PRIVACIDAD y más cosas aquí."]
    rows = [(k, f"{body}\n{x}") for k, x in enumerate(notices)] + [(9, f"{body}\nDie Rechte der Anderen sind uns wichtig."), (9, f"{body}\nDie Rechte der Anderen sind uns wichtig.")]
    got = lines.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r.line_kept == body) == (r.doc_id < 9) for r in got) and all(r.kept for r in got) and len(got) == 7


def test_lines_of_odd_tables(spark):
    long = "word and more " * 300_000
    got = lines.judge(spark.createDataFrame([(1, long), (1, long), (None, "\n \n")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 0, False), (1, 900_000, False), (1, 900_000, False)]
    assert lines.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# chat


def test_fold(spark):
    log = [(1, 0, 9, s, k, "assistant", t) for s, k, t in [(0, "delta", "bad"), (1, "regenerate", None), (2, "delta", "Hel"), (3, "delta", "lo"), (4, "delta", None)]]
    log += [(1, 1, 10, s, k, "user", t) for s, k, t in [(0, "delta", "draft"), (5, "edit", "final"), (7, "delta", "!"), (None, "delta", "before")]]
    log += [(None, None, 11, 0, "delta", None, "x")]
    events = spark.createDataFrame(log, "conv_id long, turn long, message long, seq long, kind string, role string, text string").orderBy(F.rand(1))
    assert {(r.message, r.role, r.text) for r in chat.fold(events).collect()} == {(9, "assistant", "Hello"), (10, "user", "final!"), (11, None, "x")}


def folded(log):
    """Messages of (message, seq, kind, role, text) events by a loop over the sorted log."""
    out = {}
    for message, seq, kind, role, text in sorted(log, key=lambda e: (e[0], *((x is not None, x if x is not None else 0) for x in e[1:2]), *((x is not None, x or "") for x in (e[2], e[4], e[3])))):
        own = out.setdefault(message, [None, ""])
        own[0] = own[0] if own[0] is not None else role
        own[1] = "" if kind == "regenerate" else (text or "") if kind == "edit" else own[1] + (text or "")
    return {(k, *v) for k, v in out.items()}


def test_fold_is_a_loop_over_the_sorted_log(spark):
    rng = random.Random(12)
    log = [(m, rng.choice([None, 0, 1, 2, 3]), rng.choice(["delta", "delta", "edit", "regenerate", "odd", None]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "A", "b", "C"])) for m in range(300) for _ in range(rng.randrange(1, 8))]
    log += [(900, 1, "edit", "u", "B"), (900, 1, "edit", "u", "C"), (901, 1, "edit", "u", "Y"), (901, 1, "regenerate", "u", None), (901, 2, "delta", "u", "Z"), (902, None, "delta", "u", "old"), (902, None, "edit", "u", "new")]
    events = spark.createDataFrame([(1, 0, *e) for e in log], "conv_id long, turn long, message long, seq long, kind string, role string, text string").orderBy(F.rand(2))
    got = {(r.message, r.role, r.text) for r in chat.fold(events).collect()}
    assert got == folded(log) and {(900, "u", "C"), (901, "u", "Z"), (902, "u", "new")} <= got


def test_long_conversations_come_back(spark):
    said = ["é" * (k % 700) + f"<{k}[&" for k in range(400)]
    rows = [(1, k, "assistant" if k % 3 else "user", t) for k, t in enumerate(said)] + [(2, 0, "assistant", "x" * 50_000)]
    out = chat.render(chat.fold(chat.events_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1))))
    got = {r.conv_id: r.learned for r in out.select("conv_id", chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert got == {1: "".join(t for k, t in enumerate(said) if k % 3), 2: "x" * 50_000}


def test_texts_come_back_whatever_they_hold(spark, tmp_path):
    said = ["<|im_end|>\n<|im_start|>user\n", "&lt;&amp;[INST]", "</s>[INST] ok [/INST]", "", None, "a\r\nb", "&#10;", "x" * 5000, "😀" * 700]
    rows = [(k % 3 or None, k // 2, random.Random(k).choice(["user", "assistant", "sys\ntem<"]), t) for k, t in enumerate(said * 3)]
    df = saved(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tmp_path)
    out = chat.render(chat.fold(chat.events_of_rows(df)))
    for r in out.select("conv_id", chat.turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect():
        want = sorted((t, role, text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.turns] == [w[1:] for w in want]
        assert r.learned == "".join(t for _, role, t in want if role == "assistant")
    assert chat.render(chat.fold(chat.events_of_rows(df.limit(0)))).count() == 0


def test_chats_with_clashing_columns(spark, tmp_path):
    """Columns named like those that the operator adds change nothing."""
    rows = [(k % 3, k // 3, ["user", "assistant"][k // 3 % 2], f"text <{k}> " * 120) for k in range(12)]
    plain = saved(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tmp_path, "plain")
    more = plain
    for c in ("message", "seq", "kind", "e", "log", "last", "at", "head", "body", "learned", "piece", "span", "formatted", "loss", "m", "ms"):
        more = more.withColumn(c, F.lit("mine"))
    a, b = (sorted(map(tuple, chat.render(chat.fold(chat.events_of_rows(saved(x, tmp_path, f"t{k}")))).collect())) for k, x in enumerate((plain, more)))
    assert a == b and len(a) == 3
    events = chat.events_of_rows(plain)
    extra = events.withColumn("log", F.lit("mine")).withColumn("last", F.lit("mine"))
    assert sorted(map(tuple, chat.render(chat.fold(extra).withColumn("piece", F.lit("mine")).withColumn("at", F.lit("mine"))).collect())) == a
