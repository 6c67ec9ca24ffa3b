"""The queries of the llm subpackage against SQL, or against plain versions where SQL can't express them."""

import math
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from highmark.llm import queries, spans
from highmark.llm.words import _P, mix, range_hashes, word_spans
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def documents(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for f in os.listdir(sf):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    rows = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in rows.fetchall())


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = queries.op2_language_id(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert len(judged) > 200
    assert sum(r.lang_pred == langs[r.doc_id] for r in judged) >= 0.95 * len(judged)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_pieces_hold_each_id_once(spark, sf, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in documents}
    by_doc, by_sequence = {}, {}
    for r in queries.op6_pack_sequences(spark, sf).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc]) and p.ids_crc32 == crc(ids[doc][at : at + p.length])
            at += p.length
        assert at == len(ids[doc])
    assert sorted(by_sequence) == [*range(len(by_sequence))]
    for k, pieces in by_sequence.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == 4096 or k == len(by_sequence) - 1 and at < 4096


def test_files_hold_all_ids_in_order(spark, sf, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for r in sorted(documents, key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, queries.op9_huffman_ids(spark, sf).collect())) == want


def sentences(text):
    """Characters at which words start, the words, the words at which sentences start, and those at which their pieces of PIECE words do."""
    words = [*WORD.finditer(text)]
    begins, pieces = [], []
    for k, w in enumerate(words):
        before = words[k - 1].group() if k else ""
        ends = re.search(r"[.!?]$", before) or (len(before) > 1 and re.search(r"[.!?][\"')\]]$", before))
        if k == 0 or ends or "\n" in text[words[k - 1].end() : w.start()]:
            begins.append(k)
        if (k - begins[-1]) % spans.PIECE == 0:
            pieces.append(k)
    return [w.start() for w in words], [w.group().translate(LOWER) for w in words], begins, pieces


def near_cuts(words, begins):
    """Sentence starts, and of each NEAR words in a row within a sentence the one whose hash with the next word is least (the last of equals)."""
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    hashes = mix(range_hashes(raw, *word_spans(raw)))
    scores = [*mix(hashes[:-1] * _P + hashes[1:]).tolist(), *hashes[-1:].tolist()]
    cuts = {*begins}
    for k in range(len(words) - spans.NEAR + 1):
        window = range(k, k + spans.NEAR)
        if not any(b in window[1:] for b in begins):
            cuts.add(max(window, key=lambda x: (-scores[x], x)))
    return sorted(cuts)


def shortest_runs(edges, both_ways=True):
    """From each edge the shortest run of RUN pieces and WORDS words or more; up to each the shortest as well."""
    long_enough = lambda i, j: j - i >= spans.RUN and edges[j] - edges[i] >= spans.WORDS
    out = set()
    for i in range(len(edges)):
        out.update([(edges[i], edges[j]) for j in range(i, len(edges)) if long_enough(i, j)][:1])
        out.update([(edges[j], edges[i]) for j in range(i, -1, -1) if long_enough(j, i)][: int(both_ways)])
    return out


def text_runs(text, whole_rule=True):
    starts, words, begins, pieces = sentences(text)
    if not words:
        return starts, pieces, []
    found = shortest_runs([*pieces, len(words)], whole_rule)
    if whole_rule:
        found |= shortest_runs([*near_cuts(words, begins), len(words)])
    return starts, pieces, [(a, b, tuple(words[a:b])) for a, b in sorted(found)]


def gone_words(docs, whole_rule=True):
    """doc_id -> the numbers of its words that go, for (doc_id, text) with different ids."""
    found = {doc: text_runs(text or "", whole_rule)[2] for doc, text in docs}
    first, out = {}, {}
    for doc in sorted(found):
        for _, _, run in found[doc]:
            first.setdefault(run, doc)
    for doc, own in found.items():
        gone, had = set(), set()
        for a, b, run in own:
            if first[run] < doc or run in had:
                gone.update(range(a, b))
            had.add(run)
        out[doc] = gone
    return out


def without_repeats(docs):
    """doc_id -> text, n_sentences, n_removed, n_words_removed of (doc_id, text), ids all different."""
    out = {}
    for doc, gone in gone_words(docs).items():
        text = dict(docs)[doc]
        starts, _, _, pieces = sentences(text or "")
        if gone:
            at = [*starts, len(text)]
            text = text[: at[0]] + "".join(text[at[k] : at[k + 1]] for k in range(len(starts)) if k not in gone)
        ends = [*pieces[1:], len(starts)]
        out[doc] = text, len(pieces), sum(not gone.isdisjoint(range(a, b)) for a, b in zip(pieces, ends, strict=True)), len(gone)
    return out


def test_repeated_runs_go(spark, sf, documents):
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed, r.n_words_removed) for r in queries.op7_sentence_spans(spark, sf).collect()}
    want = without_repeats([(r["doc_id"], r["text"]) for r in documents])
    assert got == want and sum(n > 0 for _, _, n, _ in want.values()) > 5
    # what runs of whole sentences and 12-word pieces alone would remove goes too
    less = gone_words([(r["doc_id"], r["text"]) for r in documents], whole_rule=False)
    assert all(got[k][3] >= len(gone) for k, gone in less.items()) and sum(map(len, less.values())) > 100
