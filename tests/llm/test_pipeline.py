"""The pipeline's stages against plain versions, and on odd tables."""

import itertools
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from highmark.llm import langid, mixing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"Sentence number {k} of a very long text has some words." for k in range(20_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (None, "No id here at all. But there are some words.", None, None, None), (5, LONG, "en", "a", len(LONG)),
    (5, LONG, "en", "a", len(LONG)), (6, "one", "en", "b", 3), (7, "\x00 a 😀 ퟿ end", "en", "b", 9), (None, None, None, None, None), (8, "1234 !!! 567", "de", None, 12),
]
CLASHING = ("row", "key", "n", "size", "node", "part", "ids", "score", "lang_pred", "n_words", "n_removed", "n_sentences", "hash", "copies", "first_row", "dotted.name")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def odd_docs(spark, folder, rows=ODD, more=CLASHING):
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    df.select("*", *[F.lit(f"mine {c}").alias(c) for c in more]).write.parquet(str(folder / "odd"))
    return spark.read.parquet(str(folder / "odd"))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, tmp_path, name, stage):
    docs = odd_docs(spark, tmp_path)
    out = stage(spark, docs, "")
    rows = out.collect()
    if name == "pack_sequences":
        assert Counter(r.doc_id for r in rows)[5] >= 2 and {None, 1, 2, 3, 5, 6, 7, 8} == {r.doc_id for r in rows}
        return
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    assert all(r[c] == f"mine {c}" for r in rows for c in CLASHING)
    ids = [r.doc_id for r in rows]
    if name == "language_id":
        assert 1 not in ids and 2 not in ids and 3 not in ids and 8 not in ids and ids.count(5) == 2
    if name == "near_duplicates":
        assert ids.count(5) == 1 and len(ids) == len(ODD) - 1  # null and empty texts are like nothing
    if name == "repeated_passages":
        assert len(ids) == len(ODD)  # rows of one doc_id don't take each other's passages


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_on_no_rows(spark, tmp_path, name, stage):
    assert stage(spark, odd_docs(spark, tmp_path, [], ()), "").collect() == []


def test_language_stage(spark, docs):
    model = langid.learn(docs)
    want = []
    for r in docs.collect():
        w = langid.find_words([r.text or ""])
        if not len(w.starts):
            continue
        scores = model.scores(w)
        best = exact_chances(scores.astype(float), model.moves, model.first).sum(axis=0)
        if (best / len(scores)).max() >= corpus_pipeline.LEAST_SCORE:
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == sorted(want)


def exact_chances(scores, moves, first):
    """Forward-backward of one chain, in logarithms."""
    n, k = scores.shape
    a, b = np.zeros((n, k)), np.zeros((n, k))
    a[0] = first + scores[0]
    for t in range(1, n):
        a[t] = scores[t] + np.logaddexp.reduce(a[t - 1][:, None] + moves, axis=0)
    for t in range(n - 2, -1, -1):
        b[t] = np.logaddexp.reduce(moves + scores[t + 1] + b[t + 1], axis=1)
    p = a + b
    return np.exp(p - np.logaddexp.reduce(p, axis=1, keepdims=True))


def shingle_set(text, length=5):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))} if words else set()


def test_near_duplicate_stage(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    sets, root = [shingle_set(r.text) for r in rows], [*range(len(rows))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = [rows[k].doc_id for k in range(len(rows)) if find(k) == k]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == want
    assert len(want) < len(rows)


def test_passage_stage(spark, docs):
    from test_llm_queries import without_repeats

    rows = {r.doc_id: r for r in docs.collect()}
    want = {k: (t, len(t) if n else rows[k].n_chars) for k, (t, _, n, words) in without_repeats([(k, r.text) for k, r in rows.items()]).items() if not words or WORD.search(t)}
    assert {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()} == want


def test_mixing_stage(spark, docs):
    once = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert once == Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()) and max(once.values()) <= 3
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    assert all(once[k] == r.copies for k, r in plan.items())
    sources, taken = {r.doc_id: r.source for r in docs.collect()}, Counter()
    for k, r in plan.items():
        taken[sources[k]] += r.taken
    for source in {*sources.values()}:
        own = [r for k, r in plan.items() if sources[k] == source]
        assert abs(taken[source] - own[0].target) <= 3 * max(r.size for r in own)


def test_packing_stage(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = Counter()
    for r in corpus_pipeline.pack_sequences(spark, docs, "").collect():
        got[r.doc_id] += r.length
    assert got == want


def test_all_stages_in_a_row(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "mix_sources", "pack_sequences"]
    rows = corpus_pipeline.run(spark, sf).collect()
    per_sequence = Counter()
    for r in rows:
        per_sequence[r.sequence_id] += r.length
    assert rows and all(n == 4096 for k, n in per_sequence.items() if k < len(per_sequence) - 1)


def test_runs_keep_their_results(spark, sf, tmp_path):
    a = corpus_pipeline.run(spark, sf)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    b = corpus_pipeline.run(spark, sf)
    kept.write.parquet(f"{tmp_path}/kept")
    read = spark.read.parquet(f"{tmp_path}/kept")
    assert read.schema["doc_id"].metadata["highmark.made_from"] and read.count() == kept.count()
    assert a.count() == b.count() > 0
    corpus_pipeline.mix_sources(spark, read, sf).count()  # removes what read was made from, and nothing else
    with pytest.raises(Exception, match="(?i)not.*exist"):
        kept.count()
    assert a.count() == b.count() and read.count() > 0


def test_odd_names_in_metadata_remove_nothing(spark, tmp_path):
    own = tmp_path / "mine"
    own.mkdir()
    docs = spark.createDataFrame([(1, "Some words here.", "en", "a", 16)], SCHEMA).withMetadata("doc_id", {"highmark.made_from": [str(own), "../mine", "highmark-x"]})
    docs.write.parquet(f"{tmp_path}/docs")
    assert corpus_pipeline.drop_repeated_passages(spark, spark.read.parquet(f"{tmp_path}/docs"), "").count() == 1 and own.exists()
