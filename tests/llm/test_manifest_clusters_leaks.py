"""Merkle manifests, ball-tree clusters and benchmark leaks against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from highmark.llm import balltree, leaks, merkle, queries
from pyspark.sql import functions as F

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Some Words, and MORE of them. " * 40_000


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def saved(df, folder, name="t"):
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


# Merkle manifest


def plain_leaf(row):
    return sha(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def plain_tree(nodes):
    """The root of nodes, and of each what stands left and right of its way."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            paths[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        nodes = [sha(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0] if nodes else None, paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda x: x[:3]), *plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])])) for s in names}
    root, above = plain_tree([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        leaves, subroot, paths = trees[s]
        for (_, _, leaf, r), path in zip(leaves, paths, strict=True):
            now = dict(r)
            if r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                now["text"] = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
            h = plain_leaf(now)
            for left, right in path + up:
                h = sha(left, h, right)
            out.append((r["doc_id"], leaf, subroot, root, sha(*[x for p in path + up for x in p]), h, h == root))
    return sorted(out, key=repr)


def of_query(spark, folder, rows, more=()):
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(f"mine {c}").alias(c) for c in more])
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, str(folder))
    return sorted([tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()], key=repr)


ODD = [
    (5, "A Text", "en", "b", 6), (5, "A Text", "en", "b", 6), (5, "Other", "en", "b", None), (None, None, None, None, None), (None, "No ID", None, None, 5), (7, "", "en", "", 0),
    (15, LONG, "en", "ü", len(LONG)), (-3, "😀 Ü", "de", "Z", 3), (10, "x", "en", "a", 1), (20, "UP", "en", "a", 2),
]


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in ODD]
    assert of_query(spark, tmp_path, ODD, ("tree", "key", "node", "row", "at", "n", "block", "leaf", "root", "path", "now")) == plain_manifest(rows)


@pytest.mark.parametrize("sizes", [(1, 15, 16, 17, 256, 257), (4096, 4097, 10_001), (1,)])
def test_manifest_of_many_rows(spark, tmp_path, sizes):
    rows = [(k, f"Text {k} of {s}", "en", f"source {s}", k) for s, n in enumerate(sizes) for k in range(n)]
    plain = plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    assert of_query(spark, tmp_path, rows) == plain
    assert any(not x[-1] for x in plain) and any(x[-1] for x in plain) or sizes == (1,)


def test_manifest_of_many_groups(spark, tmp_path):
    rows = [(k, f"Text {k}", "en", f"{k % 4500:x}", k) for k in range(5_000)]
    assert of_query(spark, tmp_path, rows) == plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])


def test_manifest_of_no_rows(spark, tmp_path):
    assert of_query(spark, tmp_path, []) == []


def test_paths_lead_to_the_root(spark, tmp_path):
    docs = saved(spark.createDataFrame(ODD, SCHEMA), tmp_path)
    rows = merkle.manifest(docs, "source", "doc_id", FIELDS, with_path=True)
    assert rows.filter("verified").count() == len(ODD)
    assert rows.filter(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == len(ODD)
    assert rows.filter(merkle.folded(F.lit("0"), F.col("path")) == F.col("root")).count() == 0


# Ball-tree clusters


def plain_clusters(rows, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    at = [v for _, v in sorted(kept, key=lambda r: (sha("3:" + ("" if r[0] is None else str(r[0]))), r[1]))[:8]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(at)), key=lambda c: (far(v, at[c]), c))
    for _ in range(rounds if at else 0):
        own = [nearest(v) for _, v in kept]
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            at[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = [(i, nearest(v), v) for i, v in kept]
    sums = {}
    for _, c, v in own:
        sums[c] = sums.get(c, 0) + far(v, at[c])
    return sorted([(i, c, far(v, at[c]), sums[c], sum(sums.values()), sha(",".join(map(str, at[c])))) for i, c, v in own], key=repr)


def clustered(spark, folder, rows, more=()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit(f"mine {c}").alias(c) for c in more])
    df.repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    got = queries.op11_ball_tree_clusters(spark, str(folder)).collect()
    return sorted([tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in got], key=repr)


def test_clusters_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=64).tolist()) for k in range(40)] + [(7, [0.5] * 64)] * 30 + [(None, [0.25] * 64), (None, [-0.25] * 64), (90, None), (91, []), (92, [0.1] * 63), (93, [0.1] * 65)]
    rows += [(94, [None] + [0.1] * 63), (95, [float("nan")] + [0.1] * 63), (96, [float("inf")] + [0.1] * 63), (97, [-0.0] * 64), (98, [1000.0] * 64), (99, [-30000.0] * 64)]
    got = clustered(spark, tmp_path, rows, ("v", "ids", "cluster", "distance", "inertia"))
    assert got == plain_clusters(rows) and len(got) == 75


@pytest.mark.parametrize("n", [0, 1, 3])
def test_clusters_of_few_rows(spark, tmp_path, n):
    rows = [(k, [k / 7] * 64) for k in range(n)]
    assert clustered(spark, tmp_path, rows) == plain_clusters(rows)


def test_clusters_of_equal_rows(spark, tmp_path):
    rows = [(k, [0.1] * 64) for k in range(300)]
    got = clustered(spark, tmp_path, rows)
    assert got == plain_clusters(rows) and {r[1] for r in got} == {0}  # ties go to the smaller number, the other centroids stay


def test_large_components_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="components go up to"):
        clustered(spark, tmp_path, [(1, [1e30] * 64)])


@pytest.mark.parametrize("spread", [5, 400])
def test_whole_balls_equal_single_vectors(spread):
    rng = np.random.default_rng(spread)
    middles = rng.integers(-2000, 2000, size=(8, 64))
    vectors = (middles[rng.integers(8, size=6000)] + rng.integers(-spread, spread + 1, size=(6000, 64))).astype(np.int64)
    tree = balltree.Tree(vectors)
    inside = vectors[tree.order]
    assert sorted(tree.order.tolist()) == list(range(6000))
    for k in range(len(tree.first)):
        part = inside[tree.first[k] : tree.end[k]]
        assert (tree.sums[k] == part.sum(axis=0)).all() and np.sqrt(((part - tree.sums[k] / len(part)) ** 2).sum(axis=1)).max() <= tree.radius[k]
    whole, rows, nearest = balltree.assign((inside, tree.first, tree.end, tree.radius, tree.sums), middles)
    own = np.full(6000, -1)
    own[rows] = nearest
    for ball, c in whole:
        assert (own[tree.first[ball] : tree.end[ball]] == -1).all()
        own[tree.first[ball] : tree.end[ball]] = c
    assert (own == ((inside[:, None, :] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert len(rows) < 3000 and len(whole) < 1000  # balls do go as a whole


def test_distances_are_exact():
    v = np.array([[balltree.MOST] * 64, [-balltree.MOST] * 64, [0] * 64, [balltree.FAST] * 64])
    assert [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in v] for x in v] == balltree.distances(v, v).tolist()
    assert [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in v[2:]] for x in v[2:]] == balltree.distances(v[2:], v[2:]).tolist()


# Benchmark leaks

LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return LEAK_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_leaks(text, items, window):
    own, hit, names = plain_words(text), set(), set()
    for name, item in items:
        w = plain_words(item)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            for i in range(len(own) - len(part) + 1):
                if own[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    names.add(name)
    return len(own), hit, sorted(str(x) for x in names if x is not None)


@pytest.mark.parametrize("most", [leaks.MOST_WORDS, 15])
def test_leaks_of_random_texts(spark, tmp_path, most):
    draw = random.Random(3)
    said = lambda n: "".join(draw.choice("aAbß7") + draw.choice([" ", ", ", "\n", "-", "  "]) for _ in range(n))
    texts = [(k, said(draw.choice([0, 1, 5, 40, 300]))) for k in range(60)] + [(60, None), (None, "a b a b a"), (60, "A a\x00A"), (61, "!!!")]
    items = [(k, said(draw.choice([2, 4, 6, 9]))) for k in range(12)] + [(3, "a b ß a"), (None, "7 7 7 7"), (100, None), (101, ""), (102, "?!"), (20, "b-b")]
    docs = saved(spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_words", F.lit("mine")).withColumn("leak_items", F.lit("goes")).withColumn("spans", F.lit(1)), tmp_path, "docs")
    asked = saved(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "items")
    out = leaks.find(docs, asked, window=4, most_words=most)
    assert out.columns == ["doc_id", "n_words", "spans", "leak_words", "leak_spans", "leak_items"]
    got = sorted([(r.doc_id, r.leak_words, sorted(k for s in r.leak_spans for k in range(s.first, s.end)), r.leak_items) for r in out.collect()], key=repr)
    assert got == sorted([(i, n, sorted(hit), names) for i, t in texts for n, hit, names in [plain_leaks(t, items, 4)]], key=repr)
    assert any(r[2] for r in got)


def test_leak_spans_are_of_the_original_text(spark, tmp_path):
    item = "What is the Capital of Österreich? It has been Wien since long ago."
    text = "😀 Before. WHAT is -- the\ncapital of Österreich: it has been wien; SINCE long ago!! After"
    docs = saved(spark.createDataFrame([(1, text)], "doc_id long, text string"), tmp_path, "docs")
    asked = saved(spark.createDataFrame([(9, item, "Yes, before!")], "item_id long, q string, a string"), tmp_path, "items")
    row = leaks.find(docs, asked, parts=("q", "a")).first()
    assert [text[s.start : s.stop] for s in row.leak_spans] == ["WHAT is -- the\ncapital of Österreich: it has been wien; SINCE long ago"] and row.leak_items == ["9"]
    short = saved(spark.createDataFrame([(9, "x", "ago after")], "item_id long, q string, a string"), tmp_path, "short")
    assert [text[s.start : s.stop] for s in leaks.find(docs, short, parts=("q", "a")).first().leak_spans] == ["ago!! After"]


def test_leaks_of_long_texts_and_no_rows(spark, tmp_path):
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(1, "filler text " * 200_000 + item), (2, item.upper()), (3, " ".join(f"w{k}" for k in range(9)))]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "docs")
    asked = saved(spark.createDataFrame([(1, item)], "item_id long, text string"), tmp_path, "items")
    got = {r.doc_id: (r.leak_words, [(s.first, s.end) for s in r.leak_spans]) for r in leaks.find(docs, asked).collect()}
    assert got == {1: (400_030, [(400_000, 400_030)]), 2: (30, [(0, 30)]), 3: (9, [])}
    assert leaks.find(docs.limit(0), asked).collect() == []
    assert [r.leak_spans for r in leaks.find(docs.filter("doc_id = 2"), asked.limit(0)).collect()] == [[]]
