"""The queries of this subpackage over a folder of tables, and SQL that gives the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from highmark.llm import balltree, chat, huffman, langid, leaks, lines, merkle, mixing, neardup, packing, spans, topk, warc
from highmark.llm._shared import remove, shared_dir, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back; see warc for null, empty and repeated rows. problem is null for whole records."""
    folder = f"{shared_dir(spark)}/archives"
    warc.write(_table(spark, sf_dir, "pages"), folder)
    read = warc.read(spark, folder).select(
        "record_id", "page_id", "type", "refers_to", "problem", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    read = stored(read, "read")
    remove(spark, folder)
    again = F.col("type") == "revisit"
    first = read.filter(~again).select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_id"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"))
    revisits = read.filter(again).drop("payload_bytes", "payload_digest").join(first, "refers_to", "left")
    whole = read.filter(~again | F.col("type").isNull()).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    return whole.unionByName(revisits.select("page_id", F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("first_id").alias("refers_to"), "problem"))


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to, NULL::VARCHAR AS problem FROM f
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; null and letterless texts are `und` with score 0, repeated rows and null ids are rows like others. An empty table gives no row."""
    docs = _table(spark, sf_dir, "documents")
    labelled = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return labelled.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors of each queried one; see topk.top_k() for nulls, ties and repeated rows. An empty table gives no row."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_inner_product(q.v, c.v), 0)::BIGINT AS score FROM v q JOIN v c
  ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and its group; texts without a word are a group each. See neardup.groups() for null ids and repeated rows. An empty table gives no row."""
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w),
s AS (SELECT DISTINCT doc_id, md5(gram) AS gram FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document; null texts have size 0, null sources are one source, repeated rows are rows like others. An empty table gives no row."""
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
r AS (
  SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)::BIGINT) & 7) AS size_class,
         CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6) AS BIGINT) % 256 AS salt FROM d),
s AS (
  SELECT key, source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY key, source),
w AS (
  SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
f AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, (sum(weight) OVER ())::DOUBLE AS weights,
         coalesce(sum(cap) OVER b, 0)::DOUBLE AS cap_before, coalesce(sum(weight) OVER b, 0)::DOUBLE AS weight_before FROM w
  WINDOW b AS (ORDER BY cap::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (total - cap_before) / (weights - weight_before) > cap::DOUBLE / weight AS is_full FROM f),
l AS (
  SELECT *, (total - (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE) / (weights - (sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER ())::DOUBLE) AS level FROM g),
t AS (SELECT key, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE level * weight END AS target FROM l),
n AS (
  SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY r.key ORDER BY size_class, salt, size, doc_id NULLS FIRST) AS nth,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         CAST('0x' || substr(md5('0:' || r.key), 1, 6) AS BIGINT) / 16777216.0::DOUBLE AS shift FROM r JOIN t ON r.key = t.key)
SELECT doc_id, size, source_size, target,
       least(floor(each * nth + shift) - floor(each * (nth - 1) + shift), 3)::BIGINT * size AS taken FROM n
"""

def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; null texts are their end id alone, repeated rows and null ids are rows like others. An empty table gives no row."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; see spans.clean() for null texts, null ids and repeated rows. An empty table gives no row."""
    cleaned = spans.clean(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "text", "n_sentences", "n_removed", "n_words_removed")


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from Huffman-coded files in order of doc_id, null first; null texts are their end id alone. An empty table gives no row."""
    docs = huffman.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of each document, row by row; null texts have no words and fail. An empty table gives no row."""
    judged = lines.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BOILERPLATE = lines.BOILERPLATE.replace("'", "''")
OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
v AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM v) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM d),
j AS (
  SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n FROM l
  WHERE NOT (regexp_matches(line, '{lines.NAVIGATION}')
    OR (len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) <= {lines.SHORT_NOTICE} AND regexp_matches(line, '{_BOILERPLATE}'))
    OR 5 * len(regexp_extract_all(line, '{lines.SYMBOLS}')) >= length(line)
    OR (len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) <= {lines.SHORT_LINE} AND NOT regexp_matches(line, '[.!?…:;,"''”’»)\]]\s*$')))
  GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{lines.SYMBOLS}'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(j.n, 0) AS n_kept FROM d LEFT JOIN p USING (doc_id) LEFT JOIN j USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_kept >= {lines.LEAST_KEPT} * n_words AS kept FROM c
"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each rendered conversation; null texts are empty, ties in turn go by role and text. An empty table gives no row but conversation -7."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rendered = chat.render(chat.fold(chat.events_of_rows(rows.unionByName(extra))))
    read = rendered.withColumn("turns", chat.turns(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (
  SELECT *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS role_out,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS text_out FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role_out) + 1 + length(text_out) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's centroid after ten rounds; see balltree.cluster() for nulls, ties and repeated rows. An empty table gives no row."""
    return balltree.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _rounds(n: int) -> str:
    """SQL of n rounds from centroids c0(c, v) of vectors v(vec_id, v): c1, c2, ..."""
    one = """
a{k} AS (SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.v, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v, c{k} c) GROUP BY 1, 2),
s{k} AS (SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{k}) GROUP BY 1, 2),
m{k} AS (SELECT c, list(CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END::BIGINT ORDER BY j) AS v FROM s{k} GROUP BY 1),
c{n} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (c))"""
    return ",".join(one.format(k=k, n=k + 1) for k in range(n))


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h LIMIT 8)),{_rounds(10)},
f AS (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v, c10 c) GROUP BY 1)
SELECT vec_id, f.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256 FROM f JOIN c10 ON c10.c = f.c
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of each document, and whether it still stands after tampering; see merkle.manifest() for nulls and repeated rows. An empty table gives no row."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    now = F.when(tampered, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(_table(spark, sf_dir, "documents").select(*fields), "source", "doc_id", fields, {"text": now})


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x}), '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC32 = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({x}, ''), lambda s: ascii(s)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda r, i: xor(r >> 1, 3988292384::UBIGINT * (r & 1)))), 4294967295::UBIGINT)"


def _levels(name: str, base: str) -> str:
    """SQL of the levels of trees base(tree, pos, h): name(tree, lvl, pos, h, n), and name_path(tree, lvl, pos, l, r) of what stands left and right of a node."""
    return f"""
{name} AS (
  SELECT tree, 0 AS lvl, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM {base}
  UNION ALL SELECT tree, any_value(lvl) + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM {name} WHERE n > 1 GROUP BY tree, pos // 16),
{name}_path AS (
  SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON b.tree = a.tree AND b.lvl = a.lvl AND b.pos // 16 = a.pos // 16 WHERE a.n > 1 GROUP BY ALL)"""


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('s' || source, 'n') AS tree, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC32.format(x="doc_id::VARCHAR")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS now FROM documents),
e AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, tree, source, leaf, now, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
low AS (SELECT tree, pos, leaf AS h FROM e),{_levels("t", "low")},
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY CASE WHEN tree <> 'n' THEN substr(tree, 2) END NULLS FIRST) - 1 AS pos FROM t WHERE n = 1),
high AS (SELECT '' AS tree, pos, subroot AS h FROM s),{_levels("u", "high")},
w AS (
  SELECT e.rid, 0 AS part, p.lvl, p.l, p.r FROM e JOIN t_path p ON p.tree = e.tree AND p.pos = e.pos // (16 ** p.lvl)::BIGINT
  UNION ALL SELECT e.rid, 1, p.lvl, p.l, p.r FROM e JOIN s USING (tree) JOIN u_path p ON p.pos = s.pos // (16 ** p.lvl)::BIGINT),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY part, lvl) AS k FROM w),
f AS (SELECT rid, 0 AS k, now AS h FROM e UNION ALL SELECT f.rid, f.k + 1, sha256(p.l || f.h || p.r) FROM f JOIN p ON p.rid = f.rid AND p.k = f.k + 1),
g AS (SELECT rid, arg_max(h, k) AS folded_root FROM f GROUP BY rid),
q AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM p GROUP BY rid),
z AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM e JOIN s USING (tree) JOIN g USING (rid) LEFT JOIN q USING (rid), z
"""


def op13_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with benchmark items; see leaks.find() for null texts and names, and repeated rows. An empty table gives no row."""
    found = leaks.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("leak_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    counts = found.select("doc_id", F.col("leak_words").alias("n_words"), n_hit.alias("n_hit"), F.size("leak_items").cast("long").alias("n_items"), F.sha2(F.array_join("leak_items", ","), 256).alias("items_sha256"))
    return counts.withColumn("contaminated", F.col("n_hit") > 0)


_LEAK_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_LEAK_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_LEAK_WORDS} AS w FROM benchmark),
k AS (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
g AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM k),
e AS (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size),
m AS MATERIALIZED (SELECT e.row, e.i, e.size, g.item FROM e JOIN g ON g.size = e.size AND g.gram = array_to_string(e.w[e.i:e.i + e.size - 1], ' ')),
h AS (SELECT row, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT row, i, unnest(range(0, size)) AS j FROM m) GROUP BY row),
n AS (SELECT row, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN n USING (row)
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_segments, op2_language_id, op3_top_k, op4_near_duplicates, op5_mix_sources, op6_pack_sequences, op7_sentence_spans, op8_clean_lines, op9_huffman_ids, op10_chat_format,
        op11_ball_tree_clusters, op12_merkle_manifest, op13_benchmark_leaks,
    )
}
ORACLE_SQL = {
    "op1_warc_segments": OP1_SQL, "op3_top_k": OP3_SQL, "op4_near_duplicates": OP4_SQL, "op5_mix_sources": OP5_SQL, "op8_clean_lines": OP8_SQL, "op10_chat_format": OP10_SQL,
    "op11_ball_tree_clusters": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_benchmark_leaks": OP13_SQL,
}
