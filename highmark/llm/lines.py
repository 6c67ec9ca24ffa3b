"""Quality rules, line first, with DataFrame functions only.

Each line that has a word is judged by itself; failing lines go, and a document that loses too many of
its words with them is rejected. Document counts (base rules) are taken from the whole text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from highmark.llm._shared import WORD

#: Lines of at most so many words can fail for want of a closing mark, or as boilerplate.
SHORT_LINE, SHORT_NOTICE = 3, 30
#: A document fails below so many words, or above this share of words in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: A document is rejected that keeps less than this share of its words.
LEAST_KEPT = 0.5
SYMBOLS = r"[#*$%&|<>]"
#: Navigation: at least three separators, or nothing but a menu entry.
NAVIGATION = r"(?i)(?:[|»›>·•].*){3}|^\W*(?:home|menu|next|previous|back|login|log in|sign in|sign up|search|contact|about|skip to content|read more|click here|share|top)\W*$"
#: Notices that say nothing of their document, in English, German, French and Spanish. Letters beyond ASCII stand in both cases, as engines fold them differently.
BOILERPLATE = "(?i)" + "|".join((
    r"\bcookies?\b.*\b(?:accept|policy|use|akzeptieren|verwende[nt]|acceptez|utilis(?:e|ons|ez)|acepta|utiliza(?:mos)?)|\b(?:accept|use|akzeptieren|verwende[nt]|acceptez|utilis(?:e|ons|ez)|acepta|utiliza(?:mos)?)\b.*\bcookies\b",
    r"all rights reserved|privacy policy|terms of (?:use|service)|enable javascript|lorem ipsum|subscribe to|©|\(c\) *\d{4}|licensed under|copyright",
    r"alle rechte vorbehalten|\bimpressum\b|datenschutzerkl[äÄ]rung|nutzungsbedingungen|javascript aktivieren|newsletter abonnieren",
    r"tous droits r[éÉ]serv[éÉ]s|mentions l[éÉ]gales|politique de confidentialit[éÉ]|conditions (?:g[éÉ]n[éÉ]rales )?d['’]utilisation|activez javascript|abonnez-vous [àÀ]",
    r"todos los derechos reservados|aviso legal|pol[íÍ]tica de privacidad|(?:t[éÉ]rminos|condiciones) de uso|habilit[ea] javascript|suscr[íÍ]bete a",
))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")


#: Words (w) that lie in windows of three words found twice or more: windows are hashed and sorted, those
#: equal to a neighbour are repeated, and their places, again sorted, are joined to stretches.
_REPEATED = """
transform(array(sort_array(transform(slice(
    zip_with(zip_with(w, slice(w, 2, greatest(size(w), 1)), (a, b) -> struct(a, b)), slice(w, 3, greatest(size(w), 1)), (ab, c) -> xxhash64(ab.a, ab.b, c)),
    1, greatest(size(w) - 2, 0)), (h, i) -> struct(h, i)))),
  s -> aggregate(transform(array(sort_array(transform(filter(
      zip_with(zip_with(concat(array(cast(null as struct<h: bigint, i: int>)), s), s, (p, x) -> struct(p, x)), slice(s, 2, greatest(size(s), 1)), (px, n) -> struct(px.p, px.x, n)),
      z -> z.x is not null and (coalesce(z.p.h = z.x.h, false) or coalesce(z.n.h = z.x.h, false))), z -> z.x.i))),
    at -> zip_with(at, slice(at, 2, greatest(size(at), 1)), (here, after) -> coalesce(least(after - here, 3), 3)))[0],
  0L, (sum, n) -> sum + n))[0]
"""


def line_passes(line: Column) -> Column:
    """Whether a line that has a word stands the line rules.

    It fails as navigation; as a notice of at most SHORT_NOTICE words; as mostly symbols (a fifth of its
    characters or more); or with at most SHORT_LINE words and no closing punctuation.
    """
    n = F.regexp_count(line, F.lit(WORD))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    ends = line.rlike(r"[.!?…:;,\"'”’»)\]]\s*$")
    return ~(line.rlike(NAVIGATION) | ((n <= SHORT_NOTICE) & line.rlike(BOILERPLATE)) | (symbols * 5 >= F.length(line)) | ((n <= SHORT_LINE) & ~ends))


def judge(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with its columns and, under new names: counts, line_kept text, base_failed, kept.

    Null texts have no words and fail. A text's lines are cut at line feeds; lines without a word are
    neither judged nor kept. Rows are judged one by one, without a shuffle, whatever their columns are
    called; columns of docs named like a new one are replaced by it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("__hm_w", words(text)).withColumn("__hm_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    rows = rows.withColumn("__hm_good", F.filter("__hm_lines", line_passes))
    rows = rows.withColumn("n_words", F.size("__hm_w").cast("long")).withColumn("n_repeat_words", F.expr(f"transform(array(__hm_w), w -> {_REPEATED})[0]"))
    rows = rows.withColumn("n_dup_lines", (F.size("__hm_lines") - F.size(F.array_distinct("__hm_lines"))).cast("long"))
    rows = rows.withColumn("word_chars", (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long")).withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
    rows = rows.withColumn("line_kept", F.array_join("__hm_good", "\n")).withColumn("n_words_kept", F.regexp_count("line_kept", F.lit(WORD)).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(MOST_REPEATED * 100)))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_kept") >= F.col("n_words") * LEAST_KEPT))
    return rows.drop("__hm_w", "__hm_lines", "__hm_good")
