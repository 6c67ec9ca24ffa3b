"""The corpus pipeline: stages that each apply one operator to all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns rows of documents with their columns; the last returns
pieces of packed sequences. A stage's rows are written as Parquet and read again before the next one starts.

The tables that a stage has made on the way are needed until its rows are written. Their names go along as
metadata of doc_id, which Parquet keeps; so the next stage, which reads these rows from their own files, removes the
tables of just these rows. Results of other runs, and rows that weren't written, keep theirs.

All stages take null and repeated ids as rows like others, null texts as empty, columns of any name, and empty tables.
"""

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from highmark.llm import langid, mixing, neardup, packing, spans
from highmark.llm._shared import WORD, noted, remove, shared_root, stored

#: A document whose best language has a lower mean chance over its words is rejected, as is one without letters.
LEAST_SCORE = 0.4

_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_MADE_FROM = "highmark.made_from"


def _remove_sources(spark: SparkSession, docs: DataFrame) -> None:
    """Removes the tables that docs was made from, unless docs itself is still to be read from one."""
    names = [n for n in docs.schema["doc_id"].metadata.get(_MADE_FROM, []) if re.fullmatch("highmark-[0-9a-f]{32}", n)]
    files = docs.inputFiles() if names else []
    for name in names:
        if not any(f"/{name}/" in file for file in files):
            remove(spark, f"{shared_root(spark)}/{name}")


def _stage(f: _Stage) -> _Stage:
    """f, whose rows name the tables that they are made from, and which removes those of the rows that it gets."""

    @wraps(f)
    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _remove_sources(spark, docs)
        with noted() as folders:
            out = f(spark, docs, sf_dir)
        return out.withMetadata("doc_id", {_MADE_FROM: [x.rsplit("/", 1)[-1] for x in folders]})

    return run_


def _apart(docs: DataFrame, *named: str) -> DataFrame:
    """docs with other names for all columns but those named: none clashes with what an operator adds."""
    return docs.toDF(*[c if c in named else f"own_{k}" for k, c in enumerate(docs.columns)])


def _named(rows: DataFrame, apart: DataFrame, docs: DataFrame) -> DataFrame:
    """rows of apart with the columns of docs again."""
    return rows.select(*apart.columns).toDF(*docs.columns)


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter (null and empty texts among them) or with mixed-up words go.

    Of languages with equal chances the first by code point counts; repeated rows go or stay together. With no labelled row, no language is known and all go.
    """
    rows = _apart(docs, "text")
    labelled = langid.identify(rows, langid.learn(docs))
    return _named(labelled.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), rows, docs)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles link at a similarity of 0.8 or more: the smallest doc_id, null last, of equal ones the first row.

    Null texts and texts without a word are like nothing and stay.
    """
    return neardup.deduplicate(docs, length=5, percent=80)


@_stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one; those of which no word is left go.

    Null and empty texts lose nothing and stay; rows of one doc_id don't take each other's passages.
    """
    rows = _apart(docs, "doc_id", "text", "n_chars")
    cleaned = spans.clean(rows)
    kept = cleaned.filter((F.col("n_words_removed") == 0) | F.coalesce(F.col("text"), F.lit("")).rlike(WORD))
    return _named(kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))), rows, docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn, none is repeated more than three times.

    A null source is a source; null texts have no words and are taken as often as others of their source. Ties in size go by doc_id.
    """
    return mixing.mix(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4,096 tokens; a null or empty text is its end id alone."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: SQL has no tokenizer and no model; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with noted() as folders:
                docs = stored(docs, name)
            for folder in before:
                remove(spark, folder)
            before = folders
    return docs
