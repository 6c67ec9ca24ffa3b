"""The model hook: prompts to answers through a user's function, with retries.

A task calls the function on its own prompts, one after the other, and tries again where an error is transient. Answers
are stored before they are read, so that a lost task doesn't ask for what was answered, and those without a usable
item are asked for again in the next attempt, more strictly. Failures are rows.
"""

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from highmark.functions.text import TRANSIENT
from highmark.operators.answers import candidates
from highmark.storage import Scratch, stored

Model = Callable[[str], str]
STRICTER = "\n\nAnswer with JSON only: an object whose list 'highlights' has items with title, start_time, end_time, score, hook_sentence and virality_reason."


def is_transient(message: str) -> bool:
    """functions.text.is_transient() of a message within a task."""
    return any(x in message.lower() for x in TRANSIENT)


def ask_one(prompt: str, models: Sequence[Model], tries: int, wait: float) -> tuple[str | None, int, str | None]:
    """The first answer of the models in order, how often they were called, and the last error if none answered.

    A model is called again, up to `tries` times, after transient errors, with waits that double; after others the next one is.
    """
    called, error = 0, "no model"
    for model in models:
        for k in range(tries):
            called += 1
            try:
                return str(model(prompt) or ""), called, None
            except Exception as e:  # any error of a user's function is a result
                error = str(e) or type(e).__name__
                if not is_transient(error) or k == tries - 1:
                    break
                time.sleep(wait * 2**k)
    return None, called, error


def ask(prompts: DataFrame, models: Sequence[Model], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """prompts(video, chunk, prompt) with raw, calls and error: one of raw and error is null. A null prompt isn't asked and is an error.

    The functions go to the tasks, so they must be ones that can be pickled; each task handles one prompt at a time.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                got = [ask_one(p, models, tries, wait) if p is not None else (None, 0, "no prompt") for p in part.column(2).to_pylist()]
                columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "raw", "calls", "error"])

    rows = prompts.select("video", "chunk", F.col("prompt").cast("string").alias("prompt"))
    schema = T.StructType([*rows.schema.fields, T.StructField("raw", T.StringType()), T.StructField("calls", T.IntegerType()), T.StructField("error", T.StringType())])
    return rows.mapInArrow(answer, schema)


def highlights(prompts: DataFrame, models: Sequence[Model], attempts: int = 3, tries: int = 3, wait: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Candidates and failures of prompts(video, chunk, prompt, duration).

    Candidates are candidates() of the answers, with `attempt`. A prompt whose answer has no usable item is asked again with
    STRICTER behind it, up to `attempts` times; one whose models failed isn't. failures(video, chunk, attempt, error) are the rest.
    Each attempt's answers are stored; (video, chunk) tells prompts apart.
    """
    scratch = Scratch(prompts.sparkSession)
    open_, found, failed = prompts.select("video", "chunk", "prompt", "duration"), [], []
    for k in range(1, attempts + 1):
        asked = open_ if k == 1 else open_.withColumn("prompt", F.concat("prompt", F.lit(STRICTER)))
        raw = scratch.stored(ask(asked, models, tries, wait), "raw").select("video", "chunk", "raw", "error")
        answered = raw.filter("error is null").join(open_.select("video", "chunk", "duration"), ["video", "chunk"])
        usable = scratch.stored(candidates(answered).withColumn("attempt", F.lit(k)), "usable")
        found.append(usable)
        failed.append(raw.filter("error is not null").select("video", "chunk", F.lit(k).alias("attempt"), "error"))
        rest = answered.select("video", "chunk").join(usable.select("video", "chunk").distinct(), ["video", "chunk"], "left_anti")
        open_ = scratch.stored(open_.join(rest, ["video", "chunk"]), "open")
        if open_.isEmpty():
            break
    failed.append(open_.select("video", "chunk", F.lit(k).alias("attempt"), F.lit("no usable item").alias("error")))
    out = []
    for parts, name in ((found, "candidates"), (failed, "failures")):
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        if name == "candidates":
            whole = whole.withColumn("cand", F.row_number().over(Window.partitionBy("video").orderBy("chunk", "cand")) - 1)
        out.append(stored(whole, name))
    scratch.drop()
    return out[0], out[1]
