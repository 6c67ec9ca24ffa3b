"""Chat formatting from an event log, with DataFrame functions only.

A log has a row per event: (conv_id, turn, message, seq, kind, role, text). Events are dealt out by
message, sorted by seq and folded: `delta` appends its text, `edit` puts its text in place of all before
it, `regenerate` throws away all before it. The final messages of a conversation are rendered in order
of turn with a template, and the character spans of assistant texts make the loss mask.

Inside roles and texts the template's first characters, & < [ (and line feeds in roles), are written as
entities, so that no text can hold a control string; unescape() gives the text back.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Characters of a text in a delta event that events_of_rows() writes.
DELTA = 512
#: Characters of a stretch in which spans are looked up.
STRETCH = 16_384


def escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in (("\n", "&#10;"), ("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def events_of_rows(rows: DataFrame) -> DataFrame:
    """The log of final rows (conv_id, turn, role, text) as a chat service would have written it.

    A text streams in deltas. By a hash of the text, some user texts are first sent half and then edited,
    and some assistant texts are first half streamed, then regenerated. Each row is a message of its
    own, repeated rows too. A null text has one empty delta.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.substring(text, F.lit(1), (F.length(text) / 2).cast("int"))
    event = lambda seq, kind, what: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), what.alias("text"))
    deltas = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / DELTA) - 1, F.lit(0)).cast("int")),
        lambda i: F.struct((i + 2).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.substring(text, i * DELTA + 1, F.lit(DELTA)).alias("text")),
    )
    changed = F.pmod(F.xxhash64(text), F.lit(3)) == 0
    log = (
        F.when(changed & (F.col("role") == "user"), F.array(event(0, "delta", half), event(1, "edit", text)))
        .when(changed & (F.col("role") == "assistant"), F.concat(F.array(event(0, "delta", half), event(1, "regenerate", F.lit(None).cast("string"))), deltas))
        .otherwise(deltas)
    )
    messages = rows.withColumn("message", F.monotonically_increasing_id())
    return messages.select("conv_id", "turn", "message", "role", F.explode(log).alias("e")).select(
        "conv_id", "turn", "message", "role", "e.seq", "e.kind", "e.text"
    )


def fold(events: DataFrame) -> DataFrame:
    """A row per message of the log: conv_id, turn, message, role, text.

    Null seqs come first, ties in seq go by kind, then text. Null texts are empty; unknown kinds are
    deltas; events that repeat count each. A message's role is the one of its first event that has any. An empty log gives
    no message. Only a single message's own events need to meet in a task.
    """
    messages = events.groupBy("conv_id", "turn", "message").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i)))
    messages = messages.withColumn("last", F.coalesce(last, F.lit(-1))).withColumn("role", F.try_element_at(F.filter("log", lambda e: e["role"].isNotNull()), F.lit(1))["role"])
    lasting = F.filter("log", lambda e, i: (i > F.col("last")) | ((i == F.col("last")) & (e["kind"] == "edit")))
    return messages.select("conv_id", "turn", "message", "role", F.array_join(F.transform(lasting, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, formatted string, loss array of (start, length) in code points.

    Messages go by turn (null first), role, text; null roles and texts are empty; a null conv_id is a
    conversation. A conversation becomes one row, so its messages meet in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("&#10;")), F.lit(MIDDLE))
    rows = messages.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), "message").alias("at"), head.alias("head"), escape(text).alias("body"), (role == "assistant").alias("learned"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    ahead = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("span", F.when(F.col("learned"), F.struct((ahead + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))))
    rows = rows.select("conv_id", F.struct("at.turn", "at.role", "at.text", "at.message", "piece", "span").alias("m"))
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("m")).alias("ms"))
        .select("conv_id", F.array_join(F.transform("ms", lambda m: m["piece"]), "").alias("formatted"), F.filter(F.transform("ms", lambda m: m["span"]), lambda s: s.isNotNull()).alias("loss"))
    )


def turns(formatted: Column) -> Column:
    """The (role, text) pairs of a rendered conversation, in order; none of an empty string, null of null."""
    of = lambda group: F.regexp_extract_all(formatted, F.lit(r"<\|im_start\|>([^\n<]*)\n([^<]*)<\|im_end\|>\n"), F.lit(group))
    return F.zip_with(of(1), of(2), lambda role, text: F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped; empty without spans.

    Spans are taken from stretches of STRETCH characters, not each from the whole conversation.
    """
    count = F.ceil(F.length(formatted) / STRETCH).cast("int")
    stretches = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(formatted, i * STRETCH + 1, F.lit(STRETCH)))
    first = lambda s: F.floor(s["start"] / STRETCH).cast("int")
    several = lambda s, parts: F.array_join(F.slice(parts, first(s) + 1, F.floor((s["start"] + s["length"]) / STRETCH).cast("int") - first(s) + 1), "")
    text = lambda s, parts: unescape(F.substring(several(s, parts), (s["start"] % STRETCH + 1).cast("int"), s["length"].cast("int")))
    return F.transform(F.array(stretches), lambda parts: F.array_join(F.transform(loss, lambda s: text(s, parts)), ""))[0]
