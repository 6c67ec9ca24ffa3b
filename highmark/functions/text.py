"""Scalar functions over text: all built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOP_WORDS = (
    "the a an and or but so if of to in on at for with from as is are was were be been "
    "being it its this that these those i you he she we they them his her their our your "
    "me my mine not no yes do does did done have has had will would can could should just "
    "about into over than then there here what which who whom how when where why"
).split()
#: Words that are no hashtag.
UNTAGGED = (
    "with that this your from have they what when them about would there their these being could because really thing things"
).split()
#: Fixed pattern: titles that promise something.
INTEREST = (
    "mistake|truth|secret|why|how i|nobody|wrong|confession|fight|exposed|reveal|"
    "worst|best|shock|crazy|insane|never|fail|regret|lesson|story|moment"
)
#: What messages of passing errors contain.
TRANSIENT = (
    "rate_limit", "rate limit", "ratelimit", "429", "timeout", "timed out", "deadline", "503", "502", "500",
    "overloaded", "resource_exhausted", "temporarily", "retry",
)
#: What messages of errors with browser profiles contain.
CREDENTIAL = ("cookie", "could not copy", "failed to decrypt", "dpapi", "keyring", "no such browser", "profile")
#: Names of the best and the worst quality.
BEST, WORST = ("max", "highest", "best", "maxres"), ("lowest", "min", "worst")
WHITE = r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, WHITE, "")


def content_words(text: Column) -> Column:
    """The distinct lower-case ASCII words of more than two characters that carry a topic, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))
    return F.coalesce(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets, 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def slug(text: Column, longest: int = 60) -> Column:
    """Letters and digits joined by dashes; `clip` if there are none."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(plain == "", "clip").otherwise(plain), 1, longest)


def hashtags(title: Column, most: int = 4) -> Column:
    words = F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]{4,}"), F.lit(0))
    chosen = F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(UNTAGGED))), 1, most)
    return F.array_join(F.transform(chosen, lambda w: F.concat(F.lit("#"), w)), " ")


def first_words(text: Column, most: int = 8) -> Column:
    """The first distinct words in order."""
    return F.slice(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != "")), 1, most)


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def human_count(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1_000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("long").cast("string"))
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 75, "good").when(score >= 50, "warn").otherwise("bad")


def contains_any(message: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | F.lower(message).contains(n)
    return F.coalesce(found, F.lit(False))


def is_transient(message: Column) -> Column:
    return contains_any(message, TRANSIENT)


def is_credential_error(message: Column) -> Column:
    return contains_any(message, CREDENTIAL)


def to_double(x: Column, default: float) -> Column:
    """A number from loose input, `default` where it isn't one."""
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(float(default)))


def to_int(x: Column, default: int) -> Column:
    """Truncated toward zero."""
    return F.coalesce(x.cast("string").try_cast("double").try_cast("int"), F.lit(default))


def weight_map(text: Column, defaults: dict[str, float]) -> Column:
    """`k:v,k:v` over defaults; parts that aren't a known name and a number are skipped."""
    parts = F.transform(F.split(text, ","), lambda p: F.struct(strip(F.split(p, ":")[0]).alias("k"), F.try_element_at(F.split(p, ":"), F.lit(2)).try_cast("double").alias("v")))
    named = lambda k: lambda p: (p["k"] == k) & p["v"].isNotNull()
    return F.map_from_arrays(
        F.array(*map(F.lit, defaults)),
        F.array(*[F.coalesce(F.try_element_at(F.filter(parts, named(k)), F.lit(-1))["v"], F.lit(v)) for k, v in defaults.items()]),
    )


def quality_tag(quality: Column) -> Column:
    """max, low, or the whole number of lines that a wish for quality names; max for anything else."""
    key = F.lower(strip(F.coalesce(F.nullif(quality, F.lit("")), F.lit("max"))))
    lines = F.regexp_extract(key, r"^([+-]?[0-9]+)$", 1).try_cast("int").cast("string")
    return F.when(key.isin(*BEST), "max").when(key.isin(*WORST), "low").otherwise(F.coalesce(lines, F.lit("max")))


def rational(text: Column) -> Column:
    """The value of `num/den`; null without a denominator, or where it is 0."""
    parts = F.split(F.coalesce(text, F.lit("0/0")), "/", 2)
    return F.try_divide(parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))
