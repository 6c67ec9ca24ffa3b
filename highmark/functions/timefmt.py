"""Times in seconds as text, and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(seconds: Column) -> Column:
    return F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")


def hms(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; fractions are cut off, negatives are 0."""
    s = _whole(seconds)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def hms_tenths(seconds: Column) -> Column:
    """HH:MM:SS.s without carry: 59.97 becomes ..:60.0. The number itself is rounded, not its shortest decimals: 0.15 is a little less than that and reads 0.1, 0.25 is a half and goes to the even 0.2."""
    s = F.greatest(seconds, F.lit(0.0))
    rest = F.pmod(s, F.lit(60.0))
    part = rest - F.floor(rest)
    tenths = part * 8 + part * 2  # both products are exact, so what their sum leaves off is known
    lost = part * 2 - (tenths - part * 8)
    whole = F.floor(tenths)
    over = tenths - whole
    up = (over > 0.5) | ((over == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    n = F.floor(rest) * 10 + whole + up.cast("int")
    return F.format_string("%02d:%02d:%02d.%d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600.0)) / 60), F.floor(n / 10), n % 10)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm of the time rounded to milliseconds, halves to even."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, ms % 1000)


def parse_srt_time(text: Column) -> Column:
    """Seconds of HH:MM:SS,mmm; null for anything else."""
    part = lambda k: F.regexp_extract(text, r"^(\d{2}):(\d{2}):(\d{2}),(\d{3})$", k).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc; hundredths are rounded by themselves and can read 100."""
    s = F.greatest(seconds, F.lit(0.0))
    rest = F.pmod(s, F.lit(60.0))
    return F.format_string("%d:%02d:%02d.%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600.0)) / 60), F.floor(rest), F.bround((rest - F.floor(rest)) * 100).cast("long"))


def minutes(seconds: Column) -> Column:
    """M:SS."""
    s = _whole(seconds)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)
