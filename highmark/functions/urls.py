"""Video addresses. The hosts, path words and patterns below are fixed values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from highmark.functions.text import strip


def with_scheme(url: Column) -> Column:
    """https:// put before addresses without a scheme; null becomes empty."""
    u = strip(F.coalesce(url, F.lit("")))
    return F.when((u == "") | u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))


def host(url: Column) -> Column:
    """Lower-case host and port, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(with_scheme(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(with_scheme(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; empty if there is none."""
    raw = F.regexp_extract(with_scheme(url), rf"^[^?#]*\?(?:[^#]*&)??{name}=([^&#]+)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def long_video_id(url: Column) -> Column:
    """The id in addresses of the long-video site and of its short host; null for others."""
    h, p = host(url), path(url)
    short = F.regexp_extract(p, r"^/*([^/]*)", 1)
    watched = query_value(url, "v")
    placed = F.regexp_extract(p, r"/(?:shorts|embed|live)/([^/?#&]+)", 1)
    found = F.when(h == "youtu.be", short).when(h.contains("youtube.com"), F.when(p.startswith("/watch"), watched).otherwise(placed))
    return F.when(found != "", found)


def short_video_id(url: Column) -> Column:
    """The digits after /video/ in addresses of the short-video site; null for others."""
    found = F.regexp_extract(with_scheme(url), r"(?iU)tiktok\.com/(?:@[\w.]+/)?video/(\d+)", 1)
    return F.when(found != "", found)


def is_placeholder(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(r"(?i)^TikTok video #\d+$")


def shown_title(title: Column, channel: Column, video_id: Column) -> Column:
    """The title, or one made of the channel where it is blank or a placeholder."""
    t = strip(F.coalesce(title, F.lit("")))
    return F.when((t == "") | is_placeholder(t), F.concat(F.lit("@"), F.coalesce(channel, video_id), F.lit(" TikTok video"))).otherwise(t)
