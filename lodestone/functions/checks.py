"""Whether values are ones that may be stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import strip

# The least and most characters of what people enter.
USERNAME, PASSWORD, NAME, DESCRIPTION, FILE_NAME = (3, 64), (12, 128), (1, 120), (0, 2_000), (1, 255)
# Hosts that may be reached without encryption.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "host.docker.internal", "ollama")


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def is_username(text: Column) -> Column:
    """Letters, digits, dots, underscores and hyphens, of either case."""
    return F.coalesce(text.rlike(r"\A[A-Za-z0-9._-]+\z") & _sized(text, USERNAME), F.lit(False))


def is_password(text: Column) -> Column:
    return F.coalesce(_sized(text, PASSWORD), F.lit(False))


def is_name(text: Column) -> Column:
    """Not blank, and not too long without the white space around it."""
    return F.coalesce(_sized(strip(text), NAME), F.lit(False))


def is_description(text: Column) -> Column:
    return text.isNull() | _sized(text, DESCRIPTION)


def is_file_name(text: Column) -> Column:
    return F.coalesce(_sized(strip(text), FILE_NAME), F.lit(False))


def provider_url(url: Column) -> Column:
    """A provider's address without slashes at its end; null unless it is encrypted or on this machine or network."""
    scheme = F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"\A[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(authority, r"\A(\[[^\]]*\]|[^:]*)", 1), r"[\[\]]", ""))
    safe = (scheme == "https") | ((scheme == "http") & host.isin(*LOCAL_HOSTS))
    return F.when(safe, F.rtrim(url, F.lit("/")))


def is_inside(path: Column) -> Column:
    """Whether a relative path stays below the folder that it is joined to: it isn't absolute, and no prefix of it climbs
    out by dots."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("inside"))

    def step(state: Column, part: Column) -> Column:
        depth = state["depth"] + F.when(part == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), (state["inside"] & (depth >= 0)).alias("inside"))

    below = F.aggregate(parts, start, step, lambda s: s["inside"])
    return F.coalesce(below & ~path.rlike(r"\A([/\\]|[A-Za-z]:)"), F.lit(False))


def _sized(text: Column, bounds: tuple[int, int]) -> Column:
    return F.char_length(text).between(*bounds)
