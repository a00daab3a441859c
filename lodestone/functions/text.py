"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a question as a follow-up.
FOLLOW_UP_START = r"(?i)(?U)^\s*(and\b|also\b|what about\b|how about\b|what else\b)"
FOLLOW_UP_REFERENCE = r"(?i)(?U)\b(it|its|this|that|these|those|they|them|same|former|latter)\b"
FOLLOW_UP_WORDS = 20


def strip(text: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def is_follow_up(question: Column) -> Column:
    """Up to 20 words that begin like a follow-up or refer back."""
    words = F.size(F.split(strip(question), r"(?U)\s+"))
    return (words <= FOLLOW_UP_WORDS) & (question.rlike(FOLLOW_UP_START) | question.rlike(FOLLOW_UP_REFERENCE))


def title(question: Column) -> Column:
    """The first 157 characters, with dots where there are more."""
    return F.concat(F.left(question, F.lit(157)), F.when(F.char_length(question) > 157, "...").otherwise(""))


def suffix(name: Column) -> Column:
    """The lower-case extension with its dot, or an empty string."""
    return F.regexp_extract(F.lower(name), r"[^./\\](\.[^./\\]+)$", 1)


def safe_name(name: Column) -> Column:
    """The last part of a path with either slash, printable and trimmed, at most 255 characters."""
    last = F.substring_index(F.translate(name, "\\", "/"), "/", -1)
    clean = strip(F.regexp_replace(last, r"[\p{C}\p{Zl}\p{Zp}]", ""))
    return F.left(F.when(clean == "", F.concat(F.lit("document"), suffix(name))).otherwise(clean), F.lit(255))


def file_size(size: Column) -> Column:
    """As people read it: whole KB, at least 1, below a megabyte, else MB with one decimal."""
    kb = F.greatest(F.lit(1), F.floor(size / 1024 + 0.5)).cast("string")
    mb = F.format_string("%.1f MB", F.floor(size / 1048576 * 10 + 0.5) / 10)
    return F.when(size < 1048576, F.concat(kb, F.lit(" KB"))).otherwise(mb)


def progress(received: Column, total: Column) -> Column:
    """Whole percent received, at most 100; 0 of nothing."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(100 * received / F.nullif(total, F.lit(0))))).otherwise(0).cast("int")
