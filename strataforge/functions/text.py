"""Text expressions. All stay inside the JVM; nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, its separators and the camel-case boundary of the lexical index.
TOKEN = r"[A-Za-z0-9]+(?:[._$:/@-][A-Za-z0-9]+)*"
SEPARATORS = r"[._$:/@-]"  # between the segments of a token
CAMEL = r"([a-z0-9])([A-Z])"
_MARK = "\u0001"


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends (SQL trim only removes the ordinary one)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def structural_form(text: Column) -> Column:
    """Lower case, collapsed; null becomes the empty string."""
    return F.coalesce(F.lower(collapse(text)), F.lit(""))


def metadata_form(text: Column) -> Column:
    """Stripped lower case; null becomes the empty string, so a filter on "" finds missing values."""
    return F.coalesce(F.lower(strip(text)), F.lit(""))


def evidence_form(text: Column) -> Column:
    """For comparing quotations: straight quotes, plain hyphens, collapsed, lower case."""
    return F.lower(collapse(F.translate(text, "“”‘’–—", "\"\"''--")))


def compact_form(text: Column) -> Column:
    """ASCII letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def lexical_tokens(text: Column) -> Column:
    """Distinct lower-case tokens: each match, its segments between separators, and their camel-case parts.

    The segments of all matches are the runs of letters and digits of the text, so three passes of one pattern each do, without a step
    per token.
    """
    runs = "[A-Za-z0-9]+"
    camel = F.regexp_replace(text, CAMEL, f"$1{_MARK}$2")
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for t, p in ((text, TOKEN), (text, runs), (camel, runs))])
    distinct = F.array_distinct(F.array_remove(F.split(F.lower(F.array_join(found, " ")), " "), ""))
    return F.coalesce(distinct, F.array().cast("array<string>"))


def token_fragments(text: Column, size: int = 8) -> Column:
    """Windows of ``size`` tokens at start, middle and end; a shorter text whole."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    n = F.size(tokens)
    middle = F.greatest(F.lit(0), F.expr(f"0 + {size}") * 0 + (F.floor(n / 2) - size // 2)).cast("int")
    starts = F.array_sort(F.array_distinct(F.array(F.lit(0), middle, F.greatest(F.lit(0), n - size).cast("int"))))
    windows = F.transform(starts, lambda s: F.array_join(F.slice(tokens, s + 1, F.lit(size)), " "))
    return F.when(n <= size, F.array(F.array_join(tokens, " "))).otherwise(F.filter(windows, lambda w: w != ""))


def word_count(text: Column) -> Column:
    """Runs of anything but blanks."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def preview(text: Column, width: int = 140) -> Column:
    """One line of at most ``width`` code points."""
    flat = collapse(text)
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    cut = F.split(F.regexp_replace(text, r"\R$", ""), r"\R")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(cut)


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text as a timestamp; blank is null, a malformed value is null."""
    clean = strip(text)
    return F.try_to_timestamp(F.when(clean == "", None).otherwise(F.regexp_replace(clean, "[zZ]$", "+00:00")))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])
