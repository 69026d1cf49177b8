"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The newline scalars: LF VT FF CR NEL LS PS. CR LF counts as two of them.
NEWLINES = "\n\u000b\f\r\u0085\u2028\u2029"

# Unicode separators plus tab and the newline scalars.
BLANKS = (
    " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t"
    + NEWLINES
)

# LF as a whole character: the LF of a CR LF pair is not one.
LINE_BREAK = r"(?<!\r)\n"


# Any of them but LF.
RARE_NEWLINES = r"[\x0B\f\r\u0085\u2028\u2029]"


def lf_count(text: Column) -> Column:
    """Number of LF, counted by bytes."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def newline_count(text: Column) -> Column:
    """Number of newline scalars; most texts have no other than LF and take the cheap way."""
    every = F.length(text) - F.length(F.translate(text, NEWLINES, ""))
    return F.when(text.rlike(RARE_NEWLINES), every).otherwise(lf_count(text))


def line_count(text: Column) -> Column:
    """Number of parts that the newline scalars cut ``text`` into."""
    return newline_count(text) + 1


def grapheme_count(text: Column) -> Column:
    """Number of extended grapheme clusters: what a reader sees as one character, CR LF included."""
    return F.regexp_count(text, F.lit(r"\X"))


def has_more_graphemes(text: Column, limit: int) -> Column:
    """More than ``limit`` clusters? Only texts with more code points than that are cut into clusters."""
    return F.when(F.length(text) > limit, grapheme_count(text) > limit).otherwise(F.length(text) > limit)


def trim_blank(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the last component, '' if there is none."""
    return F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1)


def components(path: Column) -> Column:
    return F.split(path, "/")


def lines(text: Column, limit: int = -1) -> Column:
    return F.split(text, LINE_BREAK, limit)


def head_lines(text: Column, count: int) -> Column:
    """The first ``count`` lines joined by LF; the rest of the text is not split at all."""
    if count < 0:
        raise ValueError("line count must not be negative")
    return F.array_join(F.slice(lines(text, count + 1), 1, count), "\n")


def clean_markdown(text: Column) -> Column:
    return trim_blank(F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("`"), F.lit("")))


def strip_bullets(text: Column) -> Column:
    for mark in ("- ", "* ", "• "):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return trim_blank(text)


def clean_lines(text: Column) -> Column:
    """All lines, markdown removed, empty ones dropped."""
    return F.filter(F.transform(lines(text), clean_markdown), lambda line: line != "")
