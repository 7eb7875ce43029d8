"""Text clean-up, content keys and length cuts, all as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.contract import TEXT_CUTS

# The characters a Unicode white-space strip removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
FIELD_SEPARATOR = "\x1f"
KEY_BLANKS = ("\t", "\n", "\f", "\r")
ELLIPSIS = " ..."


def strip(text: Column) -> Column:
    """Remove all Unicode white space at both ends; null becomes blank."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))


def collapse(text: Column) -> Column:
    """Every run of Unicode white space becomes one space."""
    return F.regexp_replace(text, f"[{WHITE_SPACE}]+", " ")


def has_text(text: Column) -> Column:
    """Not null and not only spaces."""
    return text.isNotNull() & (F.trim(text) != "")


def _one_space(text: Column) -> Column:
    """Every run of spaces, tabs and line breaks becomes one space. Plain replaces do
    most of the work; the pattern only runs where a double space is left."""
    spaced = text
    for blank in KEY_BLANKS:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)


def content_key(source: Column, link: Column, date: Column, text: Column) -> Column:
    """SHA-256 hex over the four fields, spaces trimmed and blanks collapsed."""
    fields = [_one_space(F.trim(F.coalesce(field, F.lit("")))) for field in (source, link, date, text)]
    return F.sha2(F.concat_ws(FIELD_SEPARATOR, *fields), 256)


def seeded_digest(seed: int | str, *parts: Column) -> Column:
    """Repeatable pseudo-random order: MD5 hex of the parts and the seed."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.md5(F.concat_ws(FIELD_SEPARATOR, *texts, F.lit(str(seed))))


def _cut(whole: Column, limit: int) -> Column:
    head = F.substring(whole, 1, limit)
    partial_word = F.substring_index(head, " ", -1)
    kept = F.substring(head, F.lit(1), F.lit(limit - 1) - F.char_length(partial_word))
    shortened = F.when(F.contains(head, F.lit(" ")), kept).otherwise(head)
    return F.when(F.char_length(whole) <= limit, whole).otherwise(F.concat(shortened, F.lit(ELLIPSIS)))


def cut_text(text: Column, limit: int) -> Column:
    """Whole text when short enough, else cut at the last space before `limit`."""
    return _cut(strip(text), limit)


def cut_ladder(text: Column, limits: Sequence[int] = TEXT_CUTS) -> Column:
    """The text at each limit, longest first, without repeats."""
    # What is left after one character more than the longest cut is never shown.
    enough = F.substring(strip(text), 1, max(limits) + 1)
    return F.array_distinct(F.array(*[_cut(enough, limit) for limit in sorted(limits, reverse=True)]))
