"""Label clean-up, reply parsing and allow-list matching as column expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.contract import (
    BLANK,
    MISSING_WORDS,
    NO_CATEGORY,
    SCORING_NAMES,
    VALENCE_ALIASES,
)
from frameloom.functions.text import collapse, strip

# Patterns a model reply is read with.
NO_CATEGORY_PREFIX = "no categor"
BRACKETS = "(?s)\\[(.*?)\\]"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def lookup(value: Column, names: Mapping[str, str]) -> Column:
    """Literal dictionary lookup; null when absent."""
    if not names:
        return F.lit(None).cast("string")
    pairs = [F.lit(item) for pair in names.items() for item in pair]
    return F.create_map(*pairs)[value]


def normalize_label(value: Column) -> Column:
    label = strip(value)
    return F.when(F.lower(label).startswith(NO_CATEGORY_PREFIX), NO_CATEGORY).otherwise(label)


def profile_value(value: Column) -> Column:
    """Label clean-up that also reads the usual missing-value words as blank."""
    label = strip(value)
    return F.when(F.lower(label).isin(*MISSING_WORDS), "").otherwise(normalize_label(label))


def display_value(value: Column) -> Column:
    return F.when(value == "", BLANK).otherwise(value)


def scoring_name(value: Column) -> Column:
    """Short name of a long label; unknown labels stay, missing words are blank."""
    label = strip(value)
    folded = F.lower(label)
    return F.when(folded.isin(*MISSING_WORDS), "").otherwise(F.coalesce(lookup(folded, SCORING_NAMES), label))


def fold_label(value: Column) -> Column:
    return F.lower(collapse(normalize_label(value)))


def match_label(value: Column, allowed: Sequence[str]) -> Column:
    """The allowed label this value stands for, ignoring case and spacing.

    Null when there is none, or when two allowed labels fold alike.
    """
    folds = {label: " ".join(label.split()).lower() for label in allowed}
    shared = Counter(folds.values())
    unique = {fold: label for label, fold in folds.items() if shared[fold] == 1}
    label = normalize_label(value)
    return F.when(label.isin(*allowed), label).otherwise(lookup(fold_label(value), unique))


def _unquote(value: Column) -> Column:
    return F.btrim(F.btrim(strip(value), F.lit('"')), F.lit("'"))


def parse_reply(reply: Column) -> Column:
    """The label inside a reply: first list item, else first bracketed piece,
    else first line; quotes removed."""
    text = strip(reply)
    listed = F.when(
        text.startswith("[") & text.endswith("]"),
        F.get(F.from_json(text, "array<string>"), F.lit(0)),
    )
    bracketed = F.when(
        text.rlike(BRACKETS),
        F.split(F.regexp_extract(text, BRACKETS, 1), ",", 2)[0],
    )
    return _unquote(F.coalesce(listed, bracketed, F.split(text, LINE_BREAK, 2)[0]))


def read_reply(reply: Column) -> Column:
    return normalize_label(parse_reply(reply))


def canonical_valence(value: Column) -> Column:
    return F.coalesce(lookup(value, VALENCE_ALIASES), value)


def is_yes(value: Column) -> Column:
    return F.upper(strip(value)) == "Y"


def percent(part: Column, whole: Column) -> Column:
    """Percentage, 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))
