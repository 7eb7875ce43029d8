"""Column rules about the account that published a post."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.contract import FIRST_YEAR, LAST_YEAR
from frameloom.functions.text import strip

# Category patterns; `_` is a one-character wildcard.
CHINA_PATTERN, RUSSIA_PATTERN = "China_%", "RF_%"
MEDIA_PATTERN, DIPLOMAT_PATTERN = "%Media%", "%Diplomat%"
LEGACY_PREFIXES = {"china_": "China", "rf_": "Russia", "russia_": "Russia"}


def source_country(category: Column) -> Column:
    return F.when(category.like(CHINA_PATTERN), "China").when(category.like(RUSSIA_PATTERN), "Russia")


def source_actor(category: Column) -> Column:
    """The country of the account as it appears among canonical actors."""
    return F.lower(source_country(category))


def account_type(category: Column) -> Column:
    return F.when(category.like(MEDIA_PATTERN), "Media").when(category.like(DIPLOMAT_PATTERN), "Diplomatic")


def source_country_legacy(explicit: Column, category: Column) -> Column:
    """An explicit country wins; else a literal, case-folded category prefix."""
    folded = F.lower(strip(category))
    guess = F.lit("Unknown")
    for prefix, country in reversed(LEGACY_PREFIXES.items()):
        guess = F.when(folded.startswith(prefix), country).otherwise(guess)
    return F.coalesce(F.nullif(strip(explicit), F.lit("")), guess)


def is_state_account(category: Column) -> Column:
    """Chinese or Russian account. The prefix tests are implied by the patterns
    and are there because, unlike them, they reach the Parquet reader."""
    prefix = category.startswith("China") | category.startswith("RF")
    return prefix & (category.like(CHINA_PATTERN) | category.like(RUSSIA_PATTERN))


def in_years(year: Column, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    return year.between(first, last)
