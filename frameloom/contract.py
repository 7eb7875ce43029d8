"""Names and values shared with the data files.

Fixed values: every string, number and pattern below is part of the data
contract and must stay exactly as written, or results stop matching the files
people already have.
"""

# --- fixed values: label taxonomy -------------------------------------------
NO_CATEGORY = "No Category"
INVALID_LABEL = "Invalid label"

TASK_LABELS = {
    "AUT": (
        "Authoritarian - Military/Security",
        "Authoritarian - Economic Influence",
        "Authoritarian - Digital",
        "Authoritarian - Legal Tools for Entrenchment",
        "Authoritarian - Alliances",
        "Authoritarian - Ideological Promotion",
    ),
    "DEM": (
        "Democracy - Values and Rights",
        "Democracy - Elections",
        "Democracy - Institutions",
        "Democracy - Civil Society",
    ),
    "WEST": (
        "WI - Declining West",
        "WI - Western induced Regime Change/Internal Instability",
        "WI - Hostile Global Order",
        "WI - Specific Adversary Framing",
    ),
}

# --- fixed values: column names ---------------------------------------------
TASK_COLUMNS = {"AUT": "aut", "DEM": "dem", "WEST": "west"}
FRAME_COLUMNS = {"AUT": "aut_frame", "DEM": "dem_frame", "WEST": "west_frame"}
FOCAL_COLUMN = "focal"
VALENCE_COLUMN = "focal_valence"

# --- fixed values: raw post columns, in file order --------------------------
BASE_COLUMNS = (
    "source",
    "category",
    "title",
    "link",
    "text",
    "image source",
    "image alt text",
    "date posted",
    "username",
    "hashtags",
    "number of likes",
    "number of comments",
    "number of views",
    "standardized_date",
)

# --- fixed values: limits ---------------------------------------------------
TEXT_CUTS = (2500, 1800, 1200, 800, 400)
FIRST_YEAR, LAST_YEAR = 2020, 2025
TOP_ACTORS = 1000
TOP_REPORTED = 50
MAX_TERMS = 100_000
PILOT_SIZE = 24

# --- fixed values: actors and stance ----------------------------------------
NO_ACTOR = "None"
OTHER_ACTOR = "Other"
VALENCES = ("Pro", "Anti", "Neutral")
VALENCE_ALIASES = {"Positive": "Pro", "Negative": "Anti"}
NOT_APPLICABLE = "Not Applicable"

# --- fixed values: profiling display ----------------------------------------
BLANK = "[blank]"
NO_COMBINATION = "[none]"
MISSING_WORDS = ("nan", "none", "null")

# --- fixed values: audit columns and long-to-short label names --------------
FRAME_ALIASES = {
    "aut": ("aut", "AUT_LABEL"),
    "dem": ("dem", "DEM_LABEL"),
    "west": ("west", "WEST_LABEL"),
}
FOCAL_ALIASES = ("focal", "FOCAL_COUNTRY")
FRAME_FLAG = "Label_value Correct?"
FOCAL_FLAG = "Focal Country Correct?"

SCORING_NAMES = {
    "no categor": "No Category",
    "no category": "No Category",
    "authoritarian - military/security": "Military/Security Promotion",
    "authoritarian - military / security": "Military/Security Promotion",
    "authoritarian - economic influence": "Economic Influence",
    "authoritarian - digital": "Digital Control and Surveillance",
    "authoritarian - legal tools for entrenchment": "Legal Entrenchment",
    "authoritarian - alliances": "Alliances",
    "authoritarian - ideological promotion": "Ideological Promotion",
    "democracy - values and rights": "Values and Rights",
    "democracy - elections": "Elections",
    "democracy - institutions": "Institutions",
    "democracy - civil society": "Civil Society",
    "declining west": "Declining West",
    "regime change / internal instability": "Western induced Regime Change/Internal Instability",
    "western induced regime change/internal instability": "Western induced Regime Change/Internal Instability",
    "hostile global order": "Hostile Global Order",
    "specific adversary framing": "Specific Adversary Framing",
    "wi - declining west": "Declining West",
    "wi - western induced regime change/internal instability": "Western induced Regime Change/Internal Instability",
    "wi - hostile global order": "Hostile Global Order",
    "wi - specific adversary framing": "Specific Adversary Framing",
    "oecd/west": "OECD",
    "other": "Other",
}

# --- fixed values: structured model inputs ----------------------------------
STRUCTURED_COLUMNS = (
    "source_country",
    "account_type",
    "frame_domain",
    "frame_subframe",
    "focal_actor",
)
STRATUM_COLUMNS = ("source_country", "account_type", "frame_domain")
POST_KEY = ("merge_key", "key_occurrence")
APPLICATION_KEY = ("merge_key", "key_occurrence", "frame_domain")


def allowed_labels(task: str) -> list[str]:
    """Labels a reply to this task may carry."""
    return [*TASK_LABELS[task], NO_CATEGORY]
