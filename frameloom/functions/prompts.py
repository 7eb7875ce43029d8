"""Prompt texts and their rendering as column expressions.

Templates are ordinary strings with `{name}` fields. The post always comes last
so that the fixed part of a prompt is a common prefix.
"""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.contract import NO_CATEGORY, TASK_LABELS, allowed_labels
from frameloom.functions.text import strip

TASK_TOPICS = {
    "AUT": "how the post supports, excuses or advances authoritarian rule",
    "DEM": "which part of democratic life the post talks about",
    "WEST": "how the post accuses or belittles Western countries",
}

POST_PART = '\nPost:\n"{text}"\n'


def _task_template(task: str) -> str:
    labels = "".join(f"- {label}\n" for label in TASK_LABELS[task])
    return (
        f"Read one social-media post in any language and decide {TASK_TOPICS[task]}.\n"
        f"Pick the label that fits its main theme:\n{labels}"
        f"Answer {NO_CATEGORY} when none fits. Give the label alone.\n" + POST_PART
    )


TASK_TEMPLATES = {task: _task_template(task) for task in TASK_LABELS}

FOCAL_TEMPLATE = (
    "Name the countries, alliances or international organizations this post judges, "
    "most strongly judged first.\n"
    "Give at most three short English names separated by semicolons, or None. "
    "Leave out people, local bodies and anything only mentioned in passing.\n" + POST_PART
)

VALENCE_TEMPLATE = (
    "A {account_type} account from {source_country} published this post about {focal_country}.\n"
    "Say whether it shows {focal_country} in a good light (Pro), a bad light (Anti) "
    "or neither (Neutral). Give one word.\n" + POST_PART
)

VALENCE_GENERAL_TEMPLATE = (
    "A {account_type} account from {source_country} published this post.\n"
    "Say whether it shows its subject in a good light (Pro), a bad light (Anti) "
    "or neither (Neutral). Give one word.\n" + POST_PART
)

STRICT_SUFFIX = "\nAnswer with exactly one entry of this list and nothing else:\n{labels}\n"

REPAIR_TEMPLATE = (
    "Your earlier answer for the {task} labels is not on the list.\n"
    "Answer with exactly one entry of this list and nothing else:\n{labels}\n"
    'Earlier answer:\n"{answer}"\n' + POST_PART
)


def label_lines(labels: Sequence[str]) -> str:
    return "\n".join(f"- {label}" for label in labels)


def pieces(template: str) -> list[tuple[str, str | None]]:
    """The template as (fixed text, field name) pairs."""
    return [(fixed, field) for fixed, field, _, _ in string.Formatter().parse(template)]


def render(template: str, fields: Mapping[str, Column]) -> Column:
    parts: list[Column] = []
    for fixed, field in pieces(template):
        if fixed:
            parts.append(F.lit(fixed))
        if field:
            parts.append(F.coalesce(fields[field].cast("string"), F.lit("")))
    return F.concat(*parts)


#: Stands for the post in a frame; what is behind its last place is fixed text.
POST_MARK = "\0"


def frame(template: str) -> str:
    """A template without other fields than the post, as a frame."""
    return "".join(fixed + (POST_MARK if field == "text" else "") for fixed, field in pieces(template))


def strict(template: str, labels: Sequence[str]) -> str:
    """The template with the allow-list instruction added at its end."""
    return template.rstrip() + "\n" + STRICT_SUFFIX.replace("{labels}", label_lines(labels))


def task_prompt(task: str, text: Column) -> Column:
    return render(TASK_TEMPLATES[task], {"text": text})


def focal_prompt(text: Column) -> Column:
    return render(FOCAL_TEMPLATE, {"text": text})


def repair_prompt(task: str, labels: Sequence[str], answer: Column, text: Column) -> Column:
    fields = {"task": F.lit(task), "labels": F.lit(label_lines(labels)), "answer": answer, "text": text}
    return render(REPAIR_TEMPLATE, fields)


def wants_general_prompt(focal_actor: Column) -> Column:
    """True when no particular actor was found for the post."""
    return F.lower(strip(focal_actor)).isin("", "none", "other")


def valence_prompt(
    text: Column,
    focal_actor: Column,
    country: Column,
    account: Column,
    labels: Sequence[str],
) -> Column:
    fields = {
        "text": text,
        "focal_country": F.coalesce(F.nullif(focal_actor, F.lit("")), F.lit("None")),
        "source_country": F.coalesce(country, F.lit("None")),
        "account_type": F.coalesce(account, F.lit("None")),
    }
    return F.when(
        wants_general_prompt(focal_actor), render(strict(VALENCE_GENERAL_TEMPLATE, labels), fields)
    ).otherwise(render(strict(VALENCE_TEMPLATE, labels), fields))


__all__ = [
    "TASK_TEMPLATES",
    "FOCAL_TEMPLATE",
    "VALENCE_TEMPLATE",
    "VALENCE_GENERAL_TEMPLATE",
    "REPAIR_TEMPLATE",
    "allowed_labels",
    "focal_prompt",
    "frame",
    "label_lines",
    "pieces",
    "render",
    "repair_prompt",
    "strict",
    "task_prompt",
    "valence_prompt",
    "wants_general_prompt",
]
