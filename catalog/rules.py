"""A labeler without a model: the reply follows from the length of the prompt."""

from __future__ import annotations

from frameloom.contract import NO_CATEGORY, TASK_LABELS
from frameloom.operators.labeling import Answerer, TextTooLong, try_shorter


def _choices() -> dict[str, list[str]]:
    choices = {
        "FOCAL": ["China;USA", '"Russia"', "None"],
        "VALENCE": ["Pro", "Positive", "neutral", "unknown", "Anti", "Negative"],
        "VALENCE:repair": ["Negative", "unknown"],
    }
    for task, labels in TASK_LABELS.items():
        choices[task] = [labels[0], f'["{labels[1]}", "x"]', "No categories here", "unknown", labels[2].upper()]
        choices[f"{task}:repair"] = [labels[3], "unknown", NO_CATEGORY]
    return choices


CHOICES = _choices()


def rule_labeler(choices: dict[str, list[str]] = CHOICES):
    """A labeler whose reply to a prompt is the entry at the prompt's length."""

    def start(task: str) -> Answerer:
        replies = choices[task]
        return lambda rows: [(replies[len(prompts[0]) % len(replies)], 0, None) for prompts in rows]

    return start


def short_labeler(limit: int, choices: dict[str, list[str]] = CHOICES):
    """The same, but prompts of more than `limit` characters are too long for it."""

    def start(task: str) -> Answerer:
        replies = choices[task]

        def ask(prompt: str) -> str:
            if len(prompt) > limit:
                raise TextTooLong(f"{len(prompt)} characters")
            return replies[len(prompt) % len(replies)]

        return try_shorter(ask)

    return start
