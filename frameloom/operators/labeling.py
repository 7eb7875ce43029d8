"""Labeling posts with an injected labeler, as one linear Spark job.

A labeler is a picklable function `labeler(task)` that is called once per
partition and returns `answer(prompts)`. `answer` gets a batch, one sequence of
prompts per row, longest text first, and returns one `(reply, cut, error)` per
row: the raw reply, the index of the prompt that was accepted, and an error text
when the row failed. A prompt is put together when it is looked at.

A row's longest cut travels to Python once, whatever the number of tasks, and beside it
the sizes of the shorter ones and the frame of each prompt, unless it is the same for all rows; everything around the
call is column expressions. There are at most three passes: first answers of all tasks, repairs of
answers off the list, focal actors. Each pass adds columns to the rows of the pass
before, so a row is asked once per pass and nothing is joined back. Rows that need
no call carry a null prompt and cost nothing. Write the result before sorting it or using it
twice: Spark would run the labeler again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from frameloom.contract import (
    FOCAL_COLUMN,
    NO_CATEGORY,
    TASK_COLUMNS,
    TASK_LABELS,
    TEXT_CUTS,
    VALENCE_ALIASES,
    VALENCE_COLUMN,
    VALENCES,
    allowed_labels,
)
from frameloom.functions.labels import canonical_valence, match_label, normalize_label, read_reply
from frameloom.functions.prompts import (
    FOCAL_TEMPLATE,
    POST_MARK,
    TASK_TEMPLATES,
    frame,
    repair_prompt,
    valence_prompt,
)
from frameloom.functions.text import ELLIPSIS, cut_ladder, strip

Answer = tuple[str | None, int, str | None]
Answerer = Callable[[Sequence[Sequence[str]]], list[Answer]]
Labeler = Callable[[str], Answerer]

FOCAL_TASK, VALENCE_TASK, REPAIR = "FOCAL", "VALENCE", ":repair"
VALENCE_ANSWERS = (*VALENCES, *VALENCE_ALIASES)


class Prompts(Sequence):
    """A frame with each of a row's cuts from `start` on in the place of the post."""

    def __init__(self, frame: str, cuts: Sequence[str], start: int = 0):
        self.before, _, self.after = frame.rpartition(POST_MARK)
        self.cuts, self.start = cuts, start

    def __len__(self) -> int:
        return len(self.cuts) - self.start

    def __getitem__(self, at: int) -> str:
        if not 0 <= at < len(self):
            raise IndexError(at)
        return f"{self.before}{self.cuts[self.start + at]}{self.after}"


class Cuts(Sequence):
    """The cuts of a text from the longest one and the sizes of the others, each put together
    when it is looked at. All but the longest end in an ellipsis."""

    def __init__(self, longest: str, sizes: Sequence[int]):
        self.longest, self.sizes = longest, sizes

    def __len__(self) -> int:
        return 1 + len(self.sizes)

    def __getitem__(self, at: int) -> str:
        return self.longest if at == 0 else self.longest[: self.sizes[at - 1] - len(ELLIPSIS)] + ELLIPSIS


class TextTooLong(Exception):
    """Raised by an ask function when the prompt does not fit the model."""


def try_shorter(ask: Callable[[str], str]) -> Answerer:
    """Turn `ask(prompt) -> reply` into an answerer that falls back to the next
    shorter prompt when one is too long. Any other error fails the row at once."""

    def answer_row(prompts: Sequence[str]) -> Answer:
        failure = "no prompt"
        for cut, prompt in enumerate(prompts):
            try:
                return ask(prompt), cut, None
            except Exception as error:
                failure = f"{type(error).__name__}: {error}"
                if type(error).__name__ != "TextTooLong":
                    break
        return None, len(prompts) - 1, failure

    return lambda rows: [answer_row(prompts) for prompts in rows]


# --- columns and tasks -------------------------------------------------------------


def parse_tasks(words: Sequence[str] | None) -> list[str]:
    """Task names from words that may hold commas; all tasks when none is given."""
    if not words:
        return list(TASK_LABELS)
    names = [part.strip().upper() for word in words for part in word.split(",")]
    wanted = list(dict.fromkeys(name for name in names if name))
    unknown = [name for name in wanted if name not in TASK_LABELS]
    if unknown or not wanted:
        raise ValueError(f"Unknown tasks {unknown}; choose from {', '.join(TASK_LABELS)}.")
    return wanted


def label_columns(tasks: Sequence[str], focal: bool = False, prefix: str = "") -> list[str]:
    names = [TASK_COLUMNS[task] for task in tasks] + ([FOCAL_COLUMN] if focal else [])
    return [prefix + name for name in names]


def output_columns(input_columns: Sequence[str], labels: Sequence[str]) -> list[str]:
    """Input columns, then the label columns that are not among them."""
    return list(dict.fromkeys([*input_columns, *labels]))


# --- one pass -----------------------------------------------------------------------


def ask(
    frames: Mapping[str, str | Column], labeler: Labeler, suffix: str = "", starts: Mapping[str, Column] | None = None
) -> Column:
    """Ask the prompts of several tasks in one Python stage.

    A task's frame is one for all rows, or a column that is null where nothing is
    asked; `starts` says from which of the cuts in `_cuts` on. Gives a struct with
    `reply_<task>`, `cut_<task>` and `error_<task>`, null where nothing was asked. A
    row that failed is not asked for its later tasks.
    """
    tasks = list(frames)
    fixed = {task: frame for task, frame in frames.items() if isinstance(frame, str)}
    sent = [task for task in tasks if task not in fixed]
    fields = ", ".join(f"reply_{task} string, cut_{task} int, error_{task} string" for task in tasks)

    @F.pandas_udf(fields)
    def call(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        answerers = [labeler(task + suffix) for task in tasks]
        for batch in batches:
            longest, sizes, *rest = batch
            given = dict(zip(sent, rest))
            begin = dict(zip(sent, rest[len(sent) :]))
            failed = pd.Series(False, index=longest.index)
            columns = []
            for answer, task in zip(answerers, tasks):
                frame = given.get(task, pd.Series(fixed.get(task), index=longest.index, dtype=object))
                asked = frame.index[frame.notna() & ~failed]
                prompts = [
                    Prompts(frame[i], Cuts(longest[i], sizes[i]), int(begin[task][i]) if task in begin else 0) for i in asked
                ]
                answers = answer(prompts) if prompts else []
                names = [f"reply_{task}", f"cut_{task}", f"error_{task}"]
                table = pd.DataFrame(answers, index=asked, columns=names).reindex(failed.index)
                failed |= table[names[2]].notna()
                columns.append(table.astype({names[1]: "Int32"}))
            yield pd.concat(columns, axis=1)

    # Shorter cuts are beginnings of the longest; only their sizes go along.
    sizes = F.transform(F.slice("_cuts", F.lit(2), F.size("_cuts")), F.char_length)
    columns = [F.get("_cuts", F.lit(0)), sizes, *(frames[task] for task in sent), *(starts[task] for task in sent if starts)]
    # Replies cost money and may differ: the optimizer must not repeat the call.
    return call.asNondeterministic()(*columns)


def _answered(task: str) -> Column:
    return F.col(f"_first.error_{task}").isNull() & F.col(f"_first.reply_{task}").isNotNull()


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def _ask_with_repair(
    df: DataFrame,
    frames: Mapping[str, str | Column],
    allowed: Mapping[str, Sequence[str]],
    labeler: Labeler,
) -> DataFrame:
    """Add `_label_<task>` (matched, or null), `_status_<task>` and `_error`.

    Expects the text ladder in `_cuts`. An answer off the list is asked again
    once, with the text cut that was accepted and, if need be, shorter ones.
    """
    return _repair(df.withColumn("_first", ask(frames, labeler)), allowed, labeler)


def _repair(df: DataFrame, allowed: Mapping[str, Sequence[str]], labeler: Labeler) -> DataFrame:
    tasks = list(allowed)
    read = df.withColumns({f"_read_{task}": read_reply(F.col(f"_first.reply_{task}")) for task in tasks})
    matched = read.withColumns(
        {
            f"_match_{task}": F.when(_answered(task), match_label(F.col(f"_read_{task}"), allowed[task]))
            for task in tasks
        }
    )
    lost = _any(F.col(f"_first.error_{task}").isNotNull() for task in tasks)
    again, starts = {}, {}
    for task in tasks:
        starts[task] = F.coalesce(F.col(f"_first.cut_{task}"), F.lit(0))
        repair = repair_prompt(task, allowed[task], F.col(f"_read_{task}"), F.lit(POST_MARK))
        again[task] = F.when(~lost & _answered(task) & F.col(f"_match_{task}").isNull(), repair)
    asked = matched.withColumn("_second", ask(again, labeler, REPAIR, starts))
    labels, statuses, errors = {}, {}, []
    for task in tasks:
        reply, error = F.col(f"_second.reply_{task}"), F.col(f"_second.error_{task}")
        second = F.when(error.isNull() & reply.isNotNull(), match_label(read_reply(reply), allowed[task]))
        error = F.coalesce(F.col(f"_first.error_{task}"), error)
        labels[f"_label_{task}"] = F.coalesce(F.col(f"_match_{task}"), second)
        statuses[f"_status_{task}"] = (
            F.when(F.col(f"_match_{task}").isNotNull(), "ok")
            .when(F.col(f"_label_{task}").isNotNull(), "repaired")
            .when(error.isNotNull(), "error")
            .when(_answered(task), "invalid")
        )
        errors.append(error)
    done = asked.withColumns(labels).withColumns({**statuses, "_error": F.coalesce(*errors)})
    return done.drop(
        "_first", "_second", *[f"_read_{task}" for task in tasks], *[f"_match_{task}" for task in tasks]
    )


def _stop(failed: Column, error: Column) -> Column:
    """`failed`, as a test that stops the job instead of being true."""
    message = F.concat_ws(" ", F.lit("Labeling failed:"), F.coalesce(error, F.lit("answer not on the list")))
    return F.when(failed, F.raise_error(message).cast("boolean")).otherwise(F.lit(False))


def validate_and_repair(
    df: DataFrame, task: str, allowed: Sequence[str], labeler: Labeler, reply: str = "reply", text: str = "text"
) -> DataFrame:
    """Check given replies against the allow-list and ask once more for the rest.

    Adds `label` (null if still not on the list) and `status`: ok, repaired,
    invalid or error.
    """
    given = F.struct(
        F.col(reply).alias(f"reply_{task}"),
        F.lit(0).alias(f"cut_{task}"),
        F.lit(None).cast("string").alias(f"error_{task}"),
    )
    ready = df.withColumns({"_cuts": cut_ladder(F.col(text)), "_first": given})
    return (
        _repair(ready, {task: allowed}, labeler)
        .withColumnsRenamed({f"_label_{task}": "label", f"_status_{task}": "status"})
        .drop("_cuts", "_error")
    )


# --- labeling jobs -----------------------------------------------------------------------


def wants_focal(labels: Sequence[Column]) -> Column:
    """True when some task found a real category."""
    any_content = F.lit(False)
    for label in labels:
        any_content = any_content | (normalize_label(label) != NO_CATEGORY)
    return any_content


def label_posts(
    df: DataFrame,
    tasks: Sequence[str],
    labeler: Labeler,
    focal: bool = False,
    text: str = "text",
    prefix: str = "",
    on_error: str = "blank",
    cuts: Sequence[int] = TEXT_CUTS,
) -> DataFrame:
    """Add one label per task, and the focal actors where a task found content.

    `on_error`: "blank" leaves all labels of a failed row empty, "raise" stops the
    job. A row that failed is not asked for its remaining labels.
    """
    columns = label_columns(tasks, focal, prefix)
    ready = df.withColumn("_cuts", cut_ladder(F.coalesce(F.col(text), F.lit("")), cuts))
    frames = {task: frame(TASK_TEMPLATES[task]) for task in tasks}
    rows = _ask_with_repair(ready, frames, {task: allowed_labels(task) for task in tasks}, labeler)
    found = [F.col(f"_label_{task}") for task in tasks]
    failed = _any(label.isNull() for label in found)
    rows = rows.withColumn("_failed", _stop(failed, F.col("_error")) if on_error == "raise" else failed)
    if focal:
        gate = ~F.col("_failed") & wants_focal(found)
        rows = _ask_focal(rows, labeler, gate)
        error = F.col("_answer.error_FOCAL")
        lost = _stop(error.isNotNull(), error) if on_error == "raise" else error.isNotNull()
        rows = rows.withColumn("_failed", F.col("_failed") | lost)
        found = [*found, read_reply(F.col("_answer.reply_FOCAL"))]
    shown = {
        name: F.when(F.col("_failed"), "").otherwise(F.coalesce(value, F.lit("")))
        for name, value in zip(columns, found)
    }
    return rows.withColumns(shown).select(*output_columns(df.columns, columns))


def _ask_focal(df: DataFrame, labeler: Labeler, when: Column) -> DataFrame:
    return df.withColumn("_answer", ask({FOCAL_TASK: F.when(when, F.lit(frame(FOCAL_TEMPLATE)))}, labeler))


def label_shown(
    df: DataFrame, task: str, labeler: Labeler, text: str = "text", cuts: Sequence[int] = TEXT_CUTS
) -> DataFrame:
    """One task's reply to each text, how many characters of the text the accepted prompt
    showed, and whether none was accepted. Null texts count as empty."""
    ready = df.withColumn("_cuts", cut_ladder(F.coalesce(F.col(text), F.lit("")), cuts))
    asked = ready.withColumn("_answer", ask({task: frame(TASK_TEMPLATES[task])}, labeler))
    failed = F.col(f"_answer.error_{task}").isNotNull()
    shown = F.when(~failed, F.char_length(F.get("_cuts", F.col(f"_answer.cut_{task}"))))
    return asked.select(
        *df.columns, F.when(~failed, F.col(f"_answer.reply_{task}")).alias("reply"), shown.alias("shown"), failed.alias("failed")
    )


def label_focal(
    df: DataFrame, labeler: Labeler, text: str = "text", prefix: str = "", on_error: str = "raise"
) -> DataFrame:
    """Focal actors of every row, without a gate and without an allow-list."""
    column = prefix + FOCAL_COLUMN
    ready = df.withColumn("_cuts", cut_ladder(F.coalesce(F.col(text), F.lit(""))))
    asked = _ask_focal(ready, labeler, F.lit(True))
    error = F.col("_answer.error_FOCAL")
    failed = _stop(error.isNotNull(), error) if on_error == "raise" else error.isNotNull()
    value = F.when(failed, "").otherwise(read_reply(F.col("_answer.reply_FOCAL")))
    return asked.withColumn(column, value).select(*output_columns(df.columns, [column]))


def label_valence(
    df: DataFrame, labeler: Labeler, default: str = "Neutral", status: bool = False
) -> DataFrame:
    """Stance of a post towards its focal actor, in the fixed three words. A row
    whose labeling failed gets `default`."""
    ready = df.withColumn("_cuts", cut_ladder(F.col("text")))

    shown = valence_prompt(
        F.lit(POST_MARK), F.col("focal_actor"), F.col("source_country"), F.col("account_type"), VALENCE_ANSWERS
    )
    asked = _ask_with_repair(ready, {VALENCE_TASK: shown}, {VALENCE_TASK: VALENCE_ANSWERS}, labeler)
    valence = F.coalesce(canonical_valence(F.col(f"_label_{VALENCE_TASK}")), F.lit(default))
    kept = output_columns(df.columns, [VALENCE_COLUMN])
    extra = [F.col(f"_status_{VALENCE_TASK}").alias("status")] if status else []
    return asked.withColumn(VALENCE_COLUMN, valence).select(*kept, *extra)


# --- resume and progress ---------------------------------------------------------------------


def is_complete(tasks: Sequence[str], focal: bool = False, prefix: str = "") -> Column:
    """All task labels filled; the focal label too, unless no task found content."""
    labels = [F.col(prefix + TASK_COLUMNS[task]) for task in tasks]
    done = F.lit(True)
    for label in labels:
        done = done & (strip(label) != "")
    if focal:
        done = done & (~wants_focal(labels) | (strip(F.col(prefix + FOCAL_COLUMN)) != ""))
    return done


def unfinished(
    posts: DataFrame, done: DataFrame, key: Sequence[str], tasks: Sequence[str], focal: bool = False, prefix: str = ""
) -> DataFrame:
    """Input rows without a complete output row, matched by key."""
    missing = [name for name in label_columns(tasks, focal, prefix) if name not in done.columns]
    if missing:
        raise ValueError(f"The existing output lacks {', '.join(missing)}; choose another output.")
    finished = done.filter(is_complete(tasks, focal, prefix)).select(*key)
    return posts.join(finished, list(key), "left_anti")


def progress(posts: DataFrame, pending: DataFrame) -> DataFrame:
    """One row with total and remaining posts."""
    total = posts.agg(F.count(F.lit(1)).alias("total"))
    left = pending.agg(F.count(F.lit(1))).scalar()
    return total.select("total", left.alias("remaining"), (F.col("total") - left).alias("done"))


def observe_labels(df: DataFrame, columns: Sequence[str], name: str = "labels") -> tuple[DataFrame, Observation]:
    """Count rows and blank labels while the job that writes them runs."""
    watch = Observation(name)
    blanks = [F.count_if(F.col(column) == "").alias(f"blank_{column}") for column in columns]
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *blanks), watch
