"""Label expressions: normalization, groupings, ranks and cumulative targets."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagemill.constants import HIERARCHIES, LABEL_GROUPS, ORDERED_LABELS, TASKS
from triagemill.functions.text import strip


def normalize_label(col: Column) -> Column:
    return F.lower(strip(F.coalesce(col.cast("string"), F.lit(""))))


def lookup(col: Column, mapping: dict, message: str | None = None) -> Column:
    """Literal map lookup; a miss is NULL, or an error when ``message`` is given."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, col)
    if message is None:
        return found
    shown = F.concat(F.lit(message + ": "), F.coalesce(col.cast("string"), F.lit("<null>")))
    return F.coalesce(found, F.raise_error(shown))


def invert(groups: dict[str, list[str]]) -> dict[str, str]:
    return {label: group for group, labels in groups.items() for label in labels}


def grouped_label(col: Column, groups=LABEL_GROUPS, strict: bool = True) -> Column:
    message = "Grouped severity does not map label" if strict else None
    return lookup(normalize_label(col), invert(groups), message)


def task_label(col: Column, task: str) -> Column:
    if task not in TASKS:
        raise ValueError(f"Unknown task: {task}")
    return lookup(normalize_label(col), TASKS[task], "Invalid severity")


def hierarchy_group(col: Column, name: str) -> Column:
    if name not in HIERARCHIES:
        raise ValueError(f"Unknown hierarchy: {name}")
    return lookup(col, invert(HIERARCHIES[name]), f"Label outside {name}")


def label_to_rank(col: Column, ordered: list[str] = ORDERED_LABELS) -> Column:
    ranks = {label: rank for rank, label in enumerate(ordered)}
    return lookup(col, ranks, "Invalid severity label")


def rank_to_label(col: Column, ordered: list[str] = ORDERED_LABELS) -> Column:
    return lookup(col.cast("int"), dict(enumerate(ordered)), "Invalid severity rank")


def cumulative_targets(rank: Column, classes: int) -> Column:
    """ARRAY<INT> with one entry per threshold t: 1 when rank > t."""
    checked = F.when(
        (rank >= 0) & (rank < classes), rank
    ).otherwise(F.raise_error(F.lit("Rank outside the label range")).cast("int"))
    thresholds = F.array(*[F.lit(t) for t in range(classes - 1)])
    return F.transform(thresholds, lambda t: (checked > t).cast("int"))
