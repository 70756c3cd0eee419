"""Rule sets: ordered (condition, message) pairs evaluated as one array column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Rule = tuple[Column, "str | Column"]


def _text(message: str | Column) -> Column:
    return F.lit(message) if isinstance(message, str) else message


def messages(rules: Sequence[Rule]) -> Column:
    """Messages of all rules whose condition is true, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, _text(text)) for cond, text in rules]))


def first_message(rules: Sequence[Rule]) -> Column:
    """Message of the first rule whose condition is true, else NULL."""
    return F.coalesce(*[F.when(cond, _text(text)) for cond, text in rules])


def missing(c: Column) -> Column:
    return c.isNull() | (c == "")
