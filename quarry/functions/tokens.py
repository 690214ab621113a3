"""Texts read token by token: one pattern, a class for each token, and a fold over them. Every step is bound once."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is evaluated once however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def tokens(text: Column, pattern: str) -> Column:
    """All matches of a pattern in a text in lower case, in order; null reads as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def lookup(table: Mapping[str, object]) -> Column:
    """A literal map."""
    return F.create_map(*(F.lit(v) if not isinstance(v, (list, tuple)) else F.array(*(F.lit(i) for i in v)) for kv in table.items() for v in kv))


def fold(xs: Column, start: Column, fields: list[str], step: Callable[..., Mapping[str, Column]], share: Callable[[Column, Column], Column] | None = None) -> Column:
    """A struct of the given fields carried over an array; step(state, x) gives the fields that change.

    With share, step(state, x, shared) names as often as it likes what share(state, x) has worked out once.
    """
    whole = lambda state, new: F.struct(*(new.get(f, state[f]).alias(f) for f in fields))
    if share is None:
        return F.aggregate(xs, start, lambda state, x: whole(state, step(state, x)))
    return F.aggregate(xs, start, lambda state, x: bound(share(state, x), lambda y: whole(state, step(state, x, y))))
