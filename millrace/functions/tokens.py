"""Words, numbers and marks of normalised text as arrays, and what stands around one of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word with its hyphens, a number, a line end, or any other mark.
TOKEN = r"[a-z]+(?:-[a-z]+)*|\d+|\n|[^\sa-z\d]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once. Inside a lambda a Column stands for its expression, which is worked out again
    for every element and every time it is used; a lambda's own variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def among(token: Column, values: Iterable[str]) -> Column:
    """Whether a token is one of the values; false where there is none."""
    return F.coalesce(token.isin(*values), F.lit(False))


def begins(token: Column, stems: Iterable[str]) -> Column:
    out = F.lit(False)
    for stem in stems:
        out = out | F.coalesce(F.startswith(token, F.lit(stem)), F.lit(False))
    return out


def each(words: Column, found: Callable[[Column, Callable[[int], Column], Column], Column], where: Callable[[Column], Column] | None = None) -> Column:
    """found(token, token k places on, place) for every token, nulls left out. where says which tokens can have a value; what
    stands around the others is not looked at."""

    def value(t: Column, i: Column) -> Column:
        out = found(t, lambda k: F.get(words, i + k), i)
        return out if where is None else F.when(where(t), out)

    return F.array_compact(F.transform(words, value))


def is_number(t: Column) -> Column:
    """Whether a token begins with a digit; tokens are numbers as a whole then."""
    return (t >= "0") & (t < ":")


def ahead(words: Column, i: Column, n: int) -> Column:
    """The next n tokens."""
    return F.slice(words, i + 2, F.lit(n))


def holds_before(words: Column, i: Column, n: int, starts: Callable[[Column], Column], ends: Callable[[Column], Column]) -> Column:
    """Whether one of the n tokens before place i starts a context that no later one of them ends."""
    before = F.slice(words, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n)))
    return F.reduce(before, F.lit(False), lambda on, t: F.when(starts(t), F.lit(True)).when(ends(t), F.lit(False)).otherwise(on))


def follows(words: Column, i: Column, *lists: Iterable[str]) -> Column:
    """Whether the tokens after place i are one of the first list, one of the second, and so on."""
    out = F.lit(True)
    for k, values in enumerate(lists, 1):
        out = out & among(F.get(words, i + k), values)
    return out


def precedes(words: Column, i: Column, *lists: Iterable[str]) -> Column:
    """The same of the tokens before place i, the last list next to it."""
    out = F.lit(True)
    for k, values in enumerate(reversed(lists), 1):
        out = out & (i >= k) & among(F.get(words, F.greatest(i - k, F.lit(0))), values)
    return out
