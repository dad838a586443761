"""Small helpers for Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's strip() takes for white space.
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"


def text_of(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(x: Column | str) -> Column:
    """Without white space of any kind at either end. A run of it is tried once, from its first character, so the time is in proportion to the text."""
    return F.regexp_replace(text_of(x), rf"^{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


#: Characters that fold to something else than they lower to, and what to: by the rule of full case folding, character by character.
_FOLDS = {c: c.casefold() for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if c.casefold() != c.lower()} | {"Σ": "σ", "İ": "İ".casefold()}


def folded(x: Column | str) -> Column:
    """Full case folding (ß to ss, every sigma to σ, dotted I to i with a dot): texts that differ by case only become equal. ASCII texts
    are lowered."""
    text = text_of(x)
    one = {c: f for c, f in _FOLDS.items() if len(f) == 1}
    longer = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(_FOLDS[c])), (c for c in _FOLDS if c not in one), text)
    return F.when(F.octet_length(text) > F.length(text), F.lower(F.translate(longer, "".join(one), "".join(one.values())))).otherwise(F.lower(text))


def collapsed(x: Column | str) -> Column:
    """Words with one space between."""
    return stripped(F.regexp_replace(text_of(x), rf"{SPACE}++", " "))


def lines_of(x: Column | str) -> Column:
    """Lines, at any line end; a line end at the end of the text opens none. An empty text has no lines."""

    def whole(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return let(F.split(text_of(x), r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]", -1), whole)


def any_in(hay: Column, needles: Column) -> Column:
    return F.exists(needles, lambda t: F.contains(hay, t))


def count_in(hay: Column, needles: Column) -> Column:
    """How many of the needles occur in hay."""
    return F.size(F.filter(needles, lambda t: F.contains(hay, t)))


def words_in(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def ordered_distinct(pairs: Column, key: str, fold: Callable[[Column], Column]) -> Column:
    """For each distinct `key` of an array of structs, in order of first occurrence, fold of its structs."""
    return let(pairs, lambda a: F.transform(F.array_distinct(F.transform(a, lambda x: x[key])), lambda k: fold(F.filter(a, lambda x: x[key] == k))))


def mapped(x: Column, values: dict, default=None) -> Column:
    pairs = F.create_map(*(F.lit(v) for kv in values.items() for v in kv))
    found = F.try_element_at(pairs, x)
    return found if default is None else F.coalesce(found, F.lit(default))
