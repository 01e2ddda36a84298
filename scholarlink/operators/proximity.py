"""Whose an address is by what stands before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.names import let, name_tokens, same_person

WINDOW = 160
#: Fixed value: what counts as a name of a person, several capitalised words.
PERSON = r"\b[A-Z][a-z]+(?:[ \-][A-Z]\.?[a-z]*)+\b"


def parts_around(text: Column, needle: Column) -> Column:
    """The parts of text that the places of needle, in any case, divide it into."""
    return F.split(text, F.concat(F.lit(r"(?i)\Q"), needle, F.lit(r"\E")), -1)


def windows_before(text: Column, needle: Column, width: int = WINDOW) -> Column:
    """The up to `width` characters before each place of needle in text, in any case."""
    cut = parts_around(text, needle)
    return F.transform(F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))), lambda part: F.right(part, F.lit(width)))


def after_last(text: Column, needle: Column) -> Column:
    """What follows the last place of needle (lower case) in text, in any case; null where it isn't there."""
    back = F.instr(F.reverse(F.lower(text)), F.reverse(needle))
    return F.when(back > 0, F.right(text, back - 1))


def follows_name(windows: Column, names: Column) -> Column:
    """Whether one of the names (array) stands in a window before an address (array), without an @ or another person's name after it.

    What stands between is read from the address backwards to the name; every name of a person found there has to be one of the names.
    """
    keys = F.concat(F.transform(F.filter(names, lambda n: F.length(n) >= 3), F.lower), F.filter(name_tokens(names), lambda t: F.length(t) >= 4))
    ours = lambda found: F.exists(names, lambda n: same_person(found, n))
    clear = lambda between: ~between.contains("@") & F.forall(F.regexp_extract_all(between, F.lit(PERSON), F.lit(0)), ours)
    follows = lambda window: F.exists(F.transform(keys, lambda k: after_last(window, k)), lambda between: F.coalesce(clear(between), F.lit(False)))
    return F.coalesce(let(windows, lambda found: F.exists(found, follows)), F.lit(False))


def attributed_by_proximity(text: Column, email: Column, names: Column) -> Column:
    """Whether a place of the address in text follows one of the names (array) within 160 characters, without an @ or another person's name between."""
    return follows_name(windows_before(text, email), names)
