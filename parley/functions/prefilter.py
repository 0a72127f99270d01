"""Cheap substring tests that a text must pass before a regular expression is tried on it."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that case-insensitive matching treats as s, i and k but lower() does not map there.
_FOLD_FROM, _FOLD_TO = "ſıİK", "siik"


def fold(text: Column) -> Column:
    """Text in the form that the substring tests expect."""
    return F.lower(F.translate(text, _FOLD_FROM, _FOLD_TO))


def _best(options: list[frozenset[str]]) -> frozenset[str] | None:
    """The option whose shortest word is longest; fewer words break ties."""
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _required(nodes) -> frozenset[str] | None:
    options: list[frozenset[str]] = []
    run = ""
    for op, arg in [*nodes, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        if run:
            options.append(frozenset([run]))
            run = ""
        inner = None
        if name == "SUBPATTERN":
            inner = _required(arg[3])
        elif name == "MAX_REPEAT" and arg[0] > 0:
            inner = _required(arg[2])
        elif name == "BRANCH":
            parts = [_required(branch) for branch in arg[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        if inner:
            options.append(inner)
    return _best(options)


@lru_cache(maxsize=None)
def required_words(pattern: str) -> tuple[str, ...]:
    """Lower-case words of which every match of the pattern contains at least one; empty if there are none."""
    words = _required(re._parser.parse(pattern))
    return tuple(sorted(words or ()))


def may_match(folded: Column, pattern: str) -> Column | None:
    """False only where the pattern cannot match; None when the pattern requires no word."""
    test = None
    for word in required_words(pattern):
        found = F.contains(folded, F.lit(word))
        test = found if test is None else test | found
    return test
