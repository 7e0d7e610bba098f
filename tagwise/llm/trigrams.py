"""Boolean trigram queries that a text must satisfy before a regular expression can match it."""

from __future__ import annotations

import re
from collections.abc import Sequence

MAX_STRINGS = 64
MAX_CLASS = 8

#: One alternative: all of its trigrams. One literal run: any of its alternatives. A query: all of its runs.
Query = list[list[frozenset[str]]]


def _one_of(members: Sequence) -> set[str] | None:
    found: set[str] = set()
    for kind, value in members:
        if str(kind) == "LITERAL":
            found.add(chr(value))
        elif str(kind) == "RANGE" and value[1] - value[0] < MAX_CLASS:
            found.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return found if len(found) <= MAX_CLASS else None


def _strings(item: tuple) -> set[str] | None:
    """All strings that an item of a parsed expression can match, or None if they are too many to list."""
    kind, value = str(item[0]), item[1]
    if kind == "LITERAL":
        return {chr(value)}
    if kind == "IN":
        return _one_of(value)
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "BRANCH":
        each = [_sequence(x) for x in value[1]]
        return None if None in each else set().union(*each)
    if kind == "MAX_REPEAT" and value[1] <= 1:
        once = _sequence(value[2])
        return None if once is None else once | ({""} if value[0] == 0 else set())
    return None


def _sequence(items: Sequence) -> set[str] | None:
    found = {""}
    for item in items:
        nxt = _strings(item)
        if nxt is None or len(found) * len(nxt) > MAX_STRINGS:
            return None
        found = {a + b for a in found for b in nxt}
    return found


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def query_of(pattern: str) -> Query:
    """The lower-case trigrams that any match must contain; empty if none are mandatory and all texts must be scanned."""
    runs, now = [], {""}
    for item in [*re._parser.parse(pattern), ("END", None)]:
        nxt = _strings(item)
        if nxt is not None and len(now) * len(nxt) <= MAX_STRINGS:
            now = {a + b for a in now for b in nxt}
            continue
        runs.append(now)
        now = {""} if nxt is None else nxt
    query = []
    for run in runs:
        every = {trigrams(s.lower()) for s in run}
        if frozenset() not in every:
            query.append(sorted((a for a in every if not any(b < a for b in every)), key=sorted))
    return query
