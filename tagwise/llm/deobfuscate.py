"""Noisy-channel restoration of obfuscated words: a character language model decodes lattices of what may be meant.

A token that is not plain becomes a lattice: a look-alike stands for one of its letters, two and more of it for one or two
of them, a run of one letter for one or two of it, a separator for nothing or for a word's end, each asterisk for nothing
or any letter. The Viterbi path under an interpolated character model of order four, with a price on every deviation, is
the restored text. The search is exact: where marks make many states, a quick search's path gives a value that the best
path has at least, and only states that cannot reach it are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

ORDER = 4
#: States of the quick search that gives the lower bound.
BEAM = 8
#: Look-alikes and the letters that they stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "×": "x",
}
SEPARATORS = " .-_~'·​‌‍﻿"
ANY = "*#%"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Every other letter is one class to the character model, so its tables have at most 28 ** ORDER entries.
OTHER = "\x7f"
#: Log-prices: a look-alike, an any-letter mark, a dropped separator, a kept word end, a shortened run, an odd character,
#: a letter written twice that is meant once.
LEET_COST, ANY_COST, DROP_COST, END_COST, RUN_COST, ODD_COST, TWICE_COST = 1.0, 2.5, 0.3, 2.0, 0.3, 7.0, 2.5
#: What is not part of a word at its ends.
TRIM = ".,;:?!\"'()[]{}<>&%#*/\\=_-~`"
#: The same, but for marks that may stand for a letter.
OUTER = "".join(c for c in TRIM if c not in ANY)
#: Log-probability of a character of a token without letters that is meant as it stands.
LITERAL = math.log(1 / 64)
_NOT_ASCII = re.compile("[^\x00-\x7f]")
DOUBLE = re.compile(r"([^\W\d_])\1")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


def folded(word: str) -> str:
    """The word as the character model reads it."""
    return word if word.isascii() else _NOT_ASCII.sub(OTHER, word)


def grams(words: Iterable[str] | dict[str, int]) -> Counter:
    """Counts of all character n-grams up to ``ORDER`` of words between word ends; words may come with their counts."""
    found: Counter = Counter()
    for word, n in words.items() if isinstance(words, dict) else Counter(words).items():
        padded = " " * (ORDER - 1) + folded(word) + " "
        for end in range(ORDER, len(padded) + 1):
            for start in range(end - ORDER, end):
                found[padded[start:end]] += n
    return found


class CharModel:
    """Interpolated log-probabilities of a character after its context."""

    def __init__(self, counts: dict[str, int], strength: float = 3.0) -> None:
        self.counts, self.strength = counts, strength
        self.totals: Counter = Counter()
        for gram, n in counts.items():
            self.totals[gram[:-1]] += n
        self.known: dict[str, float] = {}

    def _share(self, gram: str) -> float:
        lower = self._share(gram[1:]) if len(gram) > 1 else 1 / 64
        return (self.counts.get(gram, 0) + self.strength * lower) / (self.totals.get(gram[:-1], 0) + self.strength)

    def log(self, context: str, char: str) -> float:
        gram = context[1 - ORDER :] + char
        if (value := self.known.get(gram)) is None:
            value = self.known[gram] = math.log(self._share(gram))
        return value


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each step the strings that it may stand for, with their prices."""
    steps, i = [], 0
    while i < len(token):
        c, j = token[i], i + 1
        while j < len(token) and token[j] == c:
            j += 1
        run, i = j - i, j
        if c.isalpha():
            steps.append([(c * min(run, 2), 0.0), *([(c, TWICE_COST if run == 2 else RUN_COST)] if run > 1 else [])])
        elif c in LEET:
            once = [(x, LEET_COST + RUN_COST * (run > 1)) for x in LEET[c]]
            twice = [(x + y, LEET_COST + RUN_COST * (run > 2)) for x in LEET[c] for y in LEET[c]]
            steps.append(sorted(once + twice * (run > 1), key=lambda x: x[1]))
        elif c in SEPARATORS:
            steps.append([("", DROP_COST), (" ", END_COST)])
        elif c in ANY:
            steps += [[("", DROP_COST), *((x, ANY_COST) for x in LETTERS)]] * run
        else:
            steps.append([(" ", ODD_COST)])
    return steps


def _search(steps: list, model: CharModel, beam: int = 0, least: float = -math.inf) -> tuple[float, tuple]:
    """Value and path of the best way through the steps, among ``beam`` states if given and those that reach ``least``."""
    rest = [0.0]
    for options in reversed(steps):
        rest.append(rest[-1] - min(price for _, price in options))
    start, log = " " * (ORDER - 1), model.log
    now: dict[str, tuple[float, tuple]] = {start: (0.0, ())}
    for options, after in zip(steps, reversed(rest[:-1])):
        floor = least - after - 1e-9  # no path gains more than the least prices of what follows
        reached: dict[str, tuple[float, tuple]] = {}
        for context, (value, path) in now.items():
            for out, price in options:
                state, total = context, value - price
                if total < floor:
                    break  # the options come by price
                for char in out:
                    if char > "z":
                        char = OTHER
                    elif char == " " and state[-1] == " ":
                        continue
                    total += log(state, char)
                    state = start if char == " " else state[1:] + char
                if total >= floor and (state not in reached or total > reached[state][0]):
                    reached[state] = total, (path, out)
        now = dict(sorted(reached.items(), key=lambda x: -x[1][0])[:beam]) if beam else reached
    return max(now.values(), key=lambda x: x[0])


def _decoded(token: str, model: CharModel) -> tuple[float, list[str]]:
    steps, least = [*_lattice(token), [(" ", 0.0)]], -math.inf
    if any(map(token.count, ANY)):
        plain = [options if len(options) <= len(LETTERS) else options[:1] for options in steps]
        least = _search(plain, model)[0]  # no mark means a letter
        if any(map(token.strip(ANY + OUTER).count, ANY)):
            least = max(least, _search(steps, model, BEAM)[0])
    (value, path), parts = _search(steps, model, least=least), []
    while path:
        path, out = path
        parts.append(out)
    return value, "".join(reversed(parts)).split()


def decode(token: str, model: CharModel) -> list[str]:
    """The words of the cheapest path."""
    return _decoded(token, model)[1]


def _shortened(word: str, model: CharModel) -> list[str]:
    """What ``decode`` finds for letters of which some come twice; if only two do, by comparing the two readings."""
    at = DOUBLE.search(word).start()
    if DOUBLE.search(word, at + 1):
        return decode(word, model)

    def value(reading: str) -> float:  # of what differs
        padded = " " * (ORDER - 1) + folded(reading) + " "
        return sum(model.log(padded[i : i + ORDER - 1], padded[i + ORDER - 1]) for i in range(at, len(reading) + 1))

    once = word[:at] + word[at + 1 :]
    return [once] if value(once) - TWICE_COST > value(word) else [word]


def restored(token: str, model: CharModel) -> list[str]:
    """The words that a lower-case token holds: what its lattice decodes to and, if it is of letters, the token itself."""
    word = token.strip(TRIM)
    if not word:
        return []  # marks alone: to drop them is always the cheapest
    outer = token.strip(OUTER)
    if word.isalpha():
        found = [word]
        if outer[0] in ANY or outer[-1] in ANY:
            found = decode(outer, model)
        elif DOUBLE.search(word):
            found = _shortened(word, model)
        return found if word in found or _THRICE.search(word) else [*found, word]
    if outer[0] in ANY or outer[-1] in ANY:
        word = outer
    value, found = _decoded(word, model)
    if not any(map(str.isalpha, word)):
        return found if value > LITERAL * len(word) else []  # else it is more likely what it looks like, a number
    marked = token.strip(".,;:?\"'()[]{}")  # a look-alike at an end, as in $ and !
    if marked != word and (marked[0] in LEET or marked[-1] in LEET):
        found = [*found, *decode(marked, model)]
    return found


def spaced_runs(text: str) -> list[str]:
    """Runs of three and more single characters with blanks between them."""
    return _SPACED.findall(text)
