"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tagwise.llm import collocations
from tagwise.llm.common import table
from tagwise.llm.queries import queries

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                f.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {}
    candidates = {key: a for key, a in f.items() if a >= 30 and len(key[1]) > 1}
    for (lang, words), a in candidates.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        longer = [
            b for (other, w), b in candidates.items()
            if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))
        ] if len(candidates) < 500 else longer_counts(candidates).get((lang, words), [])
        if not any(100 * b >= 80 * a for b in longer):
            score, _, left, right = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return [
        (lang, i, phrase.decode(), -a, left, right, n[lang], -score)
        for lang in sorted(found)
        for i, (score, a, phrase, left, right) in enumerate(sorted(found[lang])[:top], 1)
    ]


_LONGER = {}


def longer_counts(candidates):
    if id(candidates) not in _LONGER:
        inner = {}
        for (lang, w), b in candidates.items():
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    inner.setdefault((lang, w[i : i + size]), []).append(b)
        _LONGER[id(candidates)] = inner
    return _LONGER[id(candidates)]


def found(df):
    assert df.columns == NAMES
    return sorted(tuple(r) for r in df.collect())


def test_query_against_plain_counting(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("lang", "text").collect()]
    expected = plain(rows)
    assert len(expected) > 100 and max(len(r[2].split()) for r in expected) == 4
    assert found(queries()["op11_collocations"](spark, sf_dir)) == expected


@pytest.fixture(scope="module")
def odd():
    """Overlaps, ties, pieces, tabs, capitals, other blanks, null languages and texts, and repeated rows."""
    rng = random.Random(5)
    rows = [(None, None), ("en", None), ("en", ""), ("und", "A b " * 20), (None, "a B\t" * 20), ("en", "a a a a a a " * 30)]
    rows += [("en", "x\xa0y z\x0bq\x85r " * 40), ("de", "no words here .;!? " * 29), ("fr", "one,two " * 50)]
    for _ in range(400):
        words = rng.choices(["New York", "of the", "De La Cruz", "é", "Éa", "to", "b", "c"], k=rng.randrange(1, 30))
        rows.append((rng.choice(["en", "de", None]), rng.choice([" ", "  ", "\t"]).join(words) + rng.choice([".", "", "\n"])))
    return rows + rows[:100]


@pytest.mark.parametrize("block", [7, 1000, collocations.BLOCK])
def test_odd_texts_in_blocks_of_any_size(spark, odd, block):
    schema = "lang string, text string, phrase string, n int, block long"
    docs = spark.createDataFrame([(lang, text, "p", 1, 2) for lang, text in odd], schema).repartition(3)
    assert found(collocations.collocations(docs, block=block)) == sorted(plain(odd))


def test_shuffled_frequent_phrases_give_the_same(spark, odd, monkeypatch):
    monkeypatch.setattr(collocations, "SMALL", -1)
    docs = spark.createDataFrame(odd, "lang string, text string")
    assert found(collocations.collocations(docs, block=50)) == sorted(plain(odd))


def test_only_the_first_of_each_language(spark, odd):
    docs = spark.createDataFrame(odd, "lang string, text string")
    assert found(collocations.collocations(docs, top=3)) == sorted(plain(odd, top=3))


@pytest.mark.parametrize("rows", [[], [("en", None)], [("en", "rare words only")]])
def test_nothing_to_find(spark, rows):
    assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).isEmpty()


def test_hashes_that_clash_change_nothing(spark, odd):
    docs = spark.createDataFrame(odd, "lang string, text string")
    assert found(collocations.collocations(docs, block=200, bits=3)) == sorted(plain(odd))


def test_counts_that_are_passed_on_early_add_up(spark, odd, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 40)
    docs = spark.createDataFrame(odd, "lang string, text string")
    assert found(collocations.collocations(docs, block=50)) == sorted(plain(odd))


def test_packing():
    for numbers in ([], [0], [5, 0, 300], [1 << 40, 7], list(range(70_000))):
        assert collocations._of_planes(collocations._planes(np.array(numbers, np.int64))).tolist() == numbers
    for numbers in (np.empty(0, np.int32), np.array([-1, 5, 2**31 - 1])):
        assert collocations._unpacked(collocations._packed(numbers)).tolist() == numbers.tolist()
