"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tagwise.llm import spelling
from tagwise.llm.common import table
from tagwise.llm.queries import queries


def plain_words(rows):
    """The contract's words, one run at a time."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_near(counts):
    """Words that share what is left after deleting one letter, verified."""
    found = {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            if (x := w[:i] + w[i + 1 :]) in counts:
                found[w].add(x)
                found[x].add(w)
    holes = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    for words in holes.values():
        for w in words:
            found[w].update(x for x in words if x != w)
    return found


def plain(rows):
    counts = plain_words(rows)
    near, form = plain_near(counts), {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(
        (w, form[w] or "", root(w), n, len(near[w]), counts[form[w]] if form[w] else -1) for w, n in counts.items()
    )


def found(df):
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(
        (r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"])
        for r in df.select(names).collect()
    )


def test_query_against_all_pairs(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    expected = plain(docs)
    assert len(expected) > 1000 and sum(bool(r[1]) for r in expected) > 100
    assert found(queries()["op13_spelling_variants"](spark, sf_dir)) == expected


@pytest.fixture(scope="module")
def variants():
    """Chains of forms, accents, capitals, anagrams, ties and very long words."""
    rng = random.Random(3)
    texts = [None, "", " ", "short a-b", "x" * 9000 + " " + "x" * 9000, "x" * 8999 + "y " + "x" * 8999 + "y " + "x" * 8998]
    base = ["".join(rng.choices("abcdeé", k=rng.randrange(7, 11))) for _ in range(60)]
    for w in base:
        texts.append(" ".join([w] * rng.choice((1, 2, 30, 400))))
        for _ in range(12):
            i, c = rng.randrange(len(w)), rng.choice("abcdeéÉ")
            v = rng.choice((w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + w[i:][::-1]))
            texts.append(" ".join([v.upper() if "é" not in v else v] * rng.choice((1, 2, 3, 25))))
    rows = [(None if i % 97 == 5 else i // 2, t) for i, t in enumerate(texts)]
    return rows + rows[:40]


@pytest.mark.parametrize("cell", [4, spelling.CELL])
def test_odd_words_and_crowded_blocks(spark, variants, cell):
    docs = spark.createDataFrame([(i, t, "w", 7) for i, t in variants], "doc_id long, text string, word string, n int")
    assert found(spelling.spelling_groups(docs.repartition(3), cell)) == plain(variants)


def test_chain_of_forms_and_ties(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "zbcdefg": 20, "qqqqqqq": 2}
    expected = {"abcdefg": "abcdefgh", "abcdefgh": "abcdefghi", "abcdefghi": "abcdefghij", "zbcdefg": None}
    counted = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {frozenset((r["a"], r["b"])) for r in spelling.near_words(counted).collect()}
    assert pairs == {frozenset(p) for p in [("abcdefg", "abcdefgh"), ("abcdefg", "zbcdefg"), ("abcdefgh", "abcdefghi"), ("abcdefghi", "abcdefghij")]}
    forms = spark.createDataFrame([(w, f) for w, f in expected.items() if f], "word string, form string")
    assert {tuple(r) for r in spelling._roots(forms).collect()} == {(w, "abcdefghij") for w, f in expected.items() if f}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(docs).isEmpty()


def test_verification_is_one_edit():
    rng = random.Random(1)
    words = list({"".join(rng.choices("ab", k=rng.randrange(7, 10))) for _ in range(400)})
    length = np.array([len(w) for w in words])
    i, j = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words)), indexing="ij"))
    keep = (i != j) & ((length[j] - length[i] == 1) | (length[i] == length[j]))
    i, j = i[keep], j[keep]
    near = plain_near(dict.fromkeys(words, 2))
    expected = [words[b] in near[words[a]] for a, b in zip(i, j)]
    raw = [w.encode() for w in words]
    assert spelling._verified(raw, length, i, j).tolist() == expected
    assert [spelling._one_edit(raw[a], raw[b]) for a, b in zip(i, j)] == expected
