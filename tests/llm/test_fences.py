"""Fences of the quality rules follow the documents of their group."""

import pytest

from tagwise.llm import quality_rules
from tests.llm.frames import documents


def text(i, symbols, lines, repeats, length, n=40):
    """``n`` words of about one length; of the lines, words and characters some are repeats or symbols."""
    words = [f"{chr(97 + (i * 7 + k) % 26)}{k}" + "x" * (length - 2 - len(str(k))) for k in range(n + i % 5)]
    words += words[:8] * repeats
    return " ".join(words) + "#" * symbols + "".join(f"\nline {k} {i}" for k in range(10)) + f"\nline 0 {i}" * lines


def group(name, n, **scale):
    rows = []
    for i in range(n):
        few = i % 10 == 0  # most values are zero, a tenth is not
        of = {key: scale[key] * (1 + i % 3) if few else 0 for key in ("symbols", "lines", "repeats")}
        rows.append((text(i, **of, length=scale["length"] + i % 3), "en", name))
    return rows


@pytest.fixture(scope="module")
def fences(spark):
    plain = group("plain", 600, symbols=1, lines=1, repeats=0, length=6)
    plain += [(text(i, 0, 0, 1, 6, 90), "en", "plain") for i in range(60)]
    noisy = group("noisy", 600, symbols=9, lines=3, repeats=0, length=11)
    noisy += [(text(i, 0, 0, 1, 11), "en", "noisy") for i in range(60)]
    few = group("few", 20, symbols=40, lines=9, repeats=1, length=6)
    rows = [(k, *r) for k, r in enumerate([*plain, *noisy, *few])]
    docs = documents(spark, rows, clashes=False)
    rates = quality_rules.measured(docs)
    sketch = quality_rules.sketches(rates, ["lang", "source"])
    return docs, {r["source"]: r["f"] for r in quality_rules.fences(sketch, ["lang", "source"], "f").collect()}


def test_groups_have_fences_of_their_own_for_every_rate(fences):
    _, found = fences
    for rate in quality_rules.RATES:
        assert found["plain"][rate]["enough"] and found["noisy"][rate]["enough"], rate
        assert found["plain"][rate]["high"] < found["noisy"][rate]["high"], rate
    assert found["plain"]["word_length"]["low"] < found["noisy"]["word_length"]["low"]
    assert not any(found["few"][rate]["enough"] for rate in quality_rules.RATES)


def test_the_same_document_is_usual_in_one_source_and_not_in_the_other(spark, fences):
    docs, _ = fences
    odd = text(1, 9, 0, 0, 11)
    more = documents(spark, [(-1, odd, "en", "plain"), (-2, odd, "en", "noisy")], clashes=False)
    found = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs.unionByName(more)).collect()}
    assert (found[-1], found[-2]) == (False, True)
    assert sum(found.values()) > 0.9 * len(found)
