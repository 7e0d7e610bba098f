"""How texts are cut into runs and how runs of any length are worked off together."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tagwise.llm import sentencepiece_bpe, vocabularies
from tests.llm.frames import prose

ODD = [
    "", " ", "   ", "a", "x   ", "  two  spaces \n\n tabs\t x ", "日本語 ß 😀 €", "▁lit▁ x\x00▁", "\x00\x00", "\ud800 x\udfff",
    "²³ 12ab", "it's _a_b 1a a1", "　x y", "ab" * 200, "😀" * 60, "." * 60,
]


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_bpe.Pieces(vocabularies.PIECES, dropout=0.2)


@pytest.mark.parametrize("texts", [[], [""], ["", "", "x"], ODD, ODD[::-1] * 3, [prose(1, 300), "", prose(2, 300)]])
def test_texts_are_cut_where_the_pattern_cuts(codec, texts):
    runs, which, sizes = codec._cut(texts)
    expected = [codec.runs.findall(" " + text) if text else [] for text in texts]
    assert [runs[k] for k in which] == [run for line in expected for run in line]
    assert sizes.tolist() == list(map(len, expected)) and len(set(runs)) == len(runs)


def test_texts_are_encoded_together_as_one_by_one(codec):
    texts = [*ODD[:9], *ODD[10:], prose(3, 300), "theinors" * 6 + " x", *ODD[:9], prose(3, 300)]
    found = codec.encode_all(texts, [sentencepiece_bpe.key_of(i) for i in range(len(texts))])
    other = sentencepiece_bpe.Pieces(vocabularies.PIECES, dropout=0.2)
    assert [np.frombuffer(x, np.int32).tolist() for x in found] == [other.encode(t, i) for i, t in enumerate(texts)]
    assert [codec.decode(np.frombuffer(x, np.int32).tolist()) for x in found] == texts
    assert codec.encode_all([], []) == []


@pytest.mark.parametrize("cells", [1, 700, 1 << 16])
def test_runs_of_many_lengths_share_their_steps(codec, monkeypatch, cells):
    monkeypatch.setattr(sentencepiece_bpe, "CELLS", cells, raising=False)
    rng = random.Random(7)
    runs = ["".join(rng.choice(" theinorsdaé日😀") for _ in range(rng.randrange(1, 49))) for _ in range(300)]
    skips = [rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) for _ in runs]
    calls, looked_up = [], codec._looked_up
    monkeypatch.setattr(codec, "_looked_up", lambda *pairs: calls.append(1) or looked_up(*pairs))
    for run, bits, found, looked in zip(runs, skips, *codec._work_off(runs, np.array(skips, np.uint64))):
        alone = codec._alone(run, lambda k: k < 64 and bool(bits >> k & 1))  # noqa: B023
        assert (found, looked) == alone, run
    most = max(codec._alone(run, lambda k: k < 64 and bool(bits >> k & 1))[1] for run, bits in zip(runs, skips))  # noqa: B023
    assert cells < 1 << 16 or len(calls) <= 1 + most
