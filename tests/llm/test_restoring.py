"""The noisy channel of the toxicity operator: what it learns from, and what its search may reach."""

import itertools
import math
import random
import re

from tagwise.llm import toxicity
from tagwise.llm.deobfuscate import CharModel, _decoded, _lattice, grams, restored
from tests.llm.frames import documents, labels


def test_the_character_model_counts_all_documents(spark):
    rows = [(1, "some clean words", "en", "a"), (3, "such words", "en", "a"), (9, "bad words", "en", "a")]
    rows += [(1000 + i, "unlabelled zyxwv", "en", "a") for i in range(7)]
    scorer = toxicity.fitted(documents(spark, rows, clashes=False), labels(spark), max_rows=2)
    assert scorer.read.model.counts["zyxw"] == 7 and scorer.read.model.counts["word"] == 3


WORDS = ["idiot", "stupid", "loser", "the", "thing", "worthless", "moron", "clown", "under", "weather", "ass", "too", "to"] * 5


def test_words_that_the_lattice_reaches():
    model = CharModel(grams(WORDS))
    for token, meant in (
        ("st**id", "stupid"), ("stuupid", "stupid"), ("iddiot", "idiot"), ("*diot", "idiot"), ("under*", "under"),
        ("w**thless", "worthless"), ("too", "too"), ("to***", "to"), ("thing###", "thing"), ("(*diot),", "idiot"),
        ("#lo*er", "loser"), ("455", "ass"), ("11", ""), ("2024", ""), ("***", ""), ("stuupidd", "stupid"), ("clo" + "*" * 400 + "wn", "clown"),
    ):
        assert next(iter(restored(token, model)), "") == meant, token
    assert restored("worthless***", model) == ["worthless"]


def test_the_search_is_exact():
    rng = random.Random(7)
    model = CharModel(grams(WORDS))
    for _ in range(60):
        token = "".join(rng.choice("*idotsup10$-m") for _ in range(rng.randrange(1, 6)))
        token = token.replace("**", "*", max(0, token.count("*") - 2))
        value, _ = _decoded(token, model)
        best = -math.inf
        for path in itertools.product(*_lattice(token)):
            text = "".join(out for out, _ in path)
            words = re.sub(" +", " ", text).strip()
            total = -sum(price for _, price in path)
            for word in words.split():
                padded = " " * 3 + word + " "
                total += sum(model.log(padded[i : i + 3], padded[i + 3]) for i in range(len(word) + 1))
            best = max(best, total)
        assert abs(value - best) < 1e-9, token


def test_tokens_without_hope_have_no_feature():
    rng = random.Random(2)
    model = CharModel(grams(WORDS))
    names = {n: i for i, n in enumerate(["idiot", "ass", "stup*", "loser", "worth*2", "moron"])}
    quick, plain = toxicity.Reader(model, names), toxicity.Reader(model, names)
    plain._hopeless = lambda token: False
    words = ["".join(rng.choice("idotasupe") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    words += [w + rng.choice(["", "s", "ss", "."]) for w in WORDS] + ["iidiot", "asss", "stupp", "worthh", "st", "stup"]
    assert any(map(quick._hopeless, words)) and not all(map(quick._hopeless, words))
    for word in words:
        assert quick._of_token(word, {}) == plain._of_token(word, {}), word
