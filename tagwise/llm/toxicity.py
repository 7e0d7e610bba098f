"""Toxicity: words are restored from their obfuscated forms, then scored by a logistic model over a learnt word list.

One pass over all documents counts their words, and the distinct ones give the character model of the noisy channel. Two
passes over a bounded sample of labelled documents learn the words and stems that mark toxic documents, and their weights;
counts are summed by Spark, and what reaches the driver is bounded by the sample and the model's 28 letters. One pass
without a shuffle then scores every document: a worker restores each distinct token once, and keeps what it found in a
bounded table from task to task.

Null text counts as empty; an empty text gets the intercept's score; repeated rows are scored each; without labels all
scores are 0.5; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagwise.llm.common import slices, stored
from tagwise.llm.deobfuscate import DOUBLE, CharModel, decode, grams, restored, spaced_runs
from tagwise.llm.learning import held_out, training_sample

MAX_TRAINING_ROWS = 20_000
SEED = 8
THRESHOLD = 0.3
STEMS = (4, 5, 7)
#: How many distinct words of a stem make a feature of their own.
SEVERAL = (2, 3)
MIN_DOCS = 5
MAX_FEATURES = 400
#: Tokens that a worker keeps the features of, and the longest that it does.
KEPT, LONGEST = 1 << 19, 64
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 1 << 18
#: What this process's readers have restored, by the reader's name.
_LIVE: dict[str, dict[str, tuple[str, ...]]] = {}


def tokens_of(text: str) -> set[str]:
    return set(text.lower().split())


def _forms(words: list[str]) -> set[str]:
    """Words and, marked by an asterisk, the stems of longer ones. Letters only, so marks cannot be mistaken."""
    return {*words, *(w[:n] + "*" for w in words for n in STEMS if len(w) > n)}


def _levels(form: str, n: int) -> list[str]:
    """The features that ``n`` distinct words of a form make: the form, and for stems that there are several."""
    return [form, *(f"{form}{k}" for k in SEVERAL if n >= k)] if form[-1] == "*" else [form]


class Reader:
    """Features of texts, of which only those in ``names`` count if it is given."""

    def __init__(self, model: CharModel, names: dict[str, int] | None = None) -> None:
        self.model, self.names = model, names
        self.name = uuid.uuid4().hex
        self.forms = None if names is None else {n.rstrip("0123456789") if "*" in n else n for n in names}
        self.starts = None if names is None else [(n, {f[:n] for f in self.forms if f[n:] == "*"}) for n in STEMS]

    @property
    def seen(self) -> dict[str, tuple[str, ...]]:
        if self.name not in _LIVE:
            _LIVE.clear()  # an earlier reader is not needed any more
        return _LIVE.setdefault(self.name, {})

    def _forms(self, words: list[str]) -> tuple[str, ...]:
        forms = _forms(words)
        return tuple(forms if self.forms is None else forms & self.forms)

    def _hopeless(self, token: str) -> bool:
        """Whether a token of letters has no feature in either of its readings, which is soon told."""
        if self.forms is None or not token.isalpha():
            return False
        readings = [token]
        if double := DOUBLE.search(token):
            readings.append(token[: double.start()] + token[double.start() + 1 :])
            if DOUBLE.search(token, double.start() + 1):
                return False
        return not any(w in self.forms or any(w[:n] in starts for n, starts in self.starts) for w in readings)

    def _of_token(self, token: str, seen: dict) -> tuple[str, ...]:
        found = () if self._hopeless(token.rstrip(".,;:")) else self._forms(restored(token, self.model))
        if len(seen) >= KEPT:
            seen.clear()
        if len(token) <= LONGEST:
            seen[token] = found
        return found

    def __call__(self, text: str) -> set:
        text, seen, counts = text.lower(), self.seen, Counter()
        tokens = text.split()
        for token in set(tokens):
            got = seen.get(token)
            if got is None:
                got = self._of_token(token, seen)
            if got:
                counts.update(got)
        if sum(map((1).__eq__, map(len, tokens))) > 2:
            for run in spaced_runs(" ".join(tokens)):
                counts.update(self._forms(decode(run, self.model)))
        found = {x for form, n in counts.items() for x in _levels(form, n)}
        return found if self.names is None else {self.names[x] for x in found if x in self.names}


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _char_model(docs: DataFrame) -> CharModel:
    """The character model of all rows; each distinct word of a text counts once."""

    def rows(counts: Counter, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], [name, "n"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches):
            for text in _texts(batch):
                found.update(w for w in {x.strip(".,;:!?") for x in tokens_of(text)} if w.isalpha())
            if len(found) >= COUNTED:
                yield rows(found, "word")
                found = Counter()
        yield rows(found, "word")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            found.update(grams(dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))))
        yield rows(found, "gram")

    distinct = docs.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = distinct.mapInArrow(parts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return CharModel(dict(sorted(zip(counts.column("gram").to_pylist(), counts.column("n").to_pylist()))))


def _names(sample: DataFrame, model: CharModel, positive: int, negative: int) -> dict[str, int]:
    """The features with the strongest evidence for the label, numbered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model)
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(_texts(batch), batch.column("label").to_pylist()):
                found[label == 1].update(read(text))
            names = list(found[0].keys() | found[1].keys())
            each = [pa.array([c[x] for x in names], pa.int64()) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *each], ["name", "clean", "toxic"])

    sums = sample.mapInArrow(count, "name string, clean long, toxic long").groupBy("name")
    counts = sums.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (positive + 1)) - F.log((F.col("clean") + 0.5) / (negative + 1))
    best = (
        counts.where(f"toxic >= {MIN_DOCS}").withColumn("odds", odds).where("odds > 1.5")
        .orderBy(F.desc(F.col("odds") * F.col("toxic")), "name").limit(MAX_FEATURES)
    )
    return {row["name"]: i for i, row in enumerate(best.select("name").collect())}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.2) -> tuple[float, np.ndarray]:
    """Intercept and weights, by Newton steps.

    The intercept stays at the label's share: learnt freely it would sink until only several marked words together could
    tell, as toxic documents rarely have just one.
    """
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    loss = lambda w: np.logaddexp(0, (1 - 2 * y) * (start + x @ w)).sum() + ridge / 2 * w @ w
    beta, now = np.zeros(x.shape[1]), np.inf
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(start + x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (p - y) + ridge * beta)
        while (then := loss(beta - step)) > now and np.abs(step).max() > 1e-6:
            step /= 2
        beta -= step
        if now - then < 1e-6 * len(y):
            break
        now = then
    return start, beta


class Scorer:
    def __init__(self, model: CharModel, names: dict[str, int], intercept: float, weights: np.ndarray) -> None:
        self.read, self.intercept, self.weights = Reader(model, names), intercept, weights

    def __call__(self, text: str) -> float:
        total = self.intercept + self.weights[sorted(self.read(text))].sum()
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Scorer:
    """The scorer learnt from ``labels.toxic`` outside the held-out fold; copies of a text count once."""
    sample = stored(training_sample(docs, labels, "toxic", max_rows, SEED).groupBy("text").agg(F.max("label").alias("label")))
    sizes = {row["label"]: row["n"] for row in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    model = _char_model(docs)
    if not (sizes.get(0) and sizes.get(1)):
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Scorer(model, {}, float(np.log(share / (1 - share))), np.zeros(0))
    names = _names(sample, model, sizes[1], sizes[0])

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model, names)
        for batch in batches:
            found = [sorted(read(t)) for t in _texts(batch)]
            columns = [pa.array(found, pa.list_(pa.int32())), batch.column("label").cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["on", "label"])

    rows = sample.mapInArrow(present, "on array<int>, label int").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["on"], r["label"]))
    x = np.zeros((len(rows), len(names)))
    for i, row in enumerate(rows):
        x[i, row["on"]] = 1
    return Scorer(model, names, *_logistic(x, np.array([r["label"] for r in rows])))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scorer = fitted(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scorer(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    schema = docs.select("doc_id", F.lit(0.0).alias("score")).schema
    rows = docs.select("doc_id", "text").mapInArrow(score, schema)
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
