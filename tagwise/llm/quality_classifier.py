"""Quality classifier: a generalised additive model over surface features of whole texts.

Features are computed in Arrow batches beside the text; the model is fitted on the driver to the features of at most
``MAX_TRAINING_ROWS`` labelled documents, a bounded matrix, and scores all documents by table look-ups in one pass
without a shuffle.

Null text counts as empty, and an empty text has features of zero and gets a score like any other; repeated rows and ids
are scored each; without labels all scores are 0.5; an empty table gives an empty result. ``scored`` keeps all columns of
its input and adds the score under a name of the caller's choice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tagwise.llm import gam
from tagwise.llm.common import slices
from tagwise.llm.learning import free_name, held_out, training_sample

MAX_TRAINING_ROWS = 20_000
SEED = 6
THRESHOLD = 0.7

FEATURES = (
    "words", "word_length", "symbols", "capitals", "digits", "exclamations", "stops", "non_ascii", "bars",
    "distinct_words", "top_word", "echoes", "repeated_lines", "line_words", "short_lines", "longest_word", "colons",
)


def _members(characters: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(characters)] = 1
    return mask


_CLASSES = np.stack([
    _members(b"#*$%&|<>"),
    _members(bytes(range(65, 91))),
    _members(bytes(range(97, 123))),
    _members(b"0123456789"),
    _members(b"!?"),
    _members(b".,;"),
    _members(bytes(range(128, 256))),
    _members(b"|/\\_=+~^"),
    _members(b":@()[]{}\"'"),
])


def features(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    symbols, upper, lower, digits, calls, stops, beyond, bars, colons = _CLASSES @ counts
    solid = sum(map(len, words))
    often = Counter(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return [
        np.log2(n), solid / n, symbols / solid, upper / (upper + lower + 1), digits / solid, calls / n, stops / n,
        beyond / solid, bars / solid, len(often) / n, max(often.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), n / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), max(map(len, words)), colons / n,
    ]


def feature_matrix(texts: Iterable[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> gam.Model:
    """The model learnt from ``labels.quality`` outside the held-out fold."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = feature_matrix(_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.list_(pa.float64())), batch.column("label").cast(pa.float64())], ["x", "y"]
            )

    sample = training_sample(docs, labels, "quality", max_rows, SEED)
    rows = sample.mapInArrow(measure, "x array<double>, y double").toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy()
    order = np.lexsort((y, *x.T))  # the order of arrival must not show in the sums
    return gam.fit(x[order], y[order])


def scored(docs: DataFrame, model: gam.Model, name: str = "score") -> DataFrame:
    """``docs`` with the model's probability of good quality."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = model.score(feature_matrix(_texts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs.select("doc_id", "text"), fitted(docs, labels))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, as they are."""
    name = free_name(docs, "score")
    return scored(docs, fitted(docs, labels), name).where(F.col(name) >= THRESHOLD).drop(name)
