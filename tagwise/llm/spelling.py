"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words that differ by one replaced, inserted or deleted letter have letter counts of squared distance two or one. The
letters are dealt into four classes, of which an edit touches two at most, so near words agree in all counts of two
classes: a block is the words that do so, of one length and the next. Inside a block the squared distances are norms less
twice the Gram matrix, a NumPy product; pairs at most two apart are verified letter by letter. A pair that meets in
several blocks is kept in the first only.

A block of more than ``CELL`` words is cut into chunks by a hash, and each pair of chunks is a cell of its own, so no task
holds more than twice ``CELL`` of its words. Nothing is left out.

Null and empty texts have no words; a null ``doc_id`` writes nothing before the colon; repeated rows count as often as
they occur; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagwise.llm.common import broadcast_if_small, slices, stored

#: Fixed values of the contract.
SHORTEST, LEAST, FACTOR, EVERY = 7, 2, 10, 31
_RUN = re.compile(rf"[a-zÀ-ÿ]{{{SHORTEST},}}")  # shorter runs make no word, whether a letter goes or not
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z alone
#: Letters of about equal weight go to different classes.
_ORDER = "etaoinshrdlucmfpgwybvkxjqz"
CLASSES = 4
FAMILIES = list(combinations(range(CLASSES), 2))
CELL = 4096
#: Rows of one Gram matrix.
TILE = 512
#: Words that a task counts before it passes the counts on.
COUNTED = 300_000
#: Longer words are verified one pair at a time.
WIDE = 64

_COLUMN = np.full(256, -1)
_LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
_COLUMN[_LETTERS] = np.arange(len(_LETTERS))
_CLASS = np.array([_ORDER.index(chr(c)) % CLASSES if c < 128 else c % CLASSES for c in _LETTERS])
_NAMES = np.random.default_rng(13).integers(0, 1 << 63, len(_LETTERS), np.uint64) * np.uint64(2) + np.uint64(1)
#: The first family of two agreeing classes, by the set of agreeing classes as bits.
_FIRST = np.array(
    [next((f for f, (a, b) in enumerate(FAMILIES) if bits >> a & bits >> b & 1), -1) for bits in range(1 << CLASSES)]
)


def _runs(text: str) -> list[str]:
    return _RUN.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"))


def _kept(doc_id: int | None, text: str) -> Iterator[str]:
    """The text's words: its long runs, of which every 31st by checksum loses a letter."""
    before = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run in _runs(text):
        mark = zlib.crc32(run.encode(), before)
        if mark % EVERY == 0:
            at = mark % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        yield run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counts: Counter[str] = Counter()
    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            counts.update(_kept(doc_id, text or ""))
            if len(counts) > COUNTED:
                yield flushed()
                counts = Counter()
    if counts:
        yield flushed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words with at least two occurrences."""
    parts = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _letter_counts(words: list[bytes]) -> np.ndarray:
    """One row per word; all code points are below 256, so a byte is a letter."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = _COLUMN[np.frombuffer(b"".join(words), np.uint8)]
    at = np.repeat(np.arange(len(words)), lengths) * len(_LETTERS) + letters
    return np.bincount(at, minlength=len(words) * len(_LETTERS)).reshape(len(words), -1)


def _class_names(counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of the counts in each class."""
    weights = np.where(_CLASS[:, None] == np.arange(CLASSES), _NAMES[:, None], np.uint64(0))
    return counts.astype(np.uint64) @ weights


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word once per family of classes as one of its length, and once as one of the length before."""
    for batch in slices(batches, 4096):
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        if not words:
            continue
        names = _class_names(_letter_counts(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        for family, (a, b) in enumerate(FAMILIES):
            both = (names[:, a] * np.uint64(0x9E3779B97F4A7C15) ^ names[:, b]) + np.uint64(family)
            for base in (length, length - 1):
                block = (both * np.uint64(0xD6E8FEB86659FD93) ^ base.astype(np.uint64)).view(np.int64)
                columns = [pa.array(block), pa.array(np.full(len(words), family, np.int32)), pa.array(base.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(words, pa.binary()), batch.column("n")], ["block", "family", "base", "word", "n"]
                )


def _celled(rows: DataFrame, cell: int) -> DataFrame:
    """Rows with ``cell`` and ``side``: 0 and -1, or in crowded blocks one for each pair of chunks theirs is in.

    Of a pair of two chunks only rows of different sides are to be compared.
    """
    crowded = stored(
        rows.groupBy("block").agg(F.count("*").alias("rows")).where(F.col("rows") > cell)
        .select(F.col("block").alias("at"), F.ceil(F.col("rows") / cell).cast("long").alias("chunks"))
    )
    own = F.pmod(F.xxhash64("word"), F.col("chunks"))
    pair = lambda x: F.struct(
        (F.least(x, own) * F.col("chunks") + F.greatest(x, own)).alias("cell"),
        F.when(x == own, -1).otherwise((own > x).cast("int")).alias("side"),
    )
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), pair)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(-1).alias("side")))
    met = rows.join(broadcast_if_small(crowded), F.col("block") == F.col("at"), "left")
    return met.select(*rows.columns, F.inline(F.coalesce(cells, whole)))


def _tiles(group: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Pairs of row ranges that cover all pairs within each group; groups are consecutive."""
    ends = np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)]
    start = 0
    while start < len(group):
        nth = int(np.searchsorted(ends, start + TILE, "right"))
        stop = int(ends[nth - 1]) if nth and ends[nth - 1] > start else int(ends[nth])
        cuts = range(start, stop, TILE)  # one range, unless a single group is larger
        for i in cuts:
            for j in range(i, stop, TILE):
                yield slice(i, min(i + TILE, stop)), slice(j, min(j + TILE, stop))
        start = stop


def _one_edit(short: bytes, long: bytes) -> bool:
    """Whether one replaced letter, or one more in the longer, makes the difference."""
    at = next((k for k, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[at + (len(short) == len(long)) :] == long[at + 1 :]


def _verified(words: list[bytes], length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``_one_edit`` for many pairs, the shorter word first; equal words do not occur."""
    if not len(i):
        return np.empty(0, bool)
    if length[i].max(initial=0) >= WIDE:
        return np.fromiter((_one_edit(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
    padded = np.zeros((len(words), WIDE + 1), np.uint8)
    padded[np.arange(WIDE + 1) < np.minimum(length, WIDE + 1)[:, None]] = np.frombuffer(
        b"".join([w[: WIDE + 1] for w in words]), np.uint8
    )
    a, b = padded[i], padded[j]
    inside = np.arange(WIDE + 1) < length[i][:, None]
    differ = (a != b) & inside
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), length[i])
    behind = inside & (np.arange(WIDE + 1) >= at[:, None])
    shifted = np.zeros_like(b)
    shifted[:, :-1] = b[:, 1:]
    return np.where(length[i] == length[j], differ.sum(axis=1) == 1, ~((a != shifted) & behind).any(axis=1))


def near_pairs(
    words: list[bytes], group: np.ndarray, family: np.ndarray, base: np.ndarray, side: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, the shorter word first, that are one edit apart and belong to their group's family, lengths, sides."""
    counts = _letter_counts(words)
    length = counts.sum(axis=1)
    names = _class_names(counts)
    exact = np.float32 if length.max() < 2048 else np.float64  # norms below 2 ** 24 are whole in 32 bits
    vectors = np.ascontiguousarray(counts[:, counts.any(axis=0)], exact)
    norms = (vectors**2).sum(axis=1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for rows, columns in _tiles(group):
        near = norms[rows, None] + norms[None, columns] - 2 * (vectors[rows] @ vectors[columns].T) <= 2
        near &= group[rows, None] == group[None, columns]
        i, j = np.nonzero(near)
        i, j = i + rows.start, j + columns.start
        i, j = i[i < j], j[i < j]
        swap = length[i] > length[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        agree = ((names[i] == names[j]) << np.arange(CLASSES)).sum(axis=1)
        own = (_FIRST[agree] == family[i]) & (length[i] == base[i]) & (length[j] - length[i] <= 1)
        own &= (side[i] < 0) | (side[i] != side[j])
        found.append((i[own], j[own]))
    i, j = (np.concatenate(x) for x in zip(*found))
    same = _verified(words, length, i, j)
    return i[same], j[same]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each cell, from batches ordered by cell; a cell may lie in many batches."""
    keys = ("block", "cell", "family", "base")
    kept: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        at = np.stack([rows.column(c).to_numpy() for c in keys], axis=1)
        group = np.cumsum(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])
        words = rows.column("word").to_pylist()
        i, j = near_pairs(words, group, at[:, 2], at[:, 3], rows.column("side").to_numpy())
        text = [w.decode("latin-1") for w in words]
        n = rows.column("n").to_numpy()
        columns = [pa.array([text[k] for k in x.tolist()], pa.string()) for x in (i, j)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n[i]), pa.array(n[j])], ["a", "b", "n_a", "n_b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows = pa.Table.from_batches(kept)
        at = np.stack([rows.column(c).to_numpy() for c in keys[:2]], axis=1)
        last = int(np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])[-1])
        if last:
            yield pairs(rows.slice(0, last))
            kept = rows.slice(last).to_batches()
    if kept:
        yield pairs(pa.Table.from_batches(kept))


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """``a, b, n_a, n_b``: each pair of words one edit apart, once, for distinct ``word`` with ``n``."""
    blocked = words.select("word", "n").mapInArrow(_blocks, "block long, family int, base int, word binary, n long")
    met = _celled(blocked, cell).repartition("block", "cell").sortWithinPartitions("block", "cell", "family", "base")
    return met.mapInArrow(_pairs, "a string, b string, n_a long, n_b long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: forms are followed to the last, twice as far in each round.

    A form is at least ten times as frequent as its word, so that a chain of counts of 63 bits ends in five rounds.
    """
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = stored(now.join(ahead, now["root"] == ahead["at"], "left").drop("at"))
        now = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.where("further is not null").isEmpty():
            return now


def spelling_groups(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word."""
    words = stored(vocabulary(docs))
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
    )
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = (
        near_words(words, cell).select(F.inline(sides)).groupBy("word")
        .agg(F.count("*").alias("n_near"), best.alias("best"))
    )
    enough = -F.col("best.less") >= FACTOR * F.col("n")
    known = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
