"""Near duplicates by SimHash, found with a Gray-order hierarchical index over the fingerprints.

Fingerprints are reduced to distinct ones first, so copies cost nothing further. Their 64 bits are cut into
``distance + 2`` blocks; two fingerprints within the distance agree on at least two whole blocks. The upper nodes of the
index are these masked patterns of two blocks: each pattern's members meet in one place after one exchange. There they
are sorted by Gray rank, so that neighbours share many bits, and every ``FAN`` neighbours make a node that keeps the
bits its members share. Pairs of nodes are compared from the top down; a pair whose differences in shared bits exceed the
distance is pruned with all that lies below, and so is a pair whose members are in one component already. What leaves a
pattern is a star per component, never its pairs.

A pattern with more than ``CELL`` members, as a cloud of near copies makes, is cut into chunks by a hash, and each pair of
chunks is a cell of its own, so no task holds more than twice ``CELL`` members of it.

Null text counts as empty; texts without words have fingerprint zero and link like any other. Rows with equal ids stay
separate rows. Null ids take part, but never name a component unless nothing else is in it. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tagwise.llm.common import slices, stored
from tagwise.llm.components import components
from tagwise.llm.learning import free_name

SHINGLE = 4
SEED = 42
DISTANCE = 4
CELL = 4096
FAN = 16
#: Shingles or pairs of codes that are looked at in one step.
STEP = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's lower-cased word shingles; 0 if it has no words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), STEP):
        part = zip(first[at : at + STEP], last[at : at + STEP])
        hashes = np.array([digest(joined[i:j], SEED) for i, j in part], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(last)).tobytes())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema
    return docs.select("doc_id", "text").mapInArrow(_signatures, schema)


def masks(distance: int) -> list[int]:
    """The bit masks of all pairs of blocks, as signed longs."""
    blocks = distance + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    both = [a | b for a, b in combinations(block, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def _gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class _Forest:
    """Components of numbered items; the root of each is its least item."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]


class _Level:
    """Nodes over consecutive items: the bits that all items share, the first item and the one after the last."""

    def __init__(self, ones: np.ndarray, any_: np.ndarray, cell: np.ndarray, start: np.ndarray) -> None:
        self.ones, self.any, self.cell, self.start = ones, any_, cell, start
        self.shared = ~(ones ^ any_)

    def above(self) -> "_Level":
        """Every ``FAN`` nodes of a cell make one node."""
        new_cell = np.r_[True, self.cell[1:] != self.cell[:-1]]
        begin = np.flatnonzero(new_cell)
        nth = np.arange(len(self.cell)) - np.repeat(begin, np.diff(np.r_[begin, len(self.cell)]))
        start = np.flatnonzero(nth % FAN == 0)
        return _Level(
            np.bitwise_and.reduceat(self.ones, start), np.bitwise_or.reduceat(self.any, start), self.cell[start], start
        )


def linked(codes: np.ndarray, cells: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (item, root) of the items whose codes link within their cell; items come ordered by cell and Gray rank."""
    forest = _Forest(len(codes))
    levels = [_Level(codes, codes, cells, np.arange(len(codes) + 1))]
    while len(levels[-1].cell) > len(np.unique(levels[-1].cell)):
        levels.append(levels[-1].above())

    def children(level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = levels[level].start
        return starts[node], np.r_[starts, len(levels[level - 1].cell)][node + 1]

    def one_component(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of nodes whose items are all in one component already."""
        least, most = forest.root, forest.root
        for k in range(1, level + 1):
            starts = levels[k].start
            least, most = np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
        return (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])

    def search(level: int, a: np.ndarray, b: np.ndarray) -> None:
        here = levels[level]
        step = STEP if level == 0 else STEP // FAN**2
        for at in range(0, len(a), step):
            x, y = a[at : at + step], b[at : at + step]
            fixed = here.shared[x] & here.shared[y]
            near = np.bitwise_count((here.ones[x] ^ here.ones[y]) & fixed) <= distance
            x, y = x[near], y[near]
            if level == 0:
                forest.link(x, y)
                continue
            todo = ~one_component(level, x, y)
            x, y = x[todo], y[todo]
            (x0, x1), (y0, y1) = children(level, x), children(level, y)
            wide, n = y1 - y0, (x1 - x0) * (y1 - y0)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            lower_x = np.repeat(x0, n) + nth // np.repeat(wide, n)
            lower_y = np.repeat(y0, n) + nth % np.repeat(wide, n)
            real = lower_x < lower_y + (level > 1)
            search(level - 1, lower_x[real], lower_y[real])

    top = np.arange(len(levels[-1].cell))
    search(len(levels) - 1, top, top)
    items = np.flatnonzero(forest.root != np.arange(len(codes)))
    return items, forest.root[items]


def _stars(distance: int):
    """Edges of each cell, from batches ordered by cell; a cell may lie in many batches."""

    def edges(codes: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((_gray_rank(codes), cells))
        codes, cells = codes[order], cells[order]
        item, root = linked(codes, cells, distance)
        x, y = codes[item].view(np.int64), codes[root].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_codes, kept_keys = np.empty(0, np.uint64), np.empty((0, 2), np.int64)
        for batch in batches:
            codes = np.r_[kept_codes, batch.column("fp").to_numpy().view(np.uint64)]
            keys = np.r_[kept_keys, np.stack([batch.column(c).to_numpy() for c in ("pattern", "cell")], axis=1)]
            if not len(codes):
                continue
            change = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
            last = int(np.flatnonzero(change)[-1])
            if last:
                yield edges(codes[:last], np.cumsum(change)[:last])
            kept_codes, kept_keys = codes[last:], keys[last:]
        if len(kept_codes):
            yield edges(kept_codes, np.zeros(len(kept_codes), np.int64))

    return run


def _with_cells(members: DataFrame, cell: int) -> DataFrame:
    """Members of patterns that others share, once; of crowded patterns once for each pair of chunks theirs is in."""
    shared = (
        members.groupBy("pattern").agg(F.count("*").alias("n")).where("n > 1")
        .select("pattern", F.ceil(F.col("n") / cell).cast("long").alias("chunks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    pair = lambda x: F.least(x, own) * F.col("chunks") + F.greatest(x, own)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), pair)
    return members.join(shared, "pattern").select("pattern", "fp", F.explode(cells).alias("cell"))


def links(codes: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Edges ``a > b`` between the distinct fingerprints ``fp``, enough to connect all that link directly."""
    # a masked pattern is named by a hash; should two share a name, their members are compared in vain
    patterns = F.array(
        *(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks(distance)))
    )
    members = codes.select("fp", F.explode(patterns).alias("pattern"))
    met = _with_cells(members, cell).repartition("pattern", "cell").sortWithinPartitions("pattern", "cell")
    return met.mapInArrow(_stars(distance), "a long, b long")


def _rooted(signed: DataFrame, distance: int) -> DataFrame:
    """``fp, first, root``: the distinct fingerprints with their least doc_id and their component."""
    codes = signed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(codes.select("fp"), distance))
    return codes.join(found, codes["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row; the component's id is the least doc_id that can be reached."""
    signed = stored(signatures(docs))
    rooted = stored(_rooted(signed, distance))
    # stored, so that the join has a plain exchange on either side and the skew join can split a hot root
    named = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    of_code = rooted.join(named, "root").select(F.col("fp").alias("code"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return signed.join(of_code, F.col("fp") == F.col("code")).select("doc_id", hexed, "component_id")


def _signed(docs: DataFrame, name: str) -> DataFrame:
    """The documents with their fingerprint in one more column."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            codes = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, name])

    return docs.mapInArrow(sign, StructType([*docs.schema.fields, StructField(name, LongType())]))


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents, all columns as they are, cut to the one with the least doc_id of each component.

    Of repeated rows of that id one stays. An empty table gives an empty result.
    """
    fp = free_name(docs, "fp")
    rooted = _rooted(stored(signatures(docs)), distance)
    first = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), F.col("fp").alias("code")))
    # plain columns as keys, so that the join and the choice among repeated rows share one exchange of the texts
    key = [fp, free_name(docs, "no_id"), free_name(docs, "known_id")]
    of = lambda doc_id: [doc_id.isNull().alias(key[1]), F.coalesce(doc_id, F.lit(0)).alias(key[2])]
    chosen = rooted.groupBy("root").agg(first.alias("kept")).select(F.col("kept.code").alias(fp), *of(F.col("kept.id")))
    signed = _signed(docs, fp).select("*", *of(F.col("doc_id")))
    return signed.join(chosen, key, "left_semi").dropDuplicates(key).drop(*key)
