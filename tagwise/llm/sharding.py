"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until each splitter is found.

The sort key is (60 bits of the text's MD5, 60 bits of the document id's MD5): equal texts lie side by side, and a group
of copies of any size can still be cut. Splitter ``s`` is the least key below which ``s / shards`` of all bytes lie. Each
round counts, in one pass, the bytes in 1024 equal cells of every interval that still holds a splitter, and keeps the one
cell that holds it; rows of decided intervals take no further part. Only the cells' sums reach the driver, at most
1024 per splitter. At the end the rows move once, to their shard and a salt in it, where they get their slots.

Null text has no bytes and is hashed like an empty one, a null id like an empty one. Rows equal in text and id share a
key and therefore a shard. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwise.llm.common import hex_bits, stored, text_of

OVERHEAD = 8
KEY_BITS = 60
DIGIT_BITS = 10
#: Rows of a group that gets its slots in one window, and the fewest groups of a shard, as bits.
ROWS, SALT_BITS = 1 << 20, 6
KEYS = ("k1", "k2")


@dataclass
class _Search:
    """A splitter that is still looked for: it lies in the cell ``prefix`` of ``depth`` digits of key ``level``."""

    target: int
    below: int = 0
    level: int = 0
    depth: int = 0
    prefix: int = 0
    first: int = 0
    found: tuple[int, int] | None = field(default=None)

    def cell(self) -> tuple[int, int, int, int]:
        return self.level, self.depth, self.first, self.prefix


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    whole = text_of(text)
    return docs.select(
        "doc_id",
        (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        hex_bits(F.md5(whole)).alias("k1"),
        hex_bits(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("k2"),
    )


def _cells(rows: DataFrame, level: int, depth: int, cells: set[tuple[int, int]]) -> dict[int, list]:
    """Sums by (key above, cell) over the next digit of the given cells, each list in the order of the cells."""
    key, shift = KEYS[level], KEY_BITS - DIGIT_BITS * (depth + 1)
    inside = rows
    if level:
        inside = inside.where(F.col("k1").isin([first for first, _ in cells]))
    if depth:
        inside = inside.where(F.shiftright(key, shift + DIGIT_BITS).isin([prefix for _, prefix in cells]))
    group = [F.col("k1") if level else F.lit(0).alias("k1"), F.shiftright(key, shift).alias("cell")]
    sums = inside.groupBy(*group).agg(
        F.sum("size").alias("bytes"), F.min(key).alias("least"), F.max(key).alias("most"), F.count("*").alias("n")
    )
    found: dict[tuple[int, int], list] = {}
    for row in sorted(sums.collect()):
        found.setdefault((row["k1"], row["cell"] >> DIGIT_BITS), []).append(row)
    return found


def _narrow(search: _Search, cells: list, tolerance: int) -> None:
    shift = KEY_BITS - DIGIT_BITS * (search.depth + 1)
    for row in cells:
        upto = search.below + row["bytes"]
        if upto < search.target - tolerance:
            search.below = upto
            continue
        end = row["most"] + 1
        if row["n"] == 1 or upto <= search.target + tolerance or row["least"] == row["most"] and search.level == 1:
            search.found = (end, 0) if search.level == 0 else (search.first, end)
        elif row["least"] == row["most"]:  # many rows of one text: go on by document
            search.level, search.depth, search.prefix, search.first = 1, 0, 0, row["least"]
        else:
            search.depth, search.prefix = search.depth + 1, row["least"] >> shift
        return
    raise AssertionError("a splitter's interval holds fewer bytes than its sum said")


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.0) -> list[tuple[int, int]]:
    """Boundaries (k1, k2) of the shards; a row's shard is the number of boundaries at or below its key.

    ``tolerance`` is the share of a shard's even size by which a boundary may miss its target; 0 finds it exactly.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = int(tolerance * total / shards)
    searches = [_Search(target=-(-s * total // shards)) for s in range(1, shards)] if total else []
    while open_ := [s for s in searches if s.found is None]:
        for level, depth in sorted({(s.level, s.depth) for s in open_}):
            here = [s for s in open_ if (s.level, s.depth) == (level, depth)]
            found = _cells(rows, level, depth, {(s.first, s.prefix) for s in here})
            for search in here:
                _narrow(search, found[(search.first, search.prefix)], slack)
    return [s.found for s in searches]


def _shard_of(bounds: list[tuple[int, int]]) -> Column:
    shard = F.lit(0)
    for k1, k2 in bounds:
        at_or_over = (F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))
        shard = shard + at_or_over.cast("int")
    return shard


def shard_by_bytes(docs: DataFrame, shards: int = 24, tolerance: float = 0.0) -> DataFrame:
    """Each document's shard, of nearly equal sums of ``size``, and its gapless ``slot`` there."""
    rows = stored(keyed(docs))
    # more groups for more rows; a group is a range of the order, so the slots do not depend on their number
    bits = max(SALT_BITS, (rows.count() // (shards * ROWS)).bit_length())
    mixed = F.col("k1").bitwiseXOR(F.col("k2"))  # rows of one text, and rows of one id, lie in many groups
    placed = rows.withColumn("shard", _shard_of(splitters(rows, shards, tolerance))).withColumns(
        {"place": mixed, "salt": F.shiftright(mixed, KEY_BITS - bits)}
    )
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "salt")
        .agg(F.count("*").alias("n"))
        .select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    in_salt = Window.partitionBy("shard", "salt").orderBy("place", "k1", "k2", "doc_id")
    numbered = placed.withColumn("nth", F.row_number().over(in_salt))
    few = shards << bits <= 20_000  # as many rows as starts can have
    return numbered.join(F.broadcast(starts) if few else starts, ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
