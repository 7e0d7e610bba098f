"""Document fingerprints: a quartile bucket digest of hashed byte triplets, and a bounded difference between digests.

Every byte triplet of the UTF-8 text is hashed into one of 1024 buckets. A bucket's code is the quarter of the bucket
counts its own count falls into, 0 to 3. The digest is, in hexadecimal, a checksum byte, the logarithm of the length, the
ratios of the quartiles, and the buckets' codes, two bits each. Two digests differ by the distance of their lengths and
ratios plus the distance of each pair of bucket codes, where opposite quarters weigh double; the likeness is one less
the difference's share of its greatest value. Equal texts have equal digests and likeness 1.

For the query each document is compared with an edited copy and with its successor in descending ``doc_id`` order. The
order comes from one range exchange; each sorted partition streams through a Python worker that holds two texts at a
time. Only the first and last text of each partition travel on, to be matched with their neighbours' there.

Null text counts as empty; texts of fewer than three bytes have no triplets and codes of zero. Equal ids follow each other
in the order of their texts; null ids come last. A single document is its own successor. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tagwise.llm.common import stored

BUCKETS = 1024
#: Largest counted distances of the logarithmic length and of each quartile ratio, and the weight of a step in them.
LENGTH_CAP, RATIO_CAP, STEP = 12, 7, 12
#: Bytes that are counted in one step.
CHUNK = 1 << 20
#: Difference of two bucket codes.
_CODE_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
WORST = 1 + LENGTH_CAP * STEP + 2 * RATIO_CAP * STEP + 6 * BUCKETS
#: Fixed value: the golden ratio's multiplier of multiplicative hashing.
_GOLDEN = np.uint32(2654435769)


def digest(text: bytes) -> bytes:
    """Checksum, length, ratios and the buckets' codes."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), CHUNK):
        a = np.frombuffer(text, np.uint8, min(CHUNK + 2, len(text) - at), at).astype(np.uint32)
        if len(a) >= 3:
            triplets = a[:-2] << 16 | a[1:-1] << 8 | a[2:]
            counts += np.bincount(triplets * _GOLDEN >> 32 - BUCKETS.bit_length() + 1, minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    length = min(255, round(8 * np.log2(len(text) + 1)))
    ratios = (int(16 * q1 // q3) % 16 << 4 | int(16 * q2 // q3) % 16) if q3 else 0
    return bytes([zlib.crc32(text) & 255, length, ratios]) + packed.astype(np.uint8).tobytes()


def _codes(packed: bytes) -> np.ndarray:
    a = np.frombuffer(packed, np.uint8)
    return np.stack([a >> 6, a >> 4 & 3, a >> 2 & 3, a & 3], axis=1).ravel()


def difference(x: bytes, y: bytes) -> int:
    """From 0, for equal digests, to ``WORST``."""
    if x == y:
        return 0
    length = min(abs(x[1] - y[1]), LENGTH_CAP)
    around = lambda a, b: min(abs(a - b), 16 - abs(a - b), RATIO_CAP)
    ratios = around(x[2] >> 4, y[2] >> 4) + around(x[2] & 15, y[2] & 15)
    return int((x[0] != y[0]) + (length + ratios) * STEP + _CODE_STEP[_codes(x[3:]), _codes(y[3:])].sum())


def likeness(x: bytes, y: bytes) -> float:
    return 1 - difference(x, y) / WORST


_HEX = ("edited_sha256", "fingerprint", "edited_fingerprint")  # bytes until the end, to be written small
_RESULT = f"n_chars long, {', '.join(f'{c} binary' for c in _HEX)}, near_edited double, near_next double"


def _compared(text: str, following: str, own: bytes, next_: bytes) -> dict:
    half = len(text) // 2
    edited = (text[: len(text) - half] + following[:half]).encode()
    other = digest(edited)
    return {
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited).digest(),
        "fingerprint": own,
        "edited_fingerprint": other,
        "near_edited": likeness(own, other),
        "near_next": likeness(own, next_),
    }


def _stream(schema: pa.Schema):
    """Compares each text of a sorted partition with the next; the first and last row also tell their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, rows = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                own = digest(text.encode())
                if last is None:
                    rows.append({"end": "first", "part": part, "text": text})
                else:
                    rows.append({"doc_id": last[0], "part": part} | _compared(last[1], text, last[2], own))
                last = doc_id, text, own
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"end": "last", "part": part, "doc_id": last[0], "text": last[1]}], schema)

    return run


def _pairs(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"doc_id": r["doc_id"]} | _compared(r["text"], r["next"], digest(r["text"].encode()), digest(r["next"].encode()))
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its digest, that of its edited copy, and their likeness and that to the next document's."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    numbers = [("n_chars", pa.int64()), *((c, pa.binary()) for c in _HEX)]
    numbers += [("near_edited", pa.float64()), ("near_next", pa.float64())]
    ends = [("end", pa.string()), ("part", pa.int32()), ("text", pa.string())]
    own = docs.select("doc_id", "text")
    ordered = own.repartitionByRange(F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "text")
    seen = stored(
        ordered.mapInArrow(
            _stream(pa.schema([("doc_id", id_type), *ends, *numbers])),
            f"doc_id {kind}, end string, part int, text string, {_RESULT}",
        )
    )
    firsts = seen.where("end = 'first'").select("part", F.col("text").alias("next"))
    follow = (  # at most one row per partition
        firsts.select("part").withColumn("of", F.lag("part").over(Window.orderBy("part")))
        .withColumn("of", F.coalesce("of", F.max("part").over(Window.partitionBy())))
    )
    lasts = seen.where("end = 'last'").select("doc_id", F.col("part").alias("of"), "text")
    across = lasts.join(follow, "of").join(firsts, "part").select("doc_id", "text", "next")
    bounds = across.mapInArrow(_pairs(pa.schema([("doc_id", id_type), *numbers])), f"doc_id {kind}, {_RESULT}")
    inside = seen.where("end is null").drop("end", "part", "text")
    return inside.unionByName(bounds).withColumns({c: F.lower(F.hex(c)) for c in _HEX})
