"""Phrase collocation mining by SETM: sorted occurrence relations, joined with themselves position by position.

The occurrences of words, in the order of piece and position, are kept in blocks of about ``BLOCK`` rows as a stored
table; the place in the block is the position, and a gap ends a piece. Rare words are counted first and left out of it. Length by length, each block's relation of
frequent phrases is merge-joined with itself at the adjacent position (a phrase and the one that begins a word later make
the next longer) and its groups are counted. What moves is a hash and a count per group and task, sorted and packed
by ranges of hashes; each range is added up, and hashes with enough occurrences go back to the blocks, where a semi-join
leaves only their occurrences before the next length. Of what is left the phrases themselves are counted, as text, and
those that are frequent are the result: hashes only save work, and two phrases that share one cost a little of it. Words
go through the same steps as phrases of length one, counted from the texts. A table of frequent hashes of a checked small size is sent to the
blocks; a larger one meets the blocks' groups in a shuffle, and each block gets the list of its own that are frequent.

Phrases are told apart by language. No task holds more than a block, ``HELD`` groups of its own, or the groups of a range.

Null text counts as empty, a null language as ``und``; repeated rows count as often as they occur; ids and other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tagwise.llm.common import stored

#: Fixed values of the contract.
LEAST, LONGEST, TOP, SCALE, COVERED = 30, 4, 2000, 2_000_000, 80
_PIECE_END = re.compile(r"[.,;:!?\n-\r]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z alone
#: Codes of what is no word: the end of a piece, and nothing between two blanks.
END, NOTHING = -1, -2
#: Occurrences of a block; a text is never cut, so a longer one makes a longer block.
BLOCK = 1 << 20
#: Rows of a batch of groups.
BATCH = 1 << 16
#: Groups that a task gathers before it passes their counts on, and words that it holds as text.
HELD, HELD_WORDS = 1 << 22, 300_000
#: Frequent hashes that may be sent to all tasks (eight bytes each).
SMALL = 4_000_000
#: Fewest bits of a hash, and how many more than it takes to number all words: a rare phrase is then taken for frequent
#: only where it shares its hash with one, and that is found out when the phrases themselves are counted.
BITS, SPARE = 32, 3
#: Bits of a word's hash, as the words are not numbered yet.
WORD_BITS = 40
#: Fixed values of a common 64-bit mixing function.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_BLOCKS = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("langs", "sums", "words", "lang_of", "codes", "here"))])
_BLOCK_KIND = "block long, langs binary, sums binary, words binary, lang_of binary, codes binary, here binary"
_PACKED = pa.schema([("range", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_LISTED = pa.schema([("block", pa.int64()), ("nth", pa.int32()), ("hash", pa.int64())])
_GROUPS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _squeezed(raw: bytes) -> bytes:
    """Compressed, with the length before it."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _restored(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, "zstd", asbytes=True) if size else b""


def _packed(numbers: np.ndarray) -> bytes:
    return _squeezed(numbers.astype("<i4").tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(_restored(packed), "<i4")


def _planes(numbers: np.ndarray) -> bytes:
    """Non-negative numbers, compressed byte by byte."""
    kind = "<u4" if not len(numbers) or numbers.max() < 1 << 32 else "<u8"
    raw = numbers.astype(kind).view(np.uint8).reshape(len(numbers), int(kind[-1])).T.tobytes()
    return kind[-1].encode() + _squeezed(raw)


def _of_planes(packed: bytes) -> np.ndarray:
    width = int(packed[:1])
    planes = np.frombuffer(_restored(packed[1:]), np.uint8)
    return np.frombuffer(planes.reshape(width, len(planes) // width).T.tobytes(), f"<u{width}").astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX[0]
    x = (x ^ x >> np.uint64(27)) * _MIX[1]
    return x ^ x >> np.uint64(31)


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order with the sums of their counts."""
    hashes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, np.int64)
    return hashes[start], np.add.reduceat(counts[order], start) if len(start) else counts


def _word_hashes(langs: Iterable[str], words: Iterable[str]) -> np.ndarray:
    each = [f"{lang}\t{word}".encode("utf-8", "surrogatepass") for lang, word in zip(langs, words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, len(each))


def _held(frequent: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes are among the sorted frequent ones."""
    if not len(frequent):
        return np.zeros(len(hashes), bool)
    return frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes


class Block:
    """Codes of words in order, negative between pieces; where frequent phrases begin; words, languages, both by code.

    ``sums`` are all words of each language that the block had at first.
    """

    def __init__(self, words: list[str], lang_of: np.ndarray, langs: list[str], codes: np.ndarray, here: np.ndarray, sums: np.ndarray) -> None:
        self.words, self.lang_of, self.langs, self.codes, self.here, self.sums = words, lang_of, langs, codes, here, sums

    @classmethod
    def of(cls, row: dict) -> Block:
        texts = [json.loads(_restored(row[c])) for c in ("words", "langs")]
        codes = _of_planes(row["codes"]).astype(np.int32) + END
        here = np.unpackbits(np.frombuffer(_restored(row["here"]), np.uint8), count=len(codes)).astype(bool)
        return cls(texts[0], _unpacked(row["lang_of"]), texts[1], codes, here, _of_planes(row["sums"]))

    def batch(self, number: int) -> pa.RecordBatch:
        row = {"block": number, "lang_of": _packed(self.lang_of), "codes": _planes(self.codes - END), "sums": _planes(self.sums)}
        row |= {c: _squeezed(json.dumps(x).encode()) for c, x in (("words", self.words), ("langs", self.langs))}
        return pa.RecordBatch.from_pylist([row | {"here": _squeezed(np.packbits(self.here).tobytes())}], _BLOCKS)

    def relation(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Position and group of each occurrence of a phrase of frequent parts: relations of one word, joined step by
        step at the adjacent position."""
        starts = np.flatnonzero(self.codes >= 0)
        groups = self.codes[starts].astype(np.int64)
        for step in range(2, length + 1):
            follows = np.flatnonzero(starts[1:] == starts[:-1] + 1)  # sorted, so the adjacent position is the next row
            if step == length:  # both parts are frequent
                follows = follows[self.here[starts[follows]] & self.here[starts[follows + 1]]]
            _, groups = np.unique(groups[follows] << 32 | groups[follows + 1], return_inverse=True)
            starts = starts[follows]
        return starts, groups

    def _names(self) -> np.ndarray:
        return _word_hashes(map(self.langs.__getitem__, self.lang_of.tolist()), self.words)

    def of_words(self, bits: int) -> np.ndarray:
        """A hash of so many bits of each word, as ``hashes`` has it for length one."""
        return (_mixed(self._names()) >> np.uint64(64 - bits)).astype(np.int64)

    def hashes(self, starts: np.ndarray, length: int, bits: int) -> np.ndarray:
        """A hash of so many bits of language and phrase at the positions."""
        of_word = self._names()
        found = np.zeros(len(starts), np.uint64)
        for i in range(length):
            found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + of_word[self.codes[starts + i]])
        return (found >> np.uint64(64 - bits)).astype(np.int64)

    def texts(self, starts: np.ndarray, length: int) -> tuple[pa.Array, pa.Array]:
        """Language and phrase at the positions."""
        words, langs = pa.array(self.words, pa.string()), pa.array(self.langs, pa.string())
        parts = [words.take(pa.array(self.codes[starts + i])) for i in range(length)]
        phrase = pa.compute.binary_join_element_wise(*parts, " ") if length > 1 else parts[0]
        return langs.take(pa.array(self.lang_of[self.codes[starts]])), phrase

    def cut(self, starts: np.ndarray, length: int) -> Block:
        """What is left for longer phrases: the words of the occurrences, one gap between those that are apart."""
        used = np.zeros(len(self.codes), bool)
        for i in range(length):
            used[starts + i] = True
        stays = used | np.r_[False, used[:-1]]
        here = np.zeros(len(self.codes), bool)
        here[starts] = True
        codes = np.where(used, self.codes, END)[stays]
        left, renamed = np.unique(codes[codes >= 0], return_inverse=True)
        codes[codes >= 0] = renamed
        words = [self.words[k] for k in left.tolist()]
        return Block(words, self.lang_of[left], self.langs, codes, here[stays], self.sums)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Language and tokens of each text: words, empty strings between two blanks, and line ends where a piece ends."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            low = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
            yield lang, _PIECE_END.sub(" \n ", low).replace("\t", " ").split(" ")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts of the words, a part at a time."""
    counts: dict[str, Counter[str]] = {}

    def part() -> tuple[np.ndarray, np.ndarray]:
        pairs = [(lang, word, n) for lang, own in counts.items() for word, n in own.items() if word not in ("", "\n")]
        langs, words, n = zip(*pairs) if pairs else ((), (), ())
        return (_mixed(_word_hashes(langs, words)) >> np.uint64(64 - WORD_BITS)).astype(np.int64), np.array(n, np.int64)

    for lang, tokens in _tokens(batches):
        counts.setdefault(lang, Counter()).update(tokens)
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield part()
            counts.clear()
    yield part()


def _occurrences(size: int, frequent: np.ndarray | None):
    """Blocks of the texts in their order, of the words with frequent hashes or, without these, of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held = TaskContext.get().partitionId(), 0, 0
        known: dict[str, dict[str, int]] = {}
        codes: list[np.ndarray] = []
        n_words = 0

        def block() -> pa.RecordBatch:
            words, lang_of = [""] * n_words, np.zeros(n_words, np.int32)
            for i, found in enumerate(known.values()):
                for word, code in found.items():
                    if code >= 0:
                        words[code], lang_of[code] = word, i
            every = np.concatenate(codes)
            every = every[every != NOTHING]
            sums = np.bincount(lang_of[every[every >= 0]], minlength=len(known))
            whole = Block(words, lang_of, list(known), every, every >= 0, sums)
            if frequent is not None:
                starts = np.flatnonzero(every >= 0)
                whole = whole.cut(starts[_held(frequent, whole.of_words(WORD_BITS))[every[starts]]], 1)
            return whole.batch(part << 32 | nth)

        for lang, tokens in _tokens(batches):
            own = known.setdefault(lang, {"": NOTHING, "\n": END})
            new = list(set(tokens).difference(own))
            own.update(zip(new, range(n_words, n_words + len(new))))
            n_words += len(new)
            codes += [np.fromiter(map(own.__getitem__, tokens), np.int32, len(tokens)), np.array([END], np.int32)]
            held += len(tokens)
            if held >= size:
                yield block()
                known, codes, n_words, held, nth = {}, [], 0, 0, nth + 1
        if codes:
            yield block()

    return run


def _gathered(each: Iterator[tuple[np.ndarray, np.ndarray]], ranges: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Hashes with their counts, added up and packed by ranges of hashes."""

    def packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, counts = _added_up(parts)
        cuts = np.searchsorted(hashes, [(r << bits) // ranges for r in range(ranges + 1)])
        rows = [
            {"range": r, "hashes": _planes(np.diff(hashes[i:j], prepend=0)), "counts": _planes(counts[i:j])}
            for r, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist()))
            if i < j
        ]
        return pa.RecordBatch.from_pylist(rows, _PACKED)

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for part in each:
        parts.append(part)
        if sum(len(x) for x, _ in parts) > HELD:
            parts = [_added_up(parts)]
            if len(parts[0][0]) > HELD // 2:
                yield packed(parts)
                parts = []
    if parts:
        yield packed(parts)


def _hashed(length: int, ranges: int, bits: int):
    """The hashes and counts of a task's groups of phrases of one length; of words if the rows are texts."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            block = Block.of(row)
            starts, of = block.relation(length)
            _, first, n = np.unique(of, return_index=True, return_counts=True)
            yield block.hashes(starts[first], length, bits), n

    each = _words if length == 1 else groups
    return lambda batches: _gathered(each(batches), ranges, bits)


def _frequent(least: int):
    """The hashes of each range that have enough occurrences, from batches ordered by range."""

    def told(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, counts = _added_up(parts)
        return pa.RecordBatch.from_arrays([pa.array(hashes[counts >= least], pa.int64())], ["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for row in (r for batch in batches for r in batch.to_pylist()):
            if row["range"] != now and parts:
                yield told(parts)
                parts = []
            now = row["range"]
            parts.append((np.cumsum(_of_planes(row["hashes"])), _of_planes(row["counts"])))
            if sum(len(x) for x, _ in parts) > HELD:
                parts = [_added_up(parts)]
        if parts:
            yield told(parts)

    return run


def _rare(length: int, bits: int):
    """A block's groups with fewer than ``LEAST`` occurrences: only others can make them frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            block = Block.of(row)
            starts, groups = block.relation(length)
            nth, first, n = np.unique(groups, return_index=True, return_counts=True)
            nth, first = nth[n < LEAST], first[n < LEAST]
            number = pa.array(np.full(len(nth), row["block"]))
            columns = [number, pa.array(nth.astype(np.int32)), pa.array(block.hashes(starts[first], length, bits))]
            yield pa.RecordBatch.from_arrays(columns, schema=_LISTED)

    return run


def _extended(length: int, bits: int, frequent: np.ndarray | None):
    """The semi-join of a block's relation with its frequent groups; what no longer phrase can use goes.

    Without the sorted frequent hashes the block's own are listed in its row, but for those of ``LEAST`` or more
    occurrences in the block, which are frequent whatever the others hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            block = Block.of(row)
            starts, groups = block.relation(length)
            nth, first, which, n = np.unique(groups, return_index=True, return_inverse=True, return_counts=True)
            kept = n >= LEAST
            if frequent is None:
                kept |= np.isin(nth, np.array(row["listed"] or [], np.int64))
            else:
                kept |= _held(frequent, block.hashes(starts[first], length, bits))
            starts = starts[kept[which]]
            if len(starts):
                yield block.cut(starts, length).batch(row["block"])

    return run


def _counted(length: int):
    """The phrases of what is left in a block, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            block = Block.of(row)
            starts = np.flatnonzero(block.here)
            key = block.codes[starts].astype(np.int64)
            for i in range(1, length):
                _, key = np.unique(key << 32 | block.codes[starts + i], return_inverse=True)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            for at in range(0, len(first), BATCH):
                lang, phrase = block.texts(starts[first[at : at + BATCH]], length)
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(n[at : at + BATCH])], schema=_GROUPS)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words of each language."""
    for row in (r for batch in batches for r in batch.to_pylist()):
        langs = json.loads(_restored(row["langs"]))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(_of_planes(row["sums"]))], ["lang", "f"])


def _few(hashes: DataFrame) -> np.ndarray | None:
    """The frequent hashes in ascending order, if they are of a small number."""
    if hashes.count() > SMALL:
        return None
    return np.sort(hashes.toArrow().column("hash").to_numpy())


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, bits: int | None = None
) -> DataFrame:
    """``lang, phrase, size, f``: the phrases of up to ``longest`` words with at least ``least`` occurrences, and
    all words of each language under a null phrase."""
    assert least >= LEAST  # a block takes groups of LEAST occurrences for frequent
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def hashes_of(rows: DataFrame, length: int, bits: int) -> tuple[DataFrame, np.ndarray | None]:
        parts = rows.mapInArrow(_hashed(length, ranges, bits), "range int, hashes binary, counts binary")
        dealt = parts.repartition("range").sortWithinPartitions("range")
        hashes = stored(dealt.mapInArrow(_frequent(least), "hash long"))
        return hashes, _few(hashes)

    hashes, few = hashes_of(texts, 1, WORD_BITS)
    blocks = stored(texts.mapInArrow(_occurrences(block, few), _BLOCK_KIND))
    found = stored(
        blocks.mapInArrow(_totals, "lang string, f long").groupBy("lang").agg(F.sum("f").alias("f"))
        .select("lang", F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("size"), "f")
    )
    if bits is None:
        bits = max(BITS, (found.agg(F.sum("f")).first()[0] or 0).bit_length() + SPARE)
    for length in range(1, longest + 1):
        width = WORD_BITS if length == 1 else bits
        if length > 1:
            hashes, few = hashes_of(blocks, length, bits)
        met = blocks
        if few is None:
            rare = blocks.mapInArrow(_rare(length, width), "block long, nth int, hash long")
            listed = (
                rare.join(hashes, "hash", "left_semi").groupBy("block")
                .agg(F.collect_list("nth").alias("listed"))  # at most a block's groups
            )
            met = blocks.join(listed, "block", "left")
        if length > 1 or few is None:
            blocks = met.mapInArrow(_extended(length, width, few), _BLOCK_KIND)
            if length < longest:  # else they are read once
                blocks = stored(blocks)
        sums = blocks.mapInArrow(_counted(length), "lang string, phrase string, n long").groupBy("lang", "phrase")
        frequent = stored(sums.agg(F.sum("n").alias("f")).where(F.col("f") >= least))
        found = found.unionByName(frequent.select("lang", "phrase", F.lit(length).alias("size"), "f"))
        if frequent.isEmpty():
            break
    return stored(found)


def _cuts(candidates: DataFrame) -> DataFrame:
    """A row per cut of each candidate: ``first`` k words and the ``rest``."""
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    k = F.col("k")
    return candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", "a", "k", joined(F.lit(1), k).alias("first"),
        joined(k + 1, F.col("size") - k).alias("rest"),
    )


def _inside(candidates: DataFrame) -> DataFrame:
    """Per phrase inside a longer candidate the largest count of such."""
    words = F.split("phrase", " ")
    spans = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(n).alias("n")) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)))
    usable = F.filter(spans, lambda s: (s["n"] < F.col("size")) & (s["at"] + s["n"] - 1 <= F.col("size")))
    inner = F.transform(usable, lambda s: F.array_join(F.slice(words, s["at"], s["n"]), " "))
    return (
        candidates.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )


def collocations(docs: DataFrame, top: int = TOP, block: int = BLOCK, bits: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    known = frequent_phrases(docs, block=block, bits=bits)
    totals = known.where("size = 0").select("lang", F.col("f").alias("n"))
    counts = known.where("size > 0").select("lang", F.col("phrase").alias("part"), "f")
    candidates = known.where("size > 1").withColumnRenamed("f", "a")
    first = counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    rest = counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.expr(f"cast(({SCALE} * cast(a as decimal(24,0))) div (cast(l as decimal(20,0)) + r) as long)")
    cut = _cuts(candidates).join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).withColumn("score", score)
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cut.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.*").drop("k")
    alone = scored.join(_inside(candidates), ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * wide("longer") < COVERED * wide("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
