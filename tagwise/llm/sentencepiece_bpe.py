"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary of a SentencePiece BPE model is read once on the driver and travels with the job, so executors need no
file. A text is encoded run by run, a run being letters, or other characters, with the blanks before them; no piece of
the vocabulary reaches across a run's end, which is verified when it is read. Within a run an agenda of adjacent symbols
is worked off by score, and the nth candidate merge is skipped where the nth byte of a hash falls below the dropout rate.
The hash is keyed by the seed, the document and the run's place in it, so that every occurrence of a run is segmented for
itself. Characters without a piece become byte pieces; decoding joins the pieces' bytes and gives back every text
exactly, whatever was dropped.

What a run becomes depends on no more than the set of its candidates that are skipped. A worker remembers these sets as a
tree per run: a node has the pieces, the number of candidates that were looked at on the way, and a child for each of
them that may be skipped next. An occurrence goes down the tree by its own hash, and only new nodes are worked off. A run
gets a tree when it is seen for the second time.

Null and empty texts have no pieces and decode to the empty text; null ids are keyed alike; repeated rows are encoded
alike; an empty table gives an empty result. ``encoded`` keeps all columns of its input under their names and puts the
pieces last, under a free name.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tagwise.llm.common import slices
from tagwise.llm.learning import free_name

SEED = 4
DROPOUT = 0.1
#: Bytes, by estimate, that a worker's trees may take before they are forgotten.
KEPT_BYTES = 32 << 20
BLANK = "▁"
LITERAL = "\0▁\0"
#: Runs of at most so many characters have a tree; longer ones are worked off one by one. The pieces are the same.
LONG = 48
#: Candidates that a tree can tell apart; an occurrence that looks at more is worked off by itself.
WIDE = 64
#: Symbols, with what they are filled up with, that are worked off together; they stay in a processor's cache.
CELLS = 1 << 16
#: Numbers of characters that have no piece begin here.
OTHER = 1 << 24
#: Value of what is not in the agenda.
NEVER = np.iinfo(np.int64).max
#: Fixed values of a common 64-bit mixing function.
_STEP, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


#: The codecs of this process: a worker keeps what it remembers from task to task.
_LIVE: dict[str, dict] = {}


def _packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, np.int32).tobytes()


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(_MIX[0])
    x = (x ^ x >> np.uint64(27)) * np.uint64(_MIX[1])
    return x ^ x >> np.uint64(31)


class Draws:
    """Skipped candidates of many occurrences: the nth byte of a hash that goes on as long as is asked for."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def bits(self, names: np.ndarray, words: range) -> np.ndarray:
        """Bit n tells whether candidate n is skipped, for the candidates of some of the first eight words."""
        found = np.zeros(len(names), np.uint64)
        for w in words:
            mixed = _mixed(names + np.uint64((w + 1) * _STEP & (1 << 64) - 1))
            below = mixed.astype("<u8").view(np.uint8).reshape(-1, 8) < self.limit
            found |= np.packbits(below, axis=1, bitorder="little").ravel().astype(np.uint64) << np.uint64(8 * w)
        return found

    def one(self, name: int) -> Callable[[int], bool]:
        """Whether candidate n of an occurrence is skipped, for any n."""
        words: list[bytes] = []

        def skipped(n: int) -> bool:
            while n >= 8 * len(words):
                step = np.uint64(name + (len(words) + 1) * _STEP & (1 << 64) - 1)
                words.append(_mixed(np.array([step])).astype("<u8").tobytes())
            return words[n // 8][n % 8] < self.limit

        return skipped


def key_of(doc_id: int | None) -> int:
    return xxhash.xxh64_intdigest("" if doc_id is None else str(doc_id))


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, model_file: str, dropout: float = DROPOUT, seed: int = SEED) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.limit, self.seed = round(dropout * 256), seed
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
        self.name = f"{xxhash.xxh3_64_hexdigest(repr(sorted(self.scores.items())))}:{self.limit}:{seed}"
        letter = self._letter()
        self.runs = re.compile(rf" *{letter}+| *(?:(?!{letter})[^ ])+| +")
        #: Of each character: 0 for the blank, 1 for letters, 2 for others.
        self.kind = np.full(0x110000, 2, np.uint8)
        self.kind[[m.start() for m in re.finditer(letter, "".join(map(chr, range(len(self.kind)))))]] = 1
        self.kind[ord(" ")] = 0
        self._pair_table()
        self.draws = Draws(self.limit)
        self._forget()

    def _forget(self) -> None:
        self.roots: dict[str, int] = {}
        self.once: set[str] = set()
        self.children: dict[int, int] = {}
        #: Of each node: pieces, candidates that were looked at, and run and skipped candidates that it stands for.
        self.pieces_of: list[bytes] = []
        self.looked = np.zeros(0, np.int64)
        self.run_of: list[str] = []
        self.skips = np.zeros(0, np.uint64)
        self.held = 0

    def __getstate__(self) -> dict:
        left_out = ("roots", "once", "children", "pieces_of", "looked", "run_of", "skips", "held")
        model = {k: v for k, v in self.__dict__.items() if k not in left_out}
        return {"name": self.name, "model": pickle.dumps(model, pickle.HIGHEST_PROTOCOL)}

    def __setstate__(self, state: dict) -> None:
        if state["name"] not in _LIVE:  # else the model stays packed, as the process has it
            _LIVE[state["name"]] = pickle.loads(state["model"])
        self.__dict__ = _LIVE[state["name"]]
        if "roots" not in self.__dict__:
            self._forget()

    def _letter(self) -> str:
        """Pattern of letters. Runs are cut where no piece does join: before blanks, and between letters and others."""
        mixed = "".join(p for p in map(self._cased, self.ids) if re.search(r"[^\W\d_][\W\d_]|[\W\d_][^\W\d_]", p))
        if any(BLANK in self._cased(p) for p in self.ids):
            raise ValueError("the vocabulary has pieces that reach across words")
        return rf"[^\W\d_{re.escape(mixed)}]" if mixed else r"[^\W\d_]"

    @staticmethod
    def _cased(piece: str) -> str:
        return piece.lstrip(BLANK)

    def _segment(self, symbols: list[str], skipped: Callable[[int], bool]) -> tuple[list[str], int]:
        """Work the agenda of adjacent symbols off, best score and then leftmost first; also how many were looked at."""
        n, score_of, push = len(symbols), self.scores.get, heapq.heappush
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right < n and (score := score_of(symbols[left] + symbols[right])) is not None:
                push(agenda, (-score, left, right, symbols[left] + symbols[right]))

        for left in range(n - 1):
            propose(left, left + 1)
        looked = 0
        while agenda:
            _, left, right, merged = heapq.heappop(agenda)
            if after[left] != right or symbols[left] + symbols[right] != merged:
                continue  # one of the two has been merged since
            looked += 1
            if skipped(looked - 1):
                continue
            symbols[left], symbols[right] = merged, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            propose(before[left], left)
            propose(left, after[left])
        return [s for s in symbols if s], looked

    def _pair_table(self) -> None:
        """All pairs of symbols that make a piece, hashed, each with its value in the agenda: place, room for the row of
        the left symbol, and piece in one."""
        number = lambda x: self.ids.get(x, OTHER + ord(x[0]))
        pairs = {
            number(piece[:i]) << 32 | number(piece[i:]): i_piece
            for piece, i_piece in self.ids.items()
            for i in range(1, len(piece))
            if (piece[:i] in self.ids or i == 1) and (piece[i:] in self.ids or i == len(piece) - 1)
        }
        scores = {self.scores[piece] for piece in self.ids if len(piece) > 1}
        place = {score: k for k, score in enumerate(sorted(scores, reverse=True))}
        value_of = {i: place[self.scores[piece]] << 38 | i for piece, i in self.ids.items() if len(piece) > 1}
        codes = np.array(sorted(pairs), np.int64)
        values = np.array([value_of[pairs[x]] for x in codes.tolist()], np.int64)
        #: Tables of codes and values, each half as large as the one before; a pair is in the first with a free slot.
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        bits = max(8, len(codes).bit_length() + 2)
        while len(codes):
            slot = self._slots(codes, bits)
            _, first = np.unique(slot, return_index=True)
            keys, found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int64)
            keys[slot[first]], found[slot[first]] = codes[first], values[first]
            self.tables.append((bits, keys, found))
            rest = np.ones(len(codes), bool)
            rest[first] = False
            codes, values, bits = codes[rest], values[rest], max(8, bits - 1)
        self.symbol = np.arange(OTHER, OTHER + 0x110000, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i

    @staticmethod
    def _slots(codes: np.ndarray, bits: int) -> np.ndarray:
        mixed = codes.view(np.uint64) * np.uint64(_MIX[bits % 2] + 2 * bits)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The agenda's value of two symbols that make a piece; ``NEVER`` if they make none."""
        code = left << 32 | right
        code[right < 0] = -2
        found = np.full(len(code), NEVER, np.int64)
        open_ = np.arange(len(code))
        for bits, keys, values in self.tables:
            slot = self._slots(code, bits)
            key = keys[slot]
            hit = key == code
            found[open_[hit]] = values[slot[hit]]
            more = ~hit & (key >= 0)  # the slot is another pair's
            open_, code = open_[more], code[more]
        return found

    def _segment_alike(self, symbols: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_segment`` for many runs at once, each a column of symbols with -1 before and after it, with the set of
        skipped candidates of each as bits; columns with -1 for symbols that are gone, and how many candidates were looked
        at."""
        height, n = symbols.shape
        looked = np.zeros(n, np.int64)
        cells, place = symbols.ravel(), np.repeat(np.arange(height) << 32, n)
        after, before = np.arange(n, n * (height + 1)), np.arange(-n, n * (height - 1))
        pairs = np.full((height, n), NEVER)
        agenda = pairs.ravel()
        agenda[:-n] = self._looked_up(cells[:-n], cells[n:]) | place[:-n]
        while True:
            value = pairs.min(axis=0)  # the leftmost of the best place
            rows = np.flatnonzero(value < NEVER)
            if not len(rows):
                return cells.reshape(height, n), looked
            value = value[rows]
            left = (value >> 32 & 63) * n + rows
            agenda[left] = NEVER
            nth = looked[rows]
            looked[rows] += 1
            skip = (skips[rows] >> np.minimum(nth, WIDE - 1).astype(np.uint64) & np.uint64(1) > 0) & (nth < WIDE)
            left, merged = left[~skip], value[~skip] & 0xFFFFFFFF
            right, front = after[left], before[left]
            behind = after[right]
            cells[left], cells[right] = merged, -1
            after[left], before[behind] = behind, left
            agenda[right] = NEVER
            first = np.concatenate([front, left])
            agenda[first] = self._looked_up(cells[first], cells[np.concatenate([left, behind])]) | place[first]

    def _symbols(self, run: str) -> list[str]:
        """A run's characters, blanks as their piece; the character that stands for blanks has no piece of its own."""
        if BLANK in run:
            return [LITERAL if c == BLANK else BLANK if c == " " else c for c in run]
        return list(run.replace(" ", BLANK))

    def _bytes(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in (BLANK if character == LITERAL else character.replace(BLANK, " ")).encode()]

    def _alone(self, run: str, skipped: Callable[[int], bool]) -> tuple[bytes, int]:
        symbols, looked = self._segment(self._symbols(run), skipped)
        return _packed(y for x in symbols for y in ([self.ids[x]] if x in self.ids else self._bytes(x))), looked

    def _work_off(self, runs: list[str], skips: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The pieces of runs, packed as 32-bit numbers, and how many candidates each looked at."""
        found: list[bytes] = [b""] * len(runs)
        looked = np.zeros(len(runs), np.int64)
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        for k in [k for k, run in enumerate(runs) if BLANK in run]:
            bits, size[k] = int(skips[k]), 0
            found[k], looked[k] = self._alone(runs[k], lambda n: n < WIDE and bool(bits >> n & 1))  # noqa: B023
        order = np.argsort(size, kind="stable")
        order = order[np.searchsorted(size[order], 1) :]
        while len(order):
            some = order[: max(1, CELLS // (int(size[order[min(len(order), CELLS // 8) - 1]]) + 2))]
            order = order[len(some) :]
            nths, lengths = some.tolist(), size[some]
            joined = "".join([runs[k] for k in nths]).replace(" ", BLANK)
            row = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
            symbols = np.full((int(lengths[-1]) + 2, len(some)), -1, np.int64)
            symbols[row, np.repeat(np.arange(len(some)), lengths)] = self.symbol[
                np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
            ]
            symbols, looked[some] = self._segment_alike(symbols, skips[some])
            left = symbols.T[symbols.T >= 0]
            packed, ends = left.astype(np.int32).tobytes(), np.cumsum((symbols >= 0).sum(axis=0))
            start = 0
            for k, end in zip(nths, (4 * ends).tolist()):
                found[k] = packed[start:end]
                start = end
            for nth in np.unique(np.searchsorted(ends, np.flatnonzero(left >= OTHER), side="right")).tolist():
                found[nths[nth]] = _packed(
                    y
                    for x in _ids(found[nths[nth]]).tolist()
                    for y in ([x] if x < OTHER else self._bytes(chr(x - OTHER)))
                )
        return found, looked

    def _grow(self, runs: list[str], skips: np.ndarray) -> range:
        """New nodes for runs and their skipped candidates."""
        packed, looked = self._work_off(runs, skips)
        first = len(self.pieces_of)
        self.pieces_of += packed
        self.run_of += runs
        if len(self.looked) < len(self.run_of):
            more = max(len(self.run_of), 1 << 12)
            self.looked = np.r_[self.looked, np.zeros(more, np.int64)]
            self.skips = np.r_[self.skips, np.zeros(more, np.uint64)]
        self.looked[first : len(self.run_of)], self.skips[first : len(self.run_of)] = looked, skips
        self.held += sum(map(len, packed)) + 260 * len(runs)
        return range(first, len(self.run_of))

    def _rooted(self, runs: list[str], times: np.ndarray) -> np.ndarray:
        """The root of each of some distinct runs; -1 for those that occur once here and were not seen before, as they get
        a tree only when they are seen again."""
        root = np.fromiter((self.roots.get(run, -1) for run in runs), np.int64, len(runs))
        rare = [k for k in np.flatnonzero((root < 0) & (times == 1)).tolist() if runs[k] not in self.once]
        self.once.update(runs[k] for k in rare)
        self.held += 130 * len(rare)
        new = root < 0
        new[rare] = False
        grown = [runs[k] for k in np.flatnonzero(new).tolist()]
        root[new] = self._grow(grown, np.zeros(len(grown), np.uint64))
        self.roots.update(zip(grown, root[new].tolist()))
        return root

    def _nodes(self, node: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The node of each occurrence of a run of at most ``LONG`` characters, from its root."""
        one = np.uint64(1)
        open_, bits, drawn = np.arange(len(node)), self.draws.bits(names, range(2)), np.full(len(node), 16)
        while len(open_):
            more = (self.looked[node[open_]] > drawn) & (drawn < WIDE)
            if more.any():
                bits[more] |= self.draws.bits(names[open_[more]], range(2, WIDE // 8))
                drawn[more] = WIDE
            seen = self.looked[node[open_]]
            below = np.where(seen < WIDE, (one << np.minimum(seen, WIDE - 1).astype(np.uint64)) - one, ~np.uint64(0))
            on = bits & below != 0  # later bits are kept, as more may be looked at further down
            open_, bits, drawn = open_[on], bits[on], drawn[on]
            if not len(open_):
                break
            lowest = bits & (~bits + one)
            nth = np.bitwise_count(lowest - one).astype(np.int64)
            step, which = np.unique(node[open_] * WIDE + nth, return_inverse=True)
            steps = step.tolist()
            if missing := [x for x in steps if x not in self.children]:
                parents, nth = np.divmod(np.array(missing), WIDE)
                skips = self.skips[parents] | one << nth.astype(np.uint64)
                grown = self._grow([self.run_of[k] for k in parents.tolist()], skips)
                self.children.update(zip(missing, grown))
            node[open_] = np.array([self.children[x] for x in steps], np.int64)[which]
            bits ^= lowest
        return node

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct runs of texts, which of them each occurrence is, and the number of occurrences in each text."""
        joined = "".join([" " + text for text in texts if text])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        ends = np.cumsum([len(text) + 1 if text else 0 for text in texts], dtype=np.int64)
        begins[ends[ends < len(codes)]] = True
        cuts = np.r_[np.flatnonzero(begins), len(codes)]
        cells = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(4 * cuts), pa.py_buffer(codes)]
        ).dictionary_encode()
        which = cells.indices.to_numpy()
        some = np.zeros(len(cells.dictionary), np.int64)
        some[which] = np.arange(len(which))
        runs = [joined[i:j] for i, j in zip(cuts[some].tolist(), cuts[some + 1].tolist())]
        return runs, which, np.diff(np.searchsorted(cuts[:-1], ends), prepend=0)

    def encode_all(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """The pieces of each text, packed, with its document's key."""
        if self.held > KEPT_BYTES:
            self._forget()
        runs, which, sizes = self._cut(texts)
        ends = np.cumsum(sizes)
        place = np.arange(len(which)) - np.repeat(ends - sizes, sizes)
        names = _mixed(np.repeat(np.array(keys, np.uint64), sizes) + np.uint64(self.seed))
        names = _mixed(names + place.astype(np.uint64) * np.uint64(_STEP))
        short = np.fromiter(map(len, runs), np.int64, len(runs)) <= LONG
        root, times = np.full(len(runs), -1), np.bincount(which, minlength=len(runs))
        root[short] = self._rooted([runs[k] for k in np.flatnonzero(short).tolist()], times[short])
        node, short = root[which], short[which]
        in_tree, rare = np.flatnonzero(node >= 0), np.flatnonzero(short & (node < 0))
        node[in_tree] = self._nodes(node[in_tree], names[in_tree])
        packed, looked = self._work_off(
            [runs[k] for k in which[rare].tolist()], self.draws.bits(names[rare], range(WIDE // 8))
        )
        alone = np.r_[np.flatnonzero(~short), in_tree[self.looked[node[in_tree]] > WIDE], rare[looked > WIDE]]
        packed += [self._alone(runs[which[k]], self.draws.one(int(names[k])))[0] for k in alone.tolist()]
        node[np.r_[rare, alone]] = len(self.pieces_of) + np.arange(len(packed))
        found = list(map((self.pieces_of + packed).__getitem__, node.tolist()))
        return [b"".join(found[j - n : j]) for j, n in zip(ends.tolist(), sizes.tolist())]

    def encode(self, text: str, doc_id: int | None = 0) -> list[int]:
        return _ids(self.encode_all([text], [key_of(doc_id)])[0]).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode()


def encoded(docs: DataFrame, codec: Pieces, name: str = "pieces") -> DataFrame:
    """``docs`` with the ids of their texts' pieces."""
    name = free_name(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = codec.encode_all(texts, list(map(key_of, batch.column("doc_id").to_pylist())))
            ends = np.cumsum([0, *map(len, ids)]) // 4
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_ids(b"".join(ids))))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))])
    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, codec: Pieces, name: str = "pieces") -> DataFrame:
    """``rows`` with ``text`` restored from their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pieces = batch.column(name)
            ids, ends = pieces.values.to_numpy(), pieces.offsets.to_pylist()
            texts = pa.array([codec.decode(ids[i:j].tolist()) for i, j in zip(ends, ends[1:])], pa.string())
            columns = [texts if c == "text" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def recoded(docs: DataFrame, codec: Pieces, name: str = "pieces") -> DataFrame:
    """``docs`` encoded and with ``text`` as decoded from the pieces, in one pass of one worker."""
    name = free_name(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = codec.encode_all(texts, list(map(key_of, batch.column("doc_id").to_pylist())))
            ends = np.cumsum([0, *map(len, ids)]) // 4
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_ids(b"".join(ids))))
            back = pa.array([codec.decode(_ids(x).tolist()) for x in ids], pa.string())
            columns = [back if c == "text" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, found], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))])
    return docs.mapInArrow(run, schema)


_DIGEST = "n_pieces long, n_byte_pieces long, pieces_sha256 string, lossless boolean"


def round_trips(docs: DataFrame, codec: Pieces) -> DataFrame:
    """Per document the number and the digest (of 32-bit ids) of its pieces, and whether they decode to its text."""
    is_byte = np.zeros(len(codec.bytes_of), bool)
    is_byte[codec.byte_ids] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = list(map(key_of, batch.column("doc_id").to_pylist()))
            for text, packed in zip(texts, codec.encode_all(texts, keys)):
                ids = _ids(packed)
                digest = hashlib.sha256(packed).hexdigest()
                rows.append((len(ids), int(is_byte[ids].sum()), digest, codec.decode(ids.tolist()) == text))
            n, raw, digests, same = zip(*rows)
            columns = [pa.array(n, pa.int64()), pa.array(raw, pa.int64()), pa.array(digests), pa.array(same)]
            names = ["doc_id", "n_pieces", "n_byte_pieces", "pieces_sha256", "lossless"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_DIGEST}")
