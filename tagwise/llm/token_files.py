"""Token ids as flat binary files: unsigned integers without a header, beside 64-bit document offsets, memory-mapped.

Documents are put into ascending ``doc_id`` order by one range exchange; each sorted partition is encoded and streamed to
three files of its own: ``ids`` (little-endian unsigned integers, two bytes where the vocabulary allows, else four),
``docs`` (64-bit document ids) and ``offsets`` (64-bit places in ``ids`` where documents begin, and the end). The manifest
has one row per partition with the files' names and counts; a partition's base, the number of ids before it, is the
prefix sum of those counts. A document's place in the whole is its partition's base plus its offset.

A task writes under names of its own and reports them only when they are complete, so that the files of lost or repeated
attempts are never read: the manifest, which is written to the shared folder, is what counts.

A text is cut at blanks and before marks that follow a letter, where the tokenizer's own patterns cut too, and each
distinct part is encoded once and then remembered; the ids are those of the whole text.

Ids of documents are whole numbers. Rows with equal ids stay separate and follow each other by their text's hash; null
ids come first. A null text counts as empty and has the end id alone. An empty table gives an empty manifest and no rows.
Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tokenizers
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tagwise.llm.common import shared_folder, slices, stored

#: Fixed value of the contract: the id that ends each document.
END = 2
#: Parts of texts that a worker remembers in each of two generations, and the longest that it does.
KEPT, LONGEST = 1 << 18, 64
#: Parts of letters that are encoded in one string.
TOGETHER = 256
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z alone
_MARK = re.compile("[.,;:!?](?<=[a-zà-öø-ÿ].)")
#: Ids that are read in one step.
CHUNK = 1 << 20
MANIFEST = "part int, n_docs long, n_null long, n_tokens long, width int, ids string, docs string, offsets string"

#: The encoders of this process: a worker keeps what it remembers from task to task.
_LIVE: dict[str, dict] = {}


class Encoder:
    """Ids of whole texts by a tokenizer whose patterns never reach across blanks; it travels with the job."""

    def __init__(self, tokenizer_file: str, end: int = END) -> None:
        with open(tokenizer_file, encoding="utf-8") as file:
            self.spec = file.read()
        self.name = f"{xxhash.xxh3_64_hexdigest(self.spec)}:{end}"
        vocabulary = self._tokenizer().get_vocab(with_added_tokens=True)
        self.width = 2 if max(*vocabulary.values(), end) < 1 << 16 else 4
        self.end = np.array([end], f"<u{self.width}").tobytes()
        spec = json.loads(self.spec)
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends_word = np.array(sorted(i for x, i in vocabulary.items() if suffix and x.endswith(suffix)), np.int64)
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.lowers = "Lowercase" in json.dumps(spec["normalizer"])
        self._forget()

    def _forget(self) -> None:
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.model: tokenizers.Tokenizer | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"young": {"": b""}, "old": {}, "model": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = _LIVE.setdefault(state["name"], state)

    def _tokenizer(self) -> tokenizers.Tokenizer:
        return tokenizers.Tokenizer.from_str(self.spec)

    def _parts(self, text: str) -> list[str]:
        """Parts whose ids, joined, are the text's; a text with the string of an added token is one part."""
        low = text
        if self.lowers:
            low = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
        if any(x in low for x in self.added):
            return [text]
        return _MARK.sub(r" \g<0>", low).replace("\n", " ").replace("\t", " ").split(" ")

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _each(self, parts: list[str]) -> list[bytes]:
        return [self._packed(x.ids) for x in self.model.encode_batch_fast(parts, add_special_tokens=False)]

    def _ids(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of distinct parts. Many of letters go as one string, to be cut behind the tokens that end words."""
        if self.model is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
            self.model = self._tokenizer()
        plain = [p for p in parts if p.isalpha()] if len(self.ends_word) else []
        groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        found: dict[str, bytes] = {}
        for group, joined in zip(groups, self.model.encode_batch_fast(list(map(" ".join, groups)), add_special_tokens=False)):
            ids = np.array(joined.ids)
            cuts = (np.flatnonzero(np.isin(ids, self.ends_word)) + 1) * self.width
            if len(cuts) == len(group):  # else some part is of several words, and all are encoded below
                raw, ends = self._packed(joined.ids), cuts.tolist()
                found.update(zip(group, (raw[i:j] for i, j in zip([0, *ends], ends))))
        rest = [p for p in parts if p not in found]
        return found | dict(zip(rest, self._each(rest)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with the end id, packed."""
        split = list(map(self._parts, texts))
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {"": b""}
        new = set().union(*split).difference(self.young)
        again = new & self.old.keys()
        self.young.update({part: self.old[part] for part in again})
        found = self._ids(list(new - again))
        self.young.update(found)
        # itemgetter needs two keys for a tuple, and the empty part has no ids
        packed = [b"".join(itemgetter("", "", *parts)(self.young)) + self.end for parts in split]
        for part in found:
            if len(part) > LONGEST:
                del self.young[part]
        return packed


def _opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


def _writer(encoder: Encoder, folder: str):
    """Writes the files of one sorted partition and reports them in one row; an empty partition has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, at = _opened(folder)
        names = {x: f"{x}-{task.partitionId():06d}-{task.taskAttemptId()}.bin" for x in ("ids", "docs", "offsets")}
        files: dict[str, pa.NativeFile] = {}
        n_docs = n_null = n_tokens = 0
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            if not files:
                files = {x: store.open_output_stream(f"{at}/{name}") for x, name in names.items()}
                files["offsets"].write(np.zeros(1, "<u8").tobytes())
            packed = encoder.encode_all([t or "" for t in batch.column("text").to_pylist()])
            ends = n_tokens + np.cumsum([len(ids) // encoder.width for ids in packed])
            doc_ids = batch.column("doc_id")
            files["ids"].write(b"".join(packed))
            files["docs"].write(doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes())
            files["offsets"].write(ends.astype("<u8").tobytes())
            n_docs, n_null, n_tokens = n_docs + batch.num_rows, n_null + doc_ids.null_count, int(ends[-1])
        if files:
            for file in files.values():
                file.close()
            row = {"part": task.partitionId(), "n_docs": n_docs, "n_null": n_null, "n_tokens": n_tokens}
            row |= {"width": encoder.width} | names
            yield pa.RecordBatch.from_pylist([row], _MANIFEST)

    return run


_MANIFEST = pa.schema(
    [("part", pa.int32()), *((c, pa.int64()) for c in ("n_docs", "n_null", "n_tokens")), ("width", pa.int32())]
    + [(c, pa.string()) for c in ("ids", "docs", "offsets")]
)


def write_ids(docs: DataFrame, tokenizer_file: str, folder: str | None = None, end: int = END, parts: int | None = None) -> DataFrame:
    """Writes the files and returns their manifest: a row per partition, with ``folder`` and ``base``.

    ``folder`` is a new one below the session's shared folder unless given; local paths, and the file systems that Arrow
    opens, are understood. The manifest is kept there as Parquet, too. The number of ``parts`` is Spark's choice unless given.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-ids-{uuid.uuid4()}"
    store, at = _opened(folder)
    store.create_dir(at, recursive=True)
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("from")]
    rows = docs.select(*keys, "text")  # equal rows may be cut by where they come from, as their ids are equal
    ordered = rows.repartitionByRange(*([parts] if parts else []), "doc_id", "hash", "from").sortWithinPartitions("doc_id", "hash", "text")
    written = ordered.select("doc_id", "text").mapInArrow(_writer(Encoder(tokenizer_file, end), folder), MANIFEST)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one short row per partition
    manifest = stored(written).select(
        "*", F.lit(folder).alias("folder"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    )
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _mapped(store: pa.fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file's numbers: memory-mapped if the file system is local, else read."""
    if not store.get_file_info(path).size:
        return np.empty(0, kind)
    if isinstance(store, pa.fs.LocalFileSystem):
        return np.memmap(path, kind, mode="r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), kind)


class TokenFiles:
    """Random access to the files of a manifest's rows, for training loops."""

    def __init__(self, manifest: Iterable) -> None:
        self.rows = sorted(manifest, key=lambda r: r["part"])
        self.first_doc = np.cumsum([0, *(r["n_docs"] for r in self.rows)])
        self.base = np.array([*(r["base"] for r in self.rows), self.n_tokens])
        self._open: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @property
    def n_tokens(self) -> int:
        return sum(r["n_tokens"] for r in self.rows)

    def __len__(self) -> int:
        return int(self.first_doc[-1])

    def part(self, nth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, offsets and document ids of a partition."""
        if nth not in self._open:
            row = self.rows[nth]
            store, at = _opened(row["folder"])
            kinds = {"ids": f"<u{row['width']}", "offsets": "<u8", "docs": "<i8"}
            self._open[nth] = tuple(_mapped(store, f"{at}/{row[x]}", kind) for x, kind in kinds.items())
        return self._open[nth]

    def document(self, nth: int) -> tuple[int | None, int, np.ndarray]:
        """Document id, start and ids of the nth document of all."""
        if not 0 <= nth < len(self):
            raise IndexError(nth)
        k = int(np.searchsorted(self.first_doc, nth, "right")) - 1
        ids, offsets, docs = self.part(k)
        i = int(nth - self.first_doc[k])
        start, stop = int(offsets[i]), int(offsets[i + 1])
        doc_id = None if i < self.rows[k]["n_null"] else int(docs[i])
        return doc_id, int(self.base[k]) + start, ids[start:stop]

    def window(self, start: int, stop: int) -> np.ndarray:
        """The ids from one place of the whole to another, across documents and partitions."""
        first = int(np.searchsorted(self.base, start, "right")) - 1
        found = []
        for k in range(max(0, first), len(self.rows)):
            if self.base[k] >= stop:
                break
            found.append(self.part(k)[0][max(0, start - int(self.base[k])) : stop - int(self.base[k])])
        return np.concatenate(found) if found else np.empty(0, np.uint16)


def _read(manifest: DataFrame, columns, kind: str) -> DataFrame:
    """Rows of all documents, a file to a task; ``columns`` makes Arrow arrays of ids and their starts and stops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            ids, offsets, docs = TokenFiles([row]).part(0)
            places = offsets.astype(np.int64)
            stops = np.flatnonzero(np.diff(places[1:] // CHUNK, append=-1)) + 1  # about a chunk of ids in a batch
            for a, b in zip(np.r_[0, stops[:-1]].tolist(), stops.tolist()):
                starts, ends = places[a:b], places[a + 1 : b + 1]
                doc_id = pa.array(docs[a:b], pa.int64(), mask=np.arange(a, b) < row["n_null"])
                named = {"doc_id": doc_id, "start": pa.array(row["base"] + starts)} | columns(ids, starts, ends)
                yield pa.RecordBatch.from_arrays(list(named.values()), list(named))

    files = manifest.repartitionByRange(max(1, manifest.count()), "part")
    return files.mapInArrow(run, f"doc_id long, start long, {kind}")


def token_rows(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of each document, read from the files."""

    def columns(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
        values = pa.array(ids[starts[0] : ends[-1]].astype(np.int64))
        return {"ids": pa.ListArray.from_arrays(pa.array(np.r_[starts, ends[-1]] - starts[0], pa.int32()), values)}

    return _read(manifest, columns, "ids array<long>")


def token_digests(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read from the files."""

    def checksum(ids: np.ndarray, start: int, end: int) -> int:
        found = 0
        for at in range(start, end, CHUNK):
            found = zlib.crc32(ids[at : min(end, at + CHUNK)].astype("<u4").tobytes(), found)
        return found

    def columns(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
        sums = [checksum(ids, a, b) for a, b in zip(starts.tolist(), ends.tolist())]
        return {"n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(sums, pa.int64())}

    return _read(manifest, columns, "n_tokens long, ids_crc32 long")
