"""Token files against encoding each text at once, and their format."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tagwise.llm import token_files
from tagwise.llm.common import table
from tagwise.llm.queries import queries
from tagwise.llm.vocabularies import WORDS as TOKENIZER

MODEL = tokenizers.Tokenizer.from_file(TOKENIZER)
TEXTS = [
    "", None, " ", "\n\t", "Plain words, twice: plain words!", "it's we'll they'VE 's 't", "a b c　d ́x é",
    "<|endoftext|>x<|startoftext|> <|endoftext|>", "ΣΑΣ ΣΑΣ. İstanbul ẞ", "12345 3.14 ½ ⅷ", "\x85a\x1cb\x0bc\x0cd\re", "日本語 テスト",
    "x" * 5000, "🙂🙂 " * 40, "tab\tnew\nline  double   blank ", "가 ᆨ", "repeated text", "repeated text",
]
TRICKY = [
    'say "no". (yes), he said,"well"...it\'s;they\'ll:', "A.B.C. e.g.,i.e.?!", "<|STARTOFTEXT|> Upper", "ÀÉÎ.ÕÜ,é;ß:ÿ! É́.",
    "ªº.ⅷ,½;x²", "aİ.b", "<|endoftext|>", "a<|endoftext|>b.c",
]


def ids_of(text):
    return MODEL.encode(text or "", add_special_tokens=False).ids + [token_files.END]


def test_parts_have_the_ids_of_the_whole():
    encoder = token_files.Encoder(TOKENIZER)
    assert encoder.width == 2
    for texts in (TEXTS, TEXTS[::-1], TRICKY, TRICKY + TEXTS):
        found = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_all([t or "" for t in texts])]
        assert found == [ids_of(t) for t in texts]


def test_wide_vocabulary_takes_four_bytes():
    assert token_files.Encoder(TOKENIZER, end=1 << 16).width == 4
    assert token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json")).width == 2


def test_query_against_plain_encoding(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    start, expected = 0, []
    for doc_id, text in docs:
        ids = ids_of(text)
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = queries()["op12_token_files"](spark, sf_dir)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [tuple(r) for r in sorted(found.collect())] == expected


@pytest.fixture(scope="module")
def odd(spark):
    ids = [5, 3, None, 9, 5, -2, 5, None, 7, 7, 1 << 40, 0, 11, 12, None, 13, 20, 20]
    rows = spark.createDataFrame(
        [(i, t, "x", 1, "c") for i, t in zip(ids, TEXTS)], "doc_id long, text string, ids string, start int, base string"
    )
    return list(zip(ids, TEXTS)), token_files.write_ids(rows.repartition(5), TOKENIZER, parts=4)


def test_nulls_repeats_and_clashing_columns(odd):
    rows, manifest = odd
    found = token_files.token_rows(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in found) == sorted((str(i), ids_of(t)) for i, t in rows)
    lengths = [len(r["ids"]) for r in found]
    assert [r["start"] for r in found] == [0, *itertools.accumulate(lengths)][:-1]


def test_random_access(odd):
    rows, manifest = odd
    files = token_files.TokenFiles(manifest.collect())
    found = token_files.token_rows(manifest).orderBy("start").collect()
    assert len(files) == len(rows) and files.n_tokens == sum(len(ids_of(t)) for _, t in rows)
    for nth, row in enumerate(found):
        doc_id, start, ids = files.document(nth)
        assert (doc_id, start, ids.tolist()) == (row["doc_id"], row["start"], row["ids"])
    stream = [x for r in found for x in r["ids"]]
    for a, b in ((0, len(stream)), (3, 40), (len(stream) - 5, len(stream) + 9), (7, 7)):
        assert files.window(a, b).tolist() == stream[a:b]
    with pytest.raises(IndexError):
        files.document(len(rows))
    assert isinstance(files.part(0)[0], np.memmap) and files.part(0)[1].dtype == np.dtype("<u8")


def test_bases_are_prefix_sums(odd):
    _, manifest = odd
    parts = sorted(manifest.collect(), key=lambda r: r["part"])
    assert len(parts) > 1
    assert [r["base"] for r in parts] == [0, *itertools.accumulate(r["n_tokens"] for r in parts)][:-1]


def test_empty_table(spark):
    manifest = token_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER)
    assert manifest.isEmpty() and token_files.token_digests(manifest).isEmpty()
    assert len(token_files.TokenFiles(manifest.collect())) == 0


def test_equal_rows_are_spread(spark):
    docs = spark.range(4000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    parts = token_files.write_ids(docs, TOKENIZER, parts=8).collect()
    assert len(parts) > 4 and sum(r["n_docs"] for r in parts) == sum(r["n_null"] for r in parts) == 4000
