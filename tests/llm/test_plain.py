"""The operators against plain versions of what they compute."""

import hashlib
import itertools
import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tagwise.llm import (
    digests, gam, mixing, quality_classifier, secrets, sentencepiece_bpe, sharding, simhash, toxicity, trigrams, vocabularies,
)
from tagwise.llm.common import table
from tagwise.llm.deobfuscate import CharModel, decode, grams, restored
from tests.llm.frames import documents, prose


def plain_fingerprint(text: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), text.encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(codes: list[int], distance: int) -> dict[int, int]:
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(codes):
        for y in codes[:i]:
            if (x ^ y).bit_count() <= distance:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {c: find(c) for c in codes}


def test_fingerprints(spark):
    texts = ["", "One", "one two three", "A b  C\nd E", "É é A", prose(1, 300), " x y z w v"]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def clouds(seed: int) -> list[int]:
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(40)]
    near = [c ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for c in centres for _ in range(rng.randrange(30))]
    return sorted({0, (1 << 64) - 1, *centres, *near})


@pytest.mark.parametrize("cell", [7, 64, 4096])
def test_links_connect_what_brute_force_connects(spark, cell):
    codes = clouds(cell)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), cell=cell).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    assert all((unsigned(e.a) ^ unsigned(e.b)) != 0 for e in edges)
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = sorted((find(unsigned(e.a)), find(unsigned(e.b))))
        parent[b] = a
    assert {c: find(c) for c in codes} == plain_components(codes, 4)


def test_near_duplicates_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id < 300")
    rows = {r.doc_id: plain_fingerprint(r.text or "") for r in docs.collect()}
    roots = plain_components(sorted(set(rows.values())), 4)
    least = defaultdict(lambda: 1 << 60)
    for doc_id, code in rows.items():
        least[roots[code]] = min(least[roots[code]], doc_id)
    found = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {
        (i, f"{c:016x}", least[roots[c]]) for i, c in rows.items()
    }


def test_components_of_a_long_chain_and_a_star(spark):
    from tagwise.llm.components import components

    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 500) for i in range(1, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 500 for i in range(1, 300)}}


def test_additive_model_learns_single_and_joint_effects():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = gam.fit(x[:3000], y[:3000], n_pairs=4, pair_rounds=80)
    assert (2, 1) in model.pairs
    plain = gam.fit(x[:3000], y[:3000], n_pairs=0)
    right = lambda m: ((m.score(x[3000:]) > 0.5) == y[3000:]).mean()
    assert right(model) > right(plain) + 0.1
    # a score is a sum of table entries
    total = np.full(5, model.intercept)
    for f in range(5):
        total += model.tables[f][np.searchsorted(model.edges[f], x[:5, f], side="right")]
    for (i, j), t in zip(model.pairs, model.pair_tables):
        total += t[np.searchsorted(model.coarse[i], x[:5, i], side="right"), np.searchsorted(model.coarse[j], x[:5, j], side="right")]
    assert np.allclose(model.score(x[:5]), 1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(kind, spark, sf_dir):
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = (quality_classifier.quality_scores if kind == "quality" else toxicity.toxicity_scores)(docs, known)
    rows = scores.join(known, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == r[kind] for r in rows) >= 0.9 * len(rows)


def test_restored_words():
    words = ["idiot", "stupid", "loser", "the", "thing", "worthless", "moron", "clown", "under", "weather"] * 5
    model = CharModel(grams(words))
    for token, meant in (
        ("1d10t", "idiot"), ("$tup1d", "stupid"), ("l0ser", "loser"), ("mooorrron", "moron"), ("c-l-o-w-n", "clown"),
        ("st*pid", "stupid"), ("the", "the"), ("weather", "weather"), ("(thing)", "thing"),
    ):
        assert restored(token, model)[0] == meant, token
    assert decode("w o r t h l e s s", model) == ["worthless"]
    assert restored("2024", model) == [] and restored("!!!", model) == []
    assert len(decode("a " * 20_000, model)) > 0


def test_obfuscated_words_raise_the_score(spark, sf_dir):
    scorer = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    clean = prose(1, 200)
    marked = [n for n in scorer.read.names if n.isascii() and n.isalpha() and len(n) > 4 and "i" in n and "o" in n]
    assert marked
    for word in marked[:3]:
        hidden = word.replace("i", "1").replace("o", "0")
        assert scorer(f"{clean} {hidden}") > scorer(clean)
        assert scorer(f"{clean} {' '.join(word)} x") > scorer(clean)


def test_splitters_are_exact_and_shards_even(spark):
    rng = random.Random(5)
    rows = [(i, "copy" * 50 if i % 3 == 0 else "x" * rng.randrange(400) + str(i), "en", "a") for i in range(3000)]
    found = sharding.shard_by_bytes(documents(spark, rows, clashes=False)).collect()
    assert len(found) == 3000 and sum(r.size for r in found) == sum(len(r[1]) + 8 for r in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in found:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode())
    assert sorted(sizes) == list(range(24)) and max(sizes.values()) - min(sizes.values()) <= 2 * 420
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loose = sharding.splitters(sharding.keyed(documents(spark, rows, clashes=False)), 24, tolerance=0.05)
    assert len(loose) == 23 and loose == sorted(loose)


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("d1", "en", "a", 100), ("d1", "en", "b", 1000), ("d1", "de", "c", 1000), ("d2", "en", "d", 100), ("d2", "de", "e", 100)],
        "domain string, lang string, source string, tokens long",
    )
    weights = {"domain": {}, "lang": {}, "source": {}}
    found = {r.source: r.budget for r in mixing.budgets(leaves, weights, share=0.5, max_epochs=1).collect()}
    # 1150 tokens: d2 can only take 200 of its 575; the rest goes to d1, where a is full and b takes over
    assert found == {"a": 100, "b": 375, "c": 475, "d": 100, "e": 100}


def test_prefix_of_the_epoch_is_cut_at_the_rest(spark):
    rows = [(i, "w " * (i % 9), "en", "s") for i in range(500)]
    chosen = mixing.mixture(documents(spark, rows, clashes=False), share=0.3, max_epochs=3).collect()
    tokens = sum(i % 9 for i in range(500))
    assert {r.epoch for r in chosen} == {0} and len({r.doc_id for r in chosen}) == len(chosen)
    assert 0.3 * tokens - 9 <= sum(r.n_tokens for r in chosen) <= 0.3 * tokens


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=vocabularies.PIECES)


TEXTS = ["", "a", "  two  spaces \n\n tabs\t x ", "日本語 ß 😀 €", "    indented", "x   ", "Hello, world. It's 2024!", "²." * 5, "ab" * 200]


def pieces(**parameters):
    return sentencepiece_bpe.Pieces(vocabularies.PIECES, **parameters)


def test_pieces_without_dropout_are_the_library_s(model):
    codec = pieces(dropout=0)
    for text in [*TEXTS, prose(1, 500)]:
        assert codec.encode(text) == model.encode(text)


def test_dropout_varies_and_stays_lossless(model):
    codec = pieces(dropout=0.3)
    texts = [*TEXTS, "▁lit▁ x\x00▁", "\x00\x00", prose(2, 500)]
    seen = {v: [codec.encode(t, v) for t in texts] for v in range(9)}
    for found in seen.values():
        assert [codec.decode(x) for x in found] == texts
    assert len({tuple(f[-1]) for f in seen.values()}) == 9
    assert all(len(f[-1]) > len(model.encode(texts[-1])) for f in seen.values())
    again = pieces(dropout=0.3)
    assert [again.encode(t, 1) for t in texts] == seen[1]
    other = pieces(dropout=0.3, seed=9)
    assert other.encode(texts[-1], 1) != seen[1][-1]


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 2**64 - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 2**64 - 1
    return x ^ x >> 31


def plain_dropout(model, runs, doc_id, seed, limit):
    """Pieces of runs: in each the best pair is looked for again and again among those not skipped before."""
    golden, found = 0x9E3779B97F4A7C15, []
    key = plain_mix(xxhash.xxh64_intdigest(str(doc_id)) + seed & 2**64 - 1)
    for place, run in enumerate(runs):
        name = plain_mix(key + place * golden & 2**64 - 1)
        symbols = [[i, c] for i, c in enumerate(run.replace(" ", "▁"))]
        out, n = set(), 0
        while True:
            best = None
            for (i, a), (j, b) in zip(symbols, symbols[1:]):
                number = model.piece_to_id(a + b)
                if number and (i, j, a + b) not in out and (best is None or model.get_score(number) > best[0]):
                    best = model.get_score(number), i, j, a + b
            if best is None:
                break
            word = plain_mix(name + (n // 8 + 1) * golden & 2**64 - 1)
            if word >> 8 * (n % 8) & 255 < limit:
                out.add(best[1:])
            else:
                at = next(k for k, (i, _) in enumerate(symbols) if i == best[1])
                symbols[at : at + 2] = [[best[1], best[3]]]
            n += 1
        for _, s in symbols:
            number = model.piece_to_id(s)
            found += [number] if number else [model.piece_to_id(f"<0x{b:02X}>") for b in s.encode()]
    return found


def test_dropout_is_the_plain_one_for_every_occurrence(model):
    rng = random.Random(3)
    words = ["".join(rng.choice("theinorsdaé日") for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    words += ["".join(rng.choice("theinors") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    codec = pieces(dropout=0.2, seed=5)
    for doc_id in range(4):
        text = " ".join(rng.choices(words, k=300))
        runs = codec.runs.findall(" " + text)
        assert codec.encode(text, doc_id) == plain_dropout(model, runs, doc_id, 5, round(0.2 * 256))


def test_documents_and_occurrences_are_segmented_for_themselves():
    codec = pieces(dropout=0.3)
    word = "internationalisation"
    alone = {tuple(codec.encode(word, i)) for i in range(200)}
    assert len(alone) > 20
    ids, cut = codec.encode(" ".join([word] * 200), 1), set()
    at = 0
    for _ in range(200):
        part, size = [], 0
        while size < len(word) + 1:
            part.append(ids[at])
            size, at = size + len(codec.bytes_of[ids[at]]), at + 1
        cut.add(tuple(part))
    assert len(cut) > 20


def test_runs_are_worked_off_together_as_one_by_one():
    codec, rng = pieces(dropout=0.2), random.Random(3)
    runs = ["".join(rng.choice(" theinorsdaé日") for _ in range(rng.randrange(1, 48))) for _ in range(400)]
    skips = [rng.getrandbits(64) & rng.getrandbits(64) for _ in runs]
    for run, bits, found, looked in zip(runs, skips, *codec._work_off(runs, np.array(skips, np.uint64))):
        alone, n = codec._segment(codec._symbols(run), lambda k: k < 64 and bits >> k & 1)
        ids = [i for x in alone for i in ([codec.ids[x]] if x in codec.ids else codec._bytes(x))]
        assert (np.frombuffer(found, np.int32).tolist(), looked) == (ids, n), run


def test_a_worker_keeps_its_trees_from_task_to_task(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "_LIVE", {})
    sent = pickle.dumps(pieces())
    first = pickle.loads(sent)
    first.encode_all([prose(1, 200)] * 3, [1, 2, 3])
    grown = len(first.pieces_of)
    assert grown and len(pickle.loads(sent).pieces_of) == grown


def test_trees_that_are_forgotten_give_the_same(monkeypatch):
    texts = [prose(i, 200) for i in range(20)]
    expected = [pieces().encode(t, i) for i, t in enumerate(texts)]
    monkeypatch.setattr(sentencepiece_bpe, "KEPT_BYTES", 0)
    codec = pieces()
    assert [codec.encode(t, i) for i, t in enumerate(texts)] == expected


def test_digests():
    texts = [b"", b"ab", b"abc", prose(1, 400).encode(), prose(2, 400).encode(), b"x" * (digests.CHUNK + 5)]
    for x in texts:
        assert digests.likeness(digests.digest(x), digests.digest(x)) == 1
        for y in texts:
            d = digests.difference(digests.digest(x), digests.digest(y))
            assert 0 <= d <= digests.WORST and d == digests.difference(digests.digest(y), digests.digest(x))
    whole = prose(3, 600)
    near, far = whole.replace("the", "teh", 3), " ".join(f"{i * i:x}" for i in range(500))
    a, b, c = (digests.digest(t.encode()) for t in (whole, near, far))
    assert digests.likeness(a, b) > 0.9 > digests.likeness(a, c)


def test_edited_copies(spark):
    rows = [(i, prose(i, i % 13 * 5) + "é" * (i % 4), "en", "a") for i in range(0, 300, 3)] + [(None, "last", "en", "a")]
    found = digests.fingerprints(documents(spark, rows, clashes=False)).collect()
    order = sorted(rows[:-1], reverse=True) + rows[-1:]
    for k, (doc_id, text, *_) in enumerate(order):
        half, after = len(text) // 2, order[(k + 1) % len(order)][1]
        edited = text[: len(text) - half] + after[:half]
        row = next(r for r in found if r.doc_id == doc_id)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and row.n_chars == len(text)
        assert row.fingerprint == digests.digest(text.encode()).hex()
        assert row.near_next == digests.likeness(digests.digest(text.encode()), digests.digest(after.encode()))


def test_trigram_queries_never_miss_a_match(spark):
    assert trigrams.query_of("[0-9a-f]{24,}") == [] and trigrams.query_of("ab|cd") == []
    samples = {
        "assign": ["PassWord: abcdef", "api_key='abcdef'", "TOKEN=abcdef"], "access": ["AKIA" + "Z" * 16],
        "private_key": ["-----BEGIN RSA PRIVATE KEY-----"], "hosting_token": ["ghp_" + "a" * 36], "chat_token": ["xoxb-" + "1" * 10],
        "cloud_key": ["AIza" + "b" * 35], "payment_key": ["sk_live_" + "c" * 16, "rk_live_" + "c" * 16],
        "signed_token": [".".join(["eyJ" + "d" * 8, "eyJ" + "e" * 8, "f" * 8])], "url_login": ["https://me:pw@host"], "hex": ["0a" * 12],
    }
    rows = []
    for rule in secrets.RULES:
        for text in samples[rule.kind]:
            assert re.search(rule.pattern, text), rule.kind
            have = trigrams.trigrams(text.lower())
            assert all(any(a <= have for a in run) for run in trigrams.query_of(rule.pattern)), rule.kind
            rows.append((len(rows), f"é {text} .", "en", "a"))
    found = secrets.secret_spans(documents(spark, rows, clashes=False)).collect()
    kinds = {rows[r.doc_id][1][2:-2]: {s.split(":")[0] for s in r.spans.split(",")} for r in found}
    assert all(rule.kind in kinds[t] for rule in secrets.RULES for t in samples[rule.kind])


def test_assignments_that_fail_use_up_their_text(spark):
    rows = [(1, "password: token: abcdef token=abc; secret = \"abcdefg\"", "en", "a")]
    row = secrets.secret_spans(documents(spark, rows, clashes=False)).first()
    found = [m for m in re.finditer(secrets.RULES[0].pattern, rows[0][1]) if len(m[2]) >= 6]
    assert [m[0] for m in found] == ['secret = "abcdefg']
    assert (row.n_assign, row.spans) == (1, ",".join(f"assign:{m.start()}:{m.end()}" for m in found))


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id < 400")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        if name == "simhash near-dedup":
            roots = simhash.near_duplicates(before).select("component_id").distinct().count()
            assert counts[-1] == roots
        if name == "secret scan":
            spans = secrets.secret_spans(docs)
            assert spans.filter("n_access + n_hex + n_assign > 0").count() == 0
        if name == "mixing":
            kept = mixing.mixture(before, share=corpus_pipeline.KEPT_SHARE, max_epochs=1)
            assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sentencepiece":
            assert docs.columns == columns
        else:
            assert docs.join(before.select("doc_id", F.col("text").alias("t")), "doc_id").filter("text <> t").count() == 0
            assert docs.filter("size(pieces) = 0 and text <> ''").count() == 0
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] == counts[5] > 0


def test_training_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    from tagwise.llm.learning import training_sample

    docs = documents(spark, [(i, f"t{i}", "en", "a") for i in range(4000)], clashes=False)
    known = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    drawn = training_sample(docs, known, "quality", 500, 1).collect()
    assert len(drawn) == 500 and all(zlib.crc32(r.text[1:].encode()) % 4 != 2 for r in drawn)
    assert sorted(drawn) == sorted(training_sample(docs, known, "quality", 500, 1).collect())
    everything = training_sample(docs, known, "quality", 10_000, 1).count()
    assert everything == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(4000))


@pytest.mark.parametrize("most", [1, 30, 10**9])
def test_cut_of_a_hot_leaf_is_found_in_small_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "RANGE_ROWS", most)
    rows = [(i // 2 if i % 5 else None, "w " * (i % 7), "en", "hot" if i % 3 else "cold") for i in range(3000)]
    chosen = mixing.mixture(documents(spark, rows, clashes=False), share=0.37, max_epochs=1).collect()
    keys = defaultdict(list)
    for doc_id, text, _, source in rows:
        digest = hashlib.md5(f"{mixing.SEED}:0:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:15]
        keys[source].append((digest, len(text.split())))
    for source, own in keys.items():
        total = Counter()
        for key, n in own:
            total[key] += n
        prefixes = list(itertools.accumulate(total[key] for key in sorted(total)))
        assert sum(r.n_tokens for r in chosen if r.source == source) in [0, *prefixes]
    tokens = sum(n for own in keys.values() for _, n in own)
    assert 0.37 * tokens - 2 * 400 * 7 <= sum(r.n_tokens for r in chosen) <= 0.37 * tokens


def plain_digest(text):
    """The document digest by loops over triplets, buckets and quartiles."""
    counts = [0] * 1024
    for a, b, c in zip(text, text[1:], text[2:]):
        counts[((a * 65536 + b * 256 + c) * 2654435769 % 2**32) // 2**22] += 1
    low, middle, high = (sorted(counts)[i] for i in (255, 511, 767))
    codes = [sum(n > q for q in (low, middle, high)) for n in counts]
    ratios = (16 * low // high % 16) * 16 + 16 * middle // high % 16 if high else 0
    head = [zlib.crc32(text) % 256, min(255, round(8 * math.log2(len(text) + 1))), ratios]
    return bytes(head + [64 * a + 16 * b + 4 * c + d for a, b, c, d in zip(*(codes[i::4] for i in range(4)))])


def plain_difference(x, y):
    steps = {0: 0, 1: 1, 2: 2, 3: 6}
    total = (x[0] != y[0]) + 12 * min(12, abs(x[1] - y[1]))
    for shift in (4, 0):
        apart = abs((x[2] >> shift) % 16 - (y[2] >> shift) % 16)
        total += 12 * min(7, apart, 16 - apart)
    for a, b in zip(x[3:], y[3:]):
        total += sum(steps[abs((a >> k) % 4 - (b >> k) % 4)] for k in (6, 4, 2, 0))
    return total if x != y else 0


def test_digests_are_those_of_plain_loops():
    rng = random.Random(9)
    texts = [b"", b"a", b"ab", b"abc", b"aaa" * 50, rng.randbytes(5000), prose(3, 900).encode(), "\u65e5\u672c\u8a9e ".encode() * 300]
    texts += [prose(3, 900).encode()[:-9], prose(3, 899).encode() + b"other words"]
    found = [digests.digest(t) for t in texts]
    assert found == [plain_digest(t) for t in texts]
    for x in found:
        for y in found:
            assert digests.difference(x, y) == plain_difference(x, y) == digests.difference(y, x) <= digests.WORST


def plain_boosting(x, y, rounds, rate, depth, ridge, bins):
    """Tables of cyclic boosting, each tree by trying every cut of every part of its rows."""
    n, width = len(x), len(x[0])
    edges = [sorted({float(np.quantile([r[f] for r in x], k / bins)) for k in range(1, bins)}) for f in range(width)]
    of = [[sum(r[f] >= e for e in edges[f]) for f in range(width)] for r in x]
    share = (sum(y) + 1) / (n + 2)
    total = [math.log(share / (1 - share))] * n
    tables = [[0.0] * (len(e) + 1) for e in edges]

    def tree(g, h, f, first, last, levels):
        """Values of the bins from first to last."""
        inside = [i for i in range(n) if first <= of[i][f] <= last]
        sums = lambda rows: (sum(g[i] for i in rows), sum(h[i] for i in rows))
        worth = lambda rows: sums(rows)[0] ** 2 / (sums(rows)[1] + ridge)
        best = (1e-9, None)
        for cut in range(first + 1, last + 1) if levels else ():
            left, right = [i for i in inside if of[i][f] < cut], [i for i in inside if of[i][f] >= cut]
            gain = worth(left) + worth(right) - worth(inside)
            if gain > best[0] + 1e-12:
                best = (gain, cut)
        if best[1] is None:
            return [-sums(inside)[0] / (sums(inside)[1] + ridge)] * (last - first + 1)
        return tree(g, h, f, first, best[1] - 1, levels - 1) + tree(g, h, f, best[1], last, levels - 1)

    for _ in range(rounds):
        for f in range(width):
            p = [1 / (1 + math.exp(-t)) for t in total]
            step = tree([a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], f, 0, len(edges[f]), depth)
            tables[f] = [a + rate * b for a, b in zip(tables[f], step)]
            total = [t + rate * step[of[i][f]] for i, t in enumerate(total)]
    return tables


def test_boosted_tables_are_those_of_exhaustive_splits():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (120, 3))
    y = ((x[:, 0] > 0.2) | (x[:, 1] < -0.6)).astype(float)
    model = gam.fit(x, y, rounds=3, n_pairs=0)
    for found, expected in zip(model.tables, plain_boosting(x.tolist(), y.tolist(), 3, 0.15, 2, 5.0, gam.BINS)):
        assert np.allclose(found, expected)
