"""Depths of calls against plain walks, long chains, and numbers within crowded conversations."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tagwise.llm import chat_format

SCHEMA = "conv_id long, call_id string, occurrence long, turn long, after array<string>"


def plain_depths(rows):
    """Depth and latest turn by walking up from every call; calls that walk into a cycle have none."""
    turn = {r[:3]: r[3] for r in rows}
    n = {}
    for conv, call, k, *_ in rows:
        n[conv, call] = max(n.get((conv, call), 0), k)
    before = {}
    for conv, call, k, _, after in rows:
        names = [x for x in dict.fromkeys(after or []) if (conv, x) in n]
        before[conv, call, k] = [(conv, x, k - 1 if x == call and k > 1 else min(k, n[conv, x])) for x in names]
    known = {}

    def walk(v, path):
        if v in path:
            return None
        if v not in known:
            ups = [walk(u, path | {v}) for u in before[v]]
            known[v] = None if None in ups else (max([d + 1 for d, _ in ups], default=0), max([turn[v], *(t for _, t in ups)]))
        return known[v]

    out = {}
    for v in before:
        known.clear()  # what a walk learns behind a cycle holds for that walk only
        out[v] = walk(v, frozenset())
    return {(*v, *x) for v, x in out.items() if x is not None}


def found(spark, rows):
    return {tuple(r) for r in chat_format.depths(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_depths_are_those_of_plain_walks(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(30):
        size, names = rng.randrange(1, 12), {}
        ids = [f"c{rng.randrange(size)}" if rng.random() < 0.2 else f"c{i}" for i in range(size)]
        for i, call in enumerate(ids):
            names[call] = names.get(call, 0) + 1
            lone = rng.random() < 0.6
            after = [rng.choice(ids[:i] or ids)] if lone else rng.choices([*ids, "gone"], k=rng.randrange(0, 3))
            rows.append((conv, call, names[call], rng.randrange(20), after if rng.random() < 0.9 else None))
    assert found(spark, rows) == plain_depths(rows)


def test_a_chain_of_a_thousand_calls(spark):
    rows = [(1, f"c{i}", 1, (i * 37) % 1000, [f"c{i - 1}"] if i else []) for i in range(1000)]
    rows += [(1, f"b{i}", 1, 5, ["c500", f"c{i}"]) for i in range(20)]  # branches off the chain
    rows += [(2, f"c{i}", 1, i, [f"c{(i + 1) % 1000}"]) for i in range(1000)]  # a cycle as long
    rows += [(2, "behind", 1, 0, ["c7"]), (2, "alone", 1, 0, [])]
    start = time.perf_counter()
    depths = {r[:2]: r[3:] for r in found(spark, rows)}
    assert time.perf_counter() - start < 60
    assert len(depths) == 1000 + 20 + 1
    latest = 0
    for i in range(1000):
        latest = max(latest, (i * 37) % 1000)
        assert depths[1, f"c{i}"] == (i, latest)
    assert depths[1, "b3"][0] == 501 and depths[2, "alone"] == (0, 0)


def test_crowded_turns_are_numbered_by_cells(spark):
    rng = random.Random(1)
    rows = [(None, None, f"m{rng.randrange(900)}") for _ in range(3000)] + [(1, 5, f"m{i}") for i in range(3000)]
    rows += [(1, None, "late"), (1, 4000, "later"), (2, 0, "one")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, json string").select(
        "conv_id", "turn", F.col("turn").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("long").alias("occurrence"), F.lit(None).cast("int").alias("depth"), "json",
    )
    numbered = chat_format._numbered(df).collect()
    for conv in (None, 1, 2):
        own = [r for r in numbered if r.conv_id == conv]
        assert sorted(r.position for r in own) == list(range(sum(x[0] == conv for x in rows)))
        key = lambda r: (r.turn is None, r.turn or 0, hashlib.md5(r.json.encode()).hexdigest())
        ordered = [key(r) for r in sorted(own, key=lambda r: r.position)]
        assert [k[1:] for k in ordered if not k[0]] == sorted(k[1:] for k in ordered if not k[0])
        assert [k[2] for k in ordered if k[0]] == sorted(k[2] for k in ordered if k[0])
