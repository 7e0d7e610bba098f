"""Mixing sources to target weights by hierarchical budgeting over a tree of domains, languages and sources.

A budget of tokens goes down the tree. At each node it is shared among the children by weight; a child that cannot use
its share, even with ``max_epochs`` passes over its documents, takes what it can, and its shortage goes to its siblings by
their weights. Only what all siblings together cannot take is a shortage of their parent, to be shared among the parent's
siblings: capacities are summed from the leaves up, so a parent never asks for more than its leaves can give.

A leaf's budget is a number of whole epochs over its documents and a rest. The rest is a prefix, by tokens, of the
documents in the order of a hash seeded with the next epoch. The cut is found without ordering a leaf: token sums of 64
key ranges locate the range of the cut, which is cut in 64 again until no leaf's range holds more than ``RANGE_ROWS``
documents, and only those are summed in order.

Tokens are words between ASCII blanks; null text has none. Null languages and sources count as the empty name. Documents
of one leaf with equal ids, and so with equal keys, are in or out together. Documents without tokens come with their
leaf's whole epochs, and a leaf without tokens gives none. Weights must be positive. An empty table gives an empty result. ``mixed`` keeps the
input's columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwise.llm.common import broadcast_if_small, hex_bits, stored, text_of, words

LEAF = ["domain", "lang", "source"]
DIGIT_BITS = 6
KEY_BITS = 60
RANGE_ROWS = 4096
#: Target weights; names that are not listed weigh 1.
WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {},
}
BUDGET_SHARE = 0.6
MAX_EPOCHS = 2
SEED = 3


def domain_of(source: Column) -> Column:
    """The documents have no domain; it is one of four by the source's checksum."""
    return F.concat(F.lit("domain"), (F.crc32(source) % 4).cast("string"))


def _leaf_columns() -> dict[str, Column]:
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    return {"domain": domain_of(source), "lang": lang, "source": source}


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    listed = weights.get(level, {})
    if not listed:
        return F.lit(1.0)
    each = F.create_map(*(F.lit(x) for name, w in sorted(listed.items()) for x in (name, float(w))))
    return F.coalesce(F.try_element_at(each, F.col(level)), F.lit(1.0))


def _shared(nodes: DataFrame, parents: list[str], weight: Column) -> DataFrame:
    """``nodes(capacity, given)`` with their ``budget``: ``given`` is the parent's, ``capacity`` their own limit.

    With all budgets at ``level x weight``, children whose capacity lies below theirs are full; they are the first ones by
    capacity over weight, and those for which the sum at their own level stays within the parent's budget.
    """
    ranked = nodes.withColumn("weight", weight).withColumn("ratio", F.col("capacity") / F.col("weight"))
    upto = Window.partitionBy(*parents).orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*parents)
    lighter = F.sum("weight").over(all_) - F.sum("weight").over(upto)
    at_own = F.sum("capacity").over(upto) + F.col("ratio") * lighter
    full = ranked.withColumn("full", at_own <= F.col("given"))
    left = F.col("given") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(all_)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(all_)
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.try_divide(left, open_) * F.col("weight")))
    return full.withColumn("budget", budget.cast("long")).drop("weight", "ratio", "full")


def budgets(
    leaves: DataFrame, weights: dict = WEIGHTS, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` with their ``budget`` in tokens."""
    given = None
    for depth, level in enumerate(LEAF):
        path, parents = LEAF[: depth + 1], LEAF[:depth] or [F.lit(0)]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("capacity"))
        if given is None:
            total = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("given", F.least(total, F.floor(total / max_epochs * share)))
        else:
            nodes = nodes.join(given, LEAF[:depth])
        given = _shared(nodes, parents, _weight(level, weights)).select(*path, F.col("budget").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), LEAF)


def _key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return hex_bits(F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(doc_id.cast("string"), F.lit("")))))


def cuts(rows: DataFrame, budget: DataFrame, seed: int) -> DataFrame:
    """Per leaf the number of whole epochs, and the greatest key of the next that is taken."""
    leaf = broadcast_if_small(
        stored(
            budget.where("tokens > 0").select(
                *LEAF, F.expr("cast(budget div tokens as int)").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest")
            )
        )
    )
    keyed = stored(
        rows.join(leaf, LEAF).select(*LEAF, "n_tokens", _key(F.col("epochs"), F.col("doc_id"), seed).alias("key"))
    )
    shift = KEY_BITS
    here = leaf.withColumns({"range": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    while shift > 0:
        inside = keyed.join(here, LEAF).where(F.shiftright("key", shift) == F.col("range"))
        shift -= DIGIT_BITS
        order = Window.partitionBy(*LEAF).orderBy("next")
        sums = (
            inside.groupBy(*LEAF, "epochs", "rest", "before", F.shiftright("key", shift).alias("next"))
            .agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
            .withColumn("upto", F.col("before") + F.sum("tokens").over(order))
        )  # at most 64 rows of a leaf
        found = F.min(F.struct("next", (F.col("upto") - F.col("tokens")).alias("before"), "rows")).alias("s")
        narrowed = stored(sums.where(F.col("upto") > F.col("rest")).groupBy(*LEAF, "epochs", "rest").agg(found))
        here = broadcast_if_small(
            narrowed.select(*LEAF, "epochs", "rest", F.col("s.next").alias("range"), F.col("s.before").alias("before"))
        )
        if (narrowed.agg(F.max("s.rows")).first()[0] or 0) <= RANGE_ROWS:
            break
    in_range = Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    taken = (
        keyed.join(here, LEAF).where(F.shiftright("key", shift) == F.col("range"))
        .groupBy(*LEAF, "epochs", "rest", "before", "range", "key").agg(F.sum("n_tokens").alias("n_tokens"))
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(in_range))
        .groupBy(*LEAF, "epochs", "range").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("last"))
    )
    under = F.shiftleft(F.col("range"), shift) - 1
    return taken.select(*LEAF, "epochs", F.coalesce("last", under).alias("last"))


def measured(docs: DataFrame) -> DataFrame:
    return docs.withColumns(_leaf_columns()).select("doc_id", *LEAF, F.size(words(text_of("text"))).cast("long").alias("n_tokens"))


def _cuts_of(rows: DataFrame, weights: dict, share: float, max_epochs: int, seed: int) -> DataFrame:
    leaves = stored(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")))
    return broadcast_if_small(stored(cuts(rows, budgets(leaves, weights, share, max_epochs), seed)))


def _epochs(doc_id: Column, seed: int) -> Column:
    """The epochs that a document is taken in."""
    whole = F.filter(F.sequence(F.lit(0), F.col("epochs")), lambda e: e < F.col("epochs"))
    more = F.when(_key(F.col("epochs"), doc_id, seed) <= F.col("last"), F.array("epochs"))
    return F.concat(whole, F.coalesce(more, F.array().cast("array<int>")))


def mixture(
    docs: DataFrame, weights: dict = WEIGHTS, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, epoch``: a row for each time that a document is taken."""
    rows = stored(measured(docs))
    chosen = rows.join(_cuts_of(rows, weights, share, max_epochs, seed), LEAF)
    return chosen.select("doc_id", *LEAF, "n_tokens", F.explode(_epochs(F.col("doc_id"), seed)).alias("epoch"))


def mixed(
    docs: DataFrame, weights: dict = WEIGHTS, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """The documents as they are, each as often as the mixture takes it."""
    rows = stored(measured(docs))
    limits = _cuts_of(rows, weights, share, max_epochs, seed)
    whole = docs.select(F.struct("*").alias("row"), "doc_id", *(c.alias(n) for n, c in _leaf_columns().items()))
    taken = whole.join(limits, LEAF).select("row", F.explode(_epochs(F.col("doc_id"), seed)))
    return taken.select("row.*")
