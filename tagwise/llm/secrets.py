"""Secret scans: a trigram inverted index picks the documents that a rule can match, regular expressions verify them.

Each rule's expression gives a Boolean query over lower-case trigrams. The index holds a posting (trigram, document) for
every trigram that any rule asks for. Postings meet the rules' queries, a bounded table, are intersected per document
with bit masks, and leave candidates (document, rules). Texts join their candidate rules by id and hash and are verified
there; a rule without mandatory trigrams is verified on every text. Verification alone decides, so the index only saves work.

Null text counts as empty; null and repeated ids are safe, as rows of one id share candidates and are verified each;
documents without a secret have counts of 0 and empty spans; an empty table gives an empty result. ``redacted`` keeps all
columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tagwise.llm.common import broadcast_if_small, let, stored, text_of
from tagwise.llm.learning import free_name
from tagwise.llm.trigrams import query_of


@dataclass(frozen=True)
class Rule:
    """``group``, if given, must have ``least`` characters, else the whole match must."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: What follows a private key's first line: all up to its last line; where that is missing the headers, the base64 and what
#: may be its shorter last line, each of any number. Repeats are possessive (``*+``), so that Java's matcher loops where it
#: would take a stack frame for each; nothing that follows them can begin within them, so they match as greedy ones do.
KEY_BODY = (
    r"(?:[A-Za-z0-9+/=:,.\\\x20\x09-\x0D]*+(?:-[A-Za-z0-9+/=:,.\\\x20\x09-\x0D]++)*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:[\\\x20\x09-\x0D]*+[A-Z][A-Za-z]*+-[A-Z][A-Za-z]*+: [^\x0A\x0D]*+)*+"
    r"(?:[\\\x20\x09-\x0D]*+[A-Za-z0-9+/=]{20,}+(?:[\x20\x09]++[A-Za-z0-9+/=]{20,}+)*+(?:[\x20\x09]++[A-Za-z0-9+/]++={1,2})?+"
    r"(?:[\x20\x09]*+[\\\x0A\x0D]++[\x20\x09]++[A-Za-z0-9+/=]++)*+[A-Za-z0-9+/=\\\x0A\x0D]*+)?)"
)
#: The first three are fixed by the contract, the others added; spans list them in this order.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + KEY_BODY),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]*:[^\x20\x09-\x0D/@]+@"),
)
BASE = ("assign", "access", "hex")
PLACEHOLDER = "[SECRET]"
#: Candidates (three numbers each) that may be broadcast.
FEW = 500_000


def _query_rows(rules: tuple[Rule, ...]) -> list[tuple[str, int, int, int, int, int]]:
    """(trigram, rule, run, alternative, bit, all bits) for the rules that have mandatory trigrams."""
    rows = []
    for r, rule in enumerate(rules):
        for run, alternatives in enumerate(query_of(rule.pattern)):
            for a, grams in enumerate(alternatives):
                rows += [(g, r, run, a, 1 << bit, (1 << len(grams)) - 1) for bit, g in enumerate(sorted(grams))]
    return rows


def _hash(text: Column) -> Column:
    """Beside the id, so that rows without one are spread over the tasks by their texts."""
    return F.xxhash64(text_of(text))


def postings(docs: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """The inverted index: ``trigram, doc_id, text_hash`` for the given lower-case trigrams."""
    present = let(F.lower(text_of(text)), lambda t: F.filter(F.lit(grams), lambda g: F.contains(t, g)))
    return docs.select("doc_id", _hash(docs[text]).alias("text_hash"), F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``of_id, of_hash, rules``: a bit per rule whose query the document's postings satisfy."""
    rows = _query_rows(rules)
    plan = docs.sparkSession.createDataFrame(rows, "trigram string, rule int, run int, alt int, bit long, all long")
    index = postings(docs, sorted({r[0] for r in rows}))
    alternatives = (
        index.join(F.broadcast(plan), "trigram")  # as many rows as the rules have trigrams
        .groupBy("doc_id", "text_hash", "rule", "run", "alt", "all").agg(F.bit_or("bit").alias("bits"))
        .where(F.col("bits") == F.col("all"))
    )
    runs = {r: len(query_of(rule.pattern)) for r, rule in enumerate(rules)}
    needed = F.create_map(*(F.lit(x) for pair in runs.items() for x in pair))[F.col("rule")]
    met = alternatives.groupBy("doc_id", "text_hash", "rule").agg(F.bit_or(F.expr("shiftleft(1L, run)")).alias("runs"))
    whole = met.where(F.bit_count("runs") == needed)
    document = [F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")]
    return whole.groupBy(*document).agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, kind's place, kind, end) of a rule in a text, in code points."""
    span_type = "array<struct<start: int, place: int, kind: string, end: int>>"
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("g"),
        F.split(text, rule.pattern, -1).alias("between"),
    )

    def step(so_far: Column, i: Column, x: Column) -> Column:
        start = so_far["at"] + F.char_length(F.get(x["between"], i))
        end = start + F.char_length(F.get(x["m"], i))
        span = F.struct(start.alias("start"), F.lit(order).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(F.char_length(F.get(x["g"], i)) >= rule.least, F.array(span)).otherwise(F.array().cast(span_type))
        return F.struct(end.alias("at"), F.concat(so_far["spans"], kept).alias("spans"))

    def spans(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(span_type).alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), start, lambda a, i: step(a, i, x))["spans"]

    found = F.when(F.rlike(text, F.lit(rule.pattern)), let(parts, spans))
    return F.coalesce(found, F.array().cast(span_type))


def _verified(docs: DataFrame, name: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the sorted spans of all rules.

    The candidates are stored: a few go to the texts, and many meet them over an exchange of which a hot part can be split.
    """
    chosen = broadcast_if_small(stored(candidates(docs, rules)), FEW)
    same = docs["doc_id"].eqNullSafe(chosen["of_id"]) & (_hash(docs["text"]) == chosen["of_hash"])
    asked = docs.join(chosen, same, "left")
    text = text_of(docs["text"])
    each = []
    for r, rule in enumerate(rules):
        spans = _matches(text, rule, r)
        if query_of(rule.pattern):
            hit = F.coalesce(chosen["rules"], F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0
            spans = F.when(hit, spans)
        each.append(spans)
    found = F.sort_array(F.flatten(F.array_compact(F.array(*each))))
    return asked.select(*(docs[f"`{c}`"] for c in docs.columns), found.alias(name))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the counts of the base kinds, the digest of their spans and all spans as text."""
    found = _verified(docs.select("doc_id", "text"), "found", rules)
    told = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    of = lambda *kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(told(of(*BASE)), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by a placeholder, overlapping ones by one, and ``n_chars`` counted anew."""
    name = free_name(docs, "found")

    def step(done: Column, x: Column) -> Column:
        before = F.col("text").substr(done["at"] + 1, x["start"] - done["at"])
        gap = F.when(x["start"] >= done["at"], F.concat(before, F.lit(PLACEHOLDER)))
        out = F.concat(done["out"], F.coalesce(gap, F.lit("")))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.col("text").substr(done["at"] + 1, F.char_length("text")))
    clean = F.when(F.size(name) > 0, F.aggregate(name, start, step, rest)).otherwise(F.col("text"))
    found = _verified(docs, name, rules).withColumn("text", clean)
    if "n_chars" in docs.columns:
        changed = F.when(F.size(name) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        found = found.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return found.drop(name)
