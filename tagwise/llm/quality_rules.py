"""Quality rules with thresholds that adapt to each language and source.

Each document gets integer rates. Per (lang, source) and rate, a sketch counts the values of the documents that pass the
base rules in buckets of at most 3 % relative width; sketches merge by adding counts, so a language's sketch is the sum of
its sources' and the corpus' that of all languages. Fences are read from the sketch. Where most values of a rate are zero,
the fence is a high quantile of the others; else it is the upper (and for the word length the lower) quartile and three
interquartile ranges. A source with too few values for a rate takes its language's fence, a language the corpus'. Documents
join the fences of their group; those outside any fence are not kept. No fence is a fixed number: what is unusual in one
source may be usual in another.

Null text counts as empty; null language or source is a group of its own; repeated rows count each time; an empty table
gives an empty result; other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwise.llm.common import BLANKS, let, stored, text_of, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rates are per mille, the word length is in tenths of a character.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")
#: Interquartile ranges beyond the quartiles, and the one step beyond that where all values are tied.
SPREAD, TIE = 3, 1
#: Percentile of the values that are not zero, where most are.
HIGH = 95
#: Values that a group needs for quartiles, and values other than zero for the high percentile.
MIN_GROUP, MIN_OTHERS = 50, 40
#: Values below this have a bucket of their own, larger ones share half as many buckets per power of two.
FINE = 64


def _covered(hashes: Column, window: int) -> Column:
    """Number of positions in windows whose hash is there twice or more."""

    def repeated(pairs: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            same = lambda k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
            return same(j - 1) | same(j + 1)

        return F.sort_array(F.transform(F.filter(pairs, twice), lambda x: x["i"]))

    def length(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(let(pairs, repeated), length)


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words in ``window``-word windows that the text has twice or more; windows compare by a 64-bit hash."""
    zero = F.lit(0).cast("long")
    # F.get reads one element, where F.slice may copy the whole array
    of_words = F.transform(tokens, lambda x: F.xxhash64(x))
    starts = F.sequence(F.lit(0), F.size(tokens) - window)
    hashes = let(
        of_words, lambda h: F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))
    )
    once = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(_covered(h, window))
    return F.when(F.size(tokens) < window, zero).otherwise(let(hashes, once))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, lang, source``, the base statistics and the rates of every document."""
    whole = text_of(text)
    of_words = let(
        words(whole),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        F.filter(F.split(whole, "\n"), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    symbols = F.char_length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long")
    per = lambda n, part, all_: F.floor(n * F.col(part) / F.greatest(F.col(all_), F.lit(1)))
    return (
        docs.select("doc_id", "lang", "source", of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))
        .select("doc_id", "lang", "source", "w.*", "n_symbols", "l.n_dup_lines", "l.n_lines")
        .withColumn("symbol_rate", per(1000, "n_symbols", "word_chars"))
        .withColumn("dup_line_rate", per(1000, "n_dup_lines", "n_lines"))
        .withColumn("repeat_rate", per(1000, "n_repeat_words", "n_words"))
        .withColumn("word_length", per(10, "word_chars", "n_words"))
    )


def bucket_of(value: Column) -> Column:
    half, shift = FINE // 2, F.length(F.bin(value)) - (FINE.bit_length() - 1)
    return F.when(value < FINE, value).otherwise(half * shift + F.floor(value / F.pow(F.lit(2), shift)))


def lowest_of(bucket: Column) -> Column:
    """The least value of a bucket."""
    half = FINE // 2
    shift = F.floor(bucket / half) - 1
    return F.when(bucket < FINE, bucket).otherwise((bucket - half * shift) * F.pow(F.lit(2), shift)).cast("long")


def sketches(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Counts ``n`` by ``keys``, rate and bucket."""
    long = rates.select(
        *keys, F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), bucket_of(F.col(r)).alias("bucket")) for r in RATES)))
    )
    return long.groupBy(*keys, "col.rate", "col.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per group of ``keys`` a struct ``name`` that has for each rate ``enough, low, high``."""
    group = Window.partitionBy(*keys, "rate")
    total = lambda n: F.coalesce(F.sum(n).over(group), F.lit(0))
    seen = (
        sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("of", total("n"))
        .withColumn("zeros", total(F.when(F.col("bucket") == 0, F.col("n"))))
    )
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("of") * percent, F.col("bucket")))
    others = (F.col("bucket") > 0) & ((F.col("upto") - F.col("zeros")) * 100 >= (F.col("of") - F.col("zeros")) * HIGH)
    reach = SPREAD * (F.col("q3") - F.col("q1")) + TIE
    found = (
        seen.groupBy(*keys, "rate")
        .agg(
            F.max("of").alias("of"), (F.max("of") - F.max("zeros")).alias("others"), lowest_of(at(25)).alias("q1"),
            lowest_of(at(75)).alias("q3"), lowest_of(F.min(F.when(others, F.col("bucket")))).alias("top"),
        )
        .withColumn("dense", 2 * F.col("others") > F.col("of"))
        .select(
            *keys, "rate",
            F.when(F.col("dense"), F.col("of") >= MIN_GROUP).otherwise(F.col("others") >= MIN_OTHERS).alias("enough"),
            F.when(F.col("dense") & (F.col("rate") == "word_length"), F.col("q1") - reach).alias("low"),
            F.when(F.col("dense"), F.col("q3") + reach).otherwise(F.col("top")).alias("high"),
        )
    )
    pick = lambda rate: F.max(F.when(F.col("rate") == rate, F.struct("enough", "low", "high"))).alias(rate)
    one = found.groupBy(*keys).agg(*map(pick, RATES))
    return one.select(*keys, F.struct(*RATES).alias(name))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its statistics, ``base_failed`` and ``kept``."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    rates = stored(measured(docs).withColumn("base_failed", base_failed))
    by_source = sketches(rates.where("not base_failed"), ["lang", "source"]).withColumn("corpus", F.lit(0))
    by_lang = merged(by_source, ["corpus", "lang"])
    corpus = fences(merged(by_lang, ["corpus"]), ["corpus"], "of_corpus")
    langs = fences(by_lang, ["corpus", "lang"], "of_lang").join(corpus, "corpus").drop("corpus")
    groups = fences(by_source, ["lang", "source"], "of_source").withColumnRenamed("lang", "of_lang_name")

    def limit(rate: str) -> Column:
        own = [F.when(F.col(g)[rate]["enough"], F.col(g)[rate]) for g in ("of_source", "of_lang")]
        return F.coalesce(*own, F.col("of_corpus")[rate]).alias(f"{rate}_limit")

    limits = groups.join(langs, F.col("of_lang_name").eqNullSafe(F.col("lang"))).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *map(limit, RATES)
    )
    joined = rates.join(
        limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left"
    )
    outside = F.lit(False)
    for rate in RATES:
        value, of = lowest_of(bucket_of(F.col(rate))), F.col(f"{rate}_limit")
        outside = outside | F.coalesce(value > of["high"], F.lit(False)) | F.coalesce(value < of["low"], F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~outside).alias("kept"), *RATES,
    )
