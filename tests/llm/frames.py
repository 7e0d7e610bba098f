"""Documents with everything that real ones have: nulls, empty and very long texts, copies, clashing columns."""

from pyspark.sql import functions as F

WORDS = "the of rend and threlyes ofth stthor nd double edout wh onha rent lyer hea thou ening tion".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 3) + i // 7) % len(WORDS)] for i in range(n))


ROWS = [
    (1, prose(1, 60), "en", "a"),
    (1, prose(1, 60), "en", "a"),
    (2, prose(1, 60), "en", None),
    (3, "", "de", "b"),
    (4, None, "de", "b"),
    (None, prose(2, 80), None, "a"),
    (None, None, None, None),
    (5, " \t\n\x0b\f\r ", "fr", "c"),
    (6, "One", "fr", "c"),
    (7, "One  TWO\nthree", "fr", "c"),
    (8, prose(3, 30_000), "en", "a"),
    (9, "password = abcdef0123 " + prose(4, 40) + " AKIA" + "A1" * 8 + " " + "0a" * 20, "en", "a"),
    (10, "▁ ▁▁ \x00 日本語 😀   é́ " + prose(5, 30), "es", "d"),
    (11, "x" * 100_000, "en", "a"),
    (12, "a " * 5_000, "en", "a"),
]
#: Names that the operators use inside, as columns of the input.
CLASHES = [
    "score", "fp", "found", "pieces", "row", "rules", "of_id", "id", "code", "first", "root", "epochs", "epoch", "domain",
    "last", "n_tokens", "limit", "label", "w", "l", "shard", "salt", "k1", "k2", "a", "b", "col", "held_out",
]


def documents(spark, rows=ROWS, clashes=True):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"kept {c}").alias(c) for c in CLASHES)) if clashes else df


def labels(spark, rows=((1, 1, 0), (3, 0, 0), (9, 1, 1), (None, 1, 1), (10, None, None), (99, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))
