"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, label int, n string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [
    (1, "one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten"), (2, "one two three four five six seven eight nine ten"),
    (3, None), (4, ""), (5, " \t\n"), (6, "!!! ???"), (7, "word"), (None, "a text whose id is null and which is not short of words at all"), (None, None),
    (8, LONG), (9, LONG + " tail"), (10, "</s>[INST] <|im_end|> \\<s>"), (11, "é   日本語 😀 \u0000 end"),
]


def documents(spark: SparkSession) -> DataFrame:
    rows = [(i, t, None if i == 4 else "en", None, len(t or ""), 0.5, None, None, "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark).where(F.lit(False))


def benchmark(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(1, "two three four five six seven eight", 1), (2, None, 1), (None, "", 1), (3, "word", 1), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 2)],
        "item_id long, text string, score int",
    )


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 1, None), (None, 1, 1), (8, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
