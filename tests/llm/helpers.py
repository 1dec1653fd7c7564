"""Small inputs that the operators' tests share."""

import random

SYLLABLES = ("ba", "lo", "mer", "ti", "son", "ur", "ek", "vi", "né", "or", "gra", "pel", "du")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(words(rng, n)) + "."


def documents(spark, rows, extra: bool = False):
    """(doc_id, text) rows as a documents table; ``extra`` adds columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for name in ("score", "label", "doc", "rep", "n", "tree", "part", "text_crc32", "shard", "predicted", "order", "class_id", "links"):
            df = df.withColumn(name, F.lit("clash"))
    return df
