"""Stupid backoff in plain DataFrame operations: exploded n-grams, a count table, equi joins back, sums by document.

The same scores as ``backoff.score``; the tests compare the two, and the README has what this form shuffles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """doc_id, n_words and log_score of each row of ``docs(doc_id, text)``; rows are told apart by ``row``."""
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), CAPITALS, SMALL), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("words")).withColumn("n_words", F.size("words"))
    total = texts.agg(F.sum("n_words")).first()[0] or 0
    # an n-gram's hash goes over its words' hashes, so that no row carries a text's words
    hashed = texts.where("n_words > 0").select("row", F.posexplode("words")).select("row", (F.col("pos") + 1).alias("i"), F.xxhash64("col").alias("w"))
    behind = Window.partitionBy("row").orderBy("i")
    for back in range(1, order):
        hashed = hashed.withColumn(f"w{back}", F.lag("w", back).over(behind))
    gram = F.array(*(F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), "w", *(f"w{b}" for b in range(1, n))).alias("h")) for n in range(1, order + 1)))
    grams = hashed.select("row", "i", F.inline(F.filter(gram, lambda g: g["n"] <= F.col("i"))))
    own = grams.groupBy("row", "n", "h").agg(F.count("*").alias("own"))
    table = own.groupBy("n", "h").agg(F.sum("own").alias("c"))
    left = own.join(table, ["n", "h"]).select("row", "n", "h", (F.col("c") - F.col("own")).alias("left"))
    told = grams.join(left, ["row", "n", "h"]).groupBy("row", "i").pivot("n", list(range(1, order + 1))).agg(F.max("left"))
    along = Window.partitionBy("row").orderBy("i")
    for n in range(1, order):
        told = told.withColumn(f"before{n}", F.lag(str(n)).over(along))
    told = told.join(texts.select("row", "n_words"), "row").withColumn("rest", total - F.col("n_words"))
    top = F.least(F.lit(order), F.col("i"))
    s = -F.log(F.col("rest") + 1.0) + (top - 1) * math.log(alpha)
    for n in range(1, order + 1):
        below = F.col("rest") if n == 1 else F.col(f"before{n - 1}")
        s = F.when(F.col(str(n)) > 0, F.log(F.col(str(n)) / below) + (top - n) * math.log(alpha)).otherwise(s)
    sums = told.groupBy("row").agg(F.sum(s).alias("log_score"))
    return texts.join(sums, "row", "left").select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
