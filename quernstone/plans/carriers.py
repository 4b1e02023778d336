"""The tables that queries run over, and the search indexes of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.plans import stored


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_items(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.concat(F.lit("P"), "p_partkey").alias("code"), F.col("p_name").alias("name"),
        F.col("p_name").alias("alias"), F.col("p_type").alias("category"), F.col("p_brand").alias("tags"), F.lit("ready").alias("data_status"),
    )


def part_index(spark, sf_dir):
    return stored.index(spark, f"{sf_dir}/part.parquet", "part", lambda: part_items(spark, sf_dir), ["name", "category"])


def text_items(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def text_index(spark, sf_dir):
    return stored.index(spark, f"{sf_dir}/documents.parquet", "documents", lambda: text_items(spark, sf_dir), ["content"])
