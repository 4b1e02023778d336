"""Deterministic item and relation tables of any size, computed where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The anchor items and the types and relations that the others cycle through.
ANCHORS = [
    ("acupoint", "ST36", "足三里", "足三里穴", "zusanli", "足阳明胃经", "胃经,常用穴"),
    ("meridian", "ST", "足阳明胃经", "胃经", "zuyangmingweijing", "十二经脉", "胃经,阳明"),
    ("herb", "H0001", "黄芪", "黄耆", "huangqi", "补气药", "中药,补气"),
    ("formula", "F0001", "补中益气汤", "", "buzhongyiqitang", "补益剂", "方剂,补气"),
]
TYPES = ["herb", "formula", "meridian", "acupoint", "syndrome", "disease"]
RELATIONS = ["contains", "belongs_to", "related_to", "similar_to", "references"]


def items(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("i")
    number = F.lpad((i + 1).cast("string"), 5, "0")
    made = {
        "type": F.element_at(F.array(*map(F.lit, TYPES)), (i % len(TYPES) + 1).cast("int")),
        "code": F.concat(F.lit("T"), number), "name": F.concat(F.lit("测试知识"), number), "alias": F.concat(F.lit("别名"), number),
        "pinyin": F.concat(F.lit("ceshizhishi"), number), "category": F.concat(F.lit("分类"), (i % 20).cast("string")),
        "tags": F.concat(F.lit("标签"), (i % 30).cast("string"), F.lit(",性能测试")),
    }
    anchors = {c: F.element_at(F.array(*(F.lit(a[k]) for a in ANCHORS)), (i + 1).cast("int")) for k, c in enumerate(made)}
    cols = [F.when(i < len(ANCHORS), F.nullif(anchors[c], F.lit(""))).otherwise(made[c]).alias(c) for c in made]
    return spark.range(n).withColumnRenamed("id", "i").select((i + 1).alias("id"), *cols, F.lit("ready").alias("data_status"))


def relations(spark: SparkSession, n_items: int, n: int, *, loops: str = "drop") -> DataFrame:
    """Edges (i mod n, (37 i + 11) mod n); loops are dropped, or moved to the next item (``retarget``)."""
    i = F.col("i")
    source, target = i % n_items, (i * 37 + 11) % n_items
    edges = spark.range(n).withColumnRenamed("id", "i").select(
        (source + 1).alias("source_id"), (F.when(source == target, (source + 1) % n_items).otherwise(target) if loops == "retarget" else target).alias("t"),
        F.element_at(F.array(*map(F.lit, RELATIONS)), (i % len(RELATIONS) + 1).cast("int")).alias("relation_type"),
    )
    return edges.select("source_id", (F.col("t") + 1).alias("target_id"), "relation_type").where("source_id != target_id")


def import_rows(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("i")
    record = F.map_from_arrays(F.array(F.lit("type"), F.lit("code"), F.lit("name")), F.array(F.lit("herb"), F.concat(F.lit("R"), (i + 1).cast("string")), F.concat(F.lit("导入知识"), (i + 1).cast("string"))))
    return spark.range(n).withColumnRenamed("id", "i").select((i + 1).alias("row_index"), record.alias("record"))


def duplicates(spark: SparkSession, n_items: int, n: int) -> DataFrame:
    """Candidate pairs of neighbours with scores .70 to .99."""
    i = F.col("i")
    return spark.range(n).withColumnRenamed("id", "i").select((i % n_items + 1).alias("item_id"), ((i + 1) % n_items + 1).alias("duplicate_id"), (0.70 + (i % 30) / 100).alias("score"), F.lit("pending").alias("status"))


def suggestions(spark: SparkSession, n_items: int, n: int) -> DataFrame:
    """Suggested edges with confidences .60 to .94."""
    i = F.col("i")
    return relations(spark, n_items, n, loops="retarget").select("source_id", "target_id", "relation_type").withColumn("i", F.monotonically_increasing_id()).select("source_id", "target_id", "relation_type", (0.60 + (i % 35) / 100).alias("confidence"), F.lit("pending").alias("status"))
