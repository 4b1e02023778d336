"""Time-varying curriculum: sources mixed to target weights along a training run.

Each source has a weight and a schedule, a piecewise linear weight over training time 0 to 1. The weights give each
source's target in words; the integral of its schedule, scaled to the target, is the demand D(t) for its words by time
t. A document that begins after C words of its source stands at the t with D(t) = C: inverting the cumulative demand
gives every document (and every repeat) its training position, and the rows are range-sorted by it.

Running sums within a source go over two levels, sums of hash buckets and rows within a bucket, so that no task holds a
whole source. Only the number of rows passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import n_partitions, stored

WEIGHTS = (5.0, 2.0, 1.0)
#: Knots (time, weight) of the schedules, dealt to the sources in turn like the weights: early, even, late.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_BUCKET = 4096


def cumulative(knots) -> list[tuple[float, float, float, float]]:
    """(time, weight, slope, integral so far) at each knot, the integral scaled to 1 at time 1."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if knots[0][0] != 0 or knots[-1][0] != 1 or total <= 0 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule runs from time 0 to 1 and has weights of 0 or more, not all 0")
    out, held = [], 0.0
    for a, b in zip(knots, knots[1:]):
        slope = (b[1] - a[1]) / (b[0] - a[0])
        out.append((a[0], a[1] / total, slope / total, held))
        held += (b[0] - a[0]) * (a[1] + b[1]) / 2 / total
    return out


def inverse_demand(u: Column, knots) -> Column:
    """The time by which the schedule has asked for the share ``u`` (0 to 1) of its words."""
    result = None
    for t, w, slope, held in cumulative(knots):
        need = F.greatest(F.lit(0.0), u - F.lit(held))
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + F.lit(2 * slope) * need))
        # the positive root of slope/2 s^2 + w s = need, in the form without cancellation
        step = F.when(F.lit(w) + root > 0, 2 * need / (F.lit(w) + root)).otherwise(F.lit(0.0))
        here = F.lit(t) + step
        result = here if result is None else F.when(u >= F.lit(held), here).otherwise(result)
    return F.least(F.lit(1.0), result)


def targets(sources: DataFrame, weights, share: float, most: float) -> DataFrame:
    """``sources(source_key, source_size)`` with class (place in turn) and target.

    One row for each source: sorted by cap/weight, a prefix of them stops at ``most`` times its size and the others
    share what is left by weight.
    """
    everywhere = Window.orderBy(F.col("is_null"), "source_key")
    ranked = sources.withColumn("class", (F.row_number().over(everywhere) - 1) % len(weights))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1)).withColumn(
        "cap", F.col("source_size") * F.lit(float(most))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "is_null", "source_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)  # what a unit of weight gets if this source and all later ones are below their caps
    open_level = F.when(level <= F.col("cap") / F.col("weight"), level)
    settled = weighted.withColumn("level", level).withColumn("open", open_level)
    return settled.withColumn("fill", F.max("open").over(every)).withColumn(
        "target", F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("fill")))
    )


def plan(docs: DataFrame, *, weights=WEIGHTS, schedules=SCHEDULES, share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """The mix of ``docs(doc_id, source, text)``, one row for each row of it, range-sorted by first position.

    Columns: doc_id, digest (of the text), size (words; null text: 0), source_size, target, taken (words the mix
    takes, repeats counted), passes (taken / size, rounded up) and position (0 to 1, null where nothing is taken).
    Documents of a source follow each other by a seeded hash, pass after pass, until its target is met; the last one
    may be taken in part. Repeated rows are rows of their own; a null source is a source, the last; empty texts and
    empty tables take nothing; reruns agree.
    """
    spark = docs.sparkSession
    digest = F.xxhash64("text")
    sizes = docs.select(
        "doc_id",
        digest.alias("digest"),
        F.concat(F.lit("="), "source").alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", digest).alias("order_key"),
    ).select("*", F.col("source_key").isNull().alias("is_null")).fillna({"source_key": ""})
    sizes = stored(sizes, "sizes")
    buckets = max(64, -(-sizes.count() // ROWS_A_BUCKET))
    sizes = sizes.withColumn("bucket", F.pmod("order_key", F.lit(buckets)))
    sums = sizes.groupBy("source_key", "is_null", "bucket").agg(F.sum("size").alias("words"))
    sources = sums.groupBy("source_key", "is_null").agg(F.sum("words").alias("source_size"))
    told = targets(sources, weights, share, most)
    along = Window.partitionBy("source_key", "is_null").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = sums.withColumn("base", F.coalesce(F.sum("words").over(along), F.lit(0)))
    ends = stored(
        based.join(told, ["source_key", "is_null"]).select("source_key", "is_null", "bucket", "base", "class", "source_size", "target"),
        "buckets",
    )
    within = (
        Window.partitionBy("source_key", "is_null", "bucket")
        .orderBy("order_key", F.col("doc_id").asc_nulls_first(), "digest")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sizes.join(ends, ["source_key", "is_null", "bucket"]).withColumn(
        "begin", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    wanted = F.round("target").cast("long")
    taken = sum(
        (F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - F.col("begin") - p * F.col("source_size"))) for p in range(most)),
        F.lit(0).cast("long"),
    )
    mixed = placed.withColumn("taken", taken).withColumn("passes", F.ceil(F.col("taken") / F.greatest("size", F.lit(1))))
    mixed = mixed.withColumn("position", F.when(F.col("taken") > 0, position(F.lit(0), schedules)))
    return mixed.select("doc_id", "digest", "size", "source_size", "target", "taken", "passes", "position", "class", "begin")


def position(which: Column, schedules=SCHEDULES) -> Column:
    """The training position of pass ``which`` (from 0), from the columns begin, source_size, target and class."""
    u = (F.col("begin") + which * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))
    chosen = F.lit(None).cast("double")
    for c, knots in enumerate(schedules):
        chosen = F.when(F.col("class") % len(schedules) == c, inverse_demand(u, knots)).otherwise(chosen)
    return chosen


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows range-sorted by position (null last), ties by doc_id."""
    keys = (F.col("position").asc_nulls_last(), F.col("doc_id"))
    return mixed.repartitionByRange(n_partitions(mixed.sparkSession), *keys).sortWithinPartitions(*keys)


#: The column of ``mix`` that holds the training position.
POSITION = "training_position"


def mix(docs: DataFrame, *, schedules=SCHEDULES, **options) -> DataFrame:
    """The training sequence: the columns of ``docs``, a row for each time a document is taken, and POSITION (0 to 1; a
    column of that name in ``docs`` is replaced), in training order.

    A document taken in part on its last pass keeps its first words there, joined by single spaces; n_chars, where
    there is such a column, then counts what is left. Documents that the mix doesn't take are absent.
    """
    planned = stored(plan(docs, schedules=schedules, **options).where("taken > 0"), "plan")
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # repeated rows have equal doc_id and text: they are paired by number so that each meets its own share
    repeated = not docs.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").isEmpty()
    same = Window.partitionBy("doc_id", "digest")
    planned = planned.withColumn("nth", F.row_number().over(same.orderBy("begin")) if repeated else F.lit(1))
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy(F.lit(1))) if repeated else F.lit(1))
    both = rows.alias("r").join(
        planned.alias("p"),
        F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.digest") == F.col("p.digest")) & (F.col("r.nth") == F.col("p.nth")),
    ).drop(F.col("r.digest"), F.col("r.nth"), F.col("r.doc_id"))
    each = both.withColumn("pass", F.explode(F.sequence(F.lit(0), (F.col("passes") - 1).cast("int"))))
    left = F.col("taken") - F.col("pass") * F.col("size")
    cut = left < F.col("size")
    part = F.array_join(F.slice(F.filter(F.split("row.text", SPACE), lambda w: w != ""), F.lit(1), left.cast("int")), " ")
    row = F.col("row").withField("text", F.when(cut, part).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(cut, F.length(part).cast("long")).otherwise(F.col("row.n_chars")))
    placed = each.select("doc_id", row.alias("row"), position(F.col("pass"), schedules).alias("position"))
    return in_order(placed).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != POSITION), F.col("position").alias(POSITION))
