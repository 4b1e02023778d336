"""Profiles: field coverage, quality report, histograms, integrity checks, error statistics, line metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T

#: Fields of the coverage profile.
PROFILED = ["type", "code", "name", "category", "summary", "content", "source_note", "tags"]


def field_profile(rows: DataFrame, fields: list[str] = PROFILED) -> DataFrame:
    """(field, coverage, n_empty) over map rows: the share of rows that have the key, and how many have it blank."""
    r = F.col("record")
    sums = rows.agg(
        F.greatest(F.count("*"), F.lit(1)).alias("n"),
        *(F.count_if(F.map_contains_key(r, f)).alias(f"has_{f}") for f in fields),
        *(F.count_if(F.map_contains_key(r, f) & T.blank_to_null(F.try_element_at(r, F.lit(f))).isNull()).alias(f"empty_{f}") for f in fields),
    )
    entries = F.array(*(F.struct(F.lit(f).alias("field"), (F.col(f"has_{f}") / F.col("n")).alias("coverage"), F.col(f"empty_{f}").alias("n_empty")) for f in fields))
    return sums.select(F.inline(entries))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_rows, n_missing, n_blank) over plain columns, in one pass."""
    sums = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns), *(F.count_if(F.coalesce(T.strip(F.col(c).cast("string")), F.lit("x")) == "").alias(f"b_{c}") for c in columns))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col("n").alias("n_rows"), F.col(f"m_{c}").alias("n_missing"), F.col(f"b_{c}").alias("n_blank")) for c in columns))))


def duplicate_fingerprints(rows: DataFrame, fingerprint: Column) -> DataFrame:
    """n_duplicate: rows less distinct fingerprints, empty ones left out. Counts per fingerprint are summed, not sets."""
    per = rows.select(fingerprint.alias("f")).where("f != ''").groupBy("f").count()
    return per.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicate"))


def histogram(df: DataFrame, column: str, missing: str = "未填写") -> DataFrame:
    value = F.coalesce(T.blank_to_null(column), F.lit(missing))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k commonest values, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def first_values(hist: DataFrame, k: int = 8) -> DataFrame:
    """The first entries of a histogram by value, as a short view shows them."""
    return hist.orderBy("value").limit(k)


def rows_with_issue(staged: DataFrame, code: str = "possible_existing_duplicate") -> DataFrame:
    """n_rows: staged rows that have an issue of this code; rows with the same index count once."""
    hit = staged.where(F.exists("issues", lambda i: i["issue_code"] == code))
    return hit.groupBy("row_index").count().agg(F.count("*").alias("n_rows"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the number of rows of each table, a column each."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), counts)  # single rows


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups with more than one row, and their sizes."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    sums = df.agg(*(F.count_if(T.blank_to_null(F.col(f).cast("string")).isNull()).alias(f) for f in fields))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n_missing")) for f in fields))))


def quality_report(rows: DataFrame, fingerprint: Column) -> DataFrame:
    """One row: counts by status, duplicates, coverage of source_note, and the suggestions that follow from them."""
    r = F.col("record")
    sums = rows.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("status").isin("valid", "warning", "imported")).alias("n_valid"),
        F.count_if(F.col("status") == "warning").alias("n_warning"), F.count_if(F.col("status") == "error").alias("n_error"),
        (F.count_if(F.map_contains_key(r, "source_note")) / F.greatest(F.count("*"), F.lit(1))).alias("source_coverage"),
    ).crossJoin(duplicate_fingerprints(rows, fingerprint))  # two single rows
    told = [
        F.when(F.col("n_error") > 0, "fix rows with errors"), F.when(F.col("n_duplicate") > 0, "review duplicate rows"),
        F.when(F.col("source_coverage") < 0.8, "add source notes"),
    ]
    return sums.withColumn("suggestions", F.filter(F.array(*told), lambda x: x.isNotNull()))


def import_report(rows: DataFrame, fingerprint: Column, confirmed: DataFrame, n_terms: int = 0) -> DataFrame:
    """One row: ``quality_report`` with the profile of the fields, the number of rows of each type (a blank one is "unknown"), and
    what the import changed: items inserted, by the ids ``confirmed(id)``, rows left out, rows that may be known already, terms.

    Fields and types are few, so they stand in arrays of the row; an import without rows gives one row of zeros.
    """
    kind = F.coalesce(T.blank_to_null(F.try_element_at("record", F.lit("type"))), F.lit("unknown"))
    types = rows.groupBy(kind.alias("type")).agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("type", "n"))).alias("types"))
    fields = field_profile(rows)
    fields = fields.agg(F.sort_array(F.collect_list(F.struct(*fields.columns))).alias("fields"))
    inserted = confirmed.select(F.col(confirmed.columns[0])).distinct().agg(F.count("*").alias("n_inserted"))
    known = rows_with_issue(rows).agg(F.count("*").alias("n_known"))
    one = quality_report(rows, fingerprint).crossJoin(types).crossJoin(fields).crossJoin(inserted).crossJoin(known)  # single rows
    more = F.filter(F.array(F.when(F.col("n_known") > 0, "confirm rows that may be known")), lambda x: x.isNotNull())
    return one.withColumns({"n_left_out": F.col("n_rows") - F.col("n_inserted"), "n_terms": F.lit(n_terms).cast("long"), "suggestions": F.concat("suggestions", more)})


def error_statistics(log: DataFrame, now: str, days: int = 7, k: int = 10) -> DataFrame:
    """(error_type, n, n_day) of the log ``(error_type, ts)`` over the last days, the k commonest, ties by name."""
    at = F.lit(now).cast("timestamp")
    recent = log.where((F.col("ts") >= at - F.expr(f"interval {int(days)} days")) & (F.col("ts") <= at))
    per = recent.groupBy("error_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= at - F.expr("interval 1 day")).alias("n_day"))
    return per.orderBy(F.desc("n"), "error_type").limit(k)


def retained(log: DataFrame, now: str, days: int) -> DataFrame:
    """Rows not older than ``days``, which is kept within 1 and 3650."""
    days = min(max(int(days), 1), 3650)
    return log.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has; null keys are no orphans."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def integrity(checks: dict[str, DataFrame]) -> DataFrame:
    """(check_name, n) of each check's offending rows, and their ``total``."""
    each = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n") for name, df in checks.items()])
    return each.unionByName(each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("check_name"), "n"))


def keyword_presence(df: DataFrame, text, keywords: list[str]) -> DataFrame:
    """(keyword, present) over all rows, in one pass."""
    sums = df.agg(*(F.coalesce(F.bool_or(F.contains(T.col(text), F.lit(k))), F.lit(False)).alias(f"k{i}") for i, k in enumerate(keywords)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("present")) for i, k in enumerate(keywords)))))


def line_metrics(text) -> dict[str, Column]:
    """Line counts of a text and what they say: n_lines, n_short (up to three characters), short_ratio, n_header (title
    characters alone on a line), n_repeated (short lines that the next one repeats or goes on), n_layout, suspicious, noisy."""
    from quernstone.functions.udfs import BACKUP_MARK
    from quernstone.operators.curate import TITLE_CHARS, is_layout_line

    # A short line's length, that of a repeated one, and from where on a text is suspicious.
    lines = F.filter(F.transform(F.split(T.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.arrays_zip(lines.alias("line"), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))).alias("next"))
    again = (lambda p: (F.length(p["line"]) <= 6) & ((p["line"] == p["next"]) | F.startswith(T.compact(p["next"]), T.compact(p["line"]))))
    n, short = F.size(lines), F.size(F.filter(lines, lambda x: F.length(x) <= 3))
    ratio = F.round(F.when(n > 0, short / n).otherwise(0.0), 3)
    header = F.size(F.filter(lines, lambda x: x.isin(TITLE_CHARS)))
    repeated, layout = F.size(F.filter(pairs, lambda p: F.coalesce(again(p), F.lit(False)))), F.size(F.filter(lines, is_layout_line)) - header
    running = F.contains(T.col(text), F.lit("觀其脈證知犯")) | F.contains(T.col(text), F.lit("观其脉证知犯")) | F.contains(T.col(text), F.lit("觀\n其\n脈\n證"))
    return {
        "n_lines": n, "n_short": short, "short_ratio": ratio, "n_header": header, "n_repeated": repeated, "n_layout": layout,
        "suspicious": ((n >= 18) & (short / F.greatest(n, F.lit(1)) >= 0.28)) | (header >= 4) | running,
        "noisy": (layout > 0) | (repeated >= 2) | F.contains(T.col(text), F.lit(BACKUP_MARK)),
    }
