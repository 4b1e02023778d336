"""Large CSV files by a parallel scan for quotes.

A quote anywhere in a line turns quoting on or off, so a line end closes a record if the number of quotes before it is even.
Spark splits files at lines; each split tells whether its quotes are odd, and how many records end in it if it begins outside
quotes and if it begins inside. A prefix pass over these rows, one a split, tells where each split begins and its first
record's number; then each split parses its records alone, and the pieces of records that cross splits are put together.
No file is bound to one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quernstone.operators.store import materialized

MOST_SPLITS, MOST_FILES = 4_000_000, 200_000  # of rows that are broadcast, one a split and one a file
_PIECE = re.compile(r'[^",\n]+|["\n,]')


def cells_of(text: str, separator: str = ",") -> list[list[str]]:
    """The records of a text: a quote turns quoting on and off wherever it stands, a doubled one within quotes is one quote;
    carriage returns before a record's end are dropped."""
    records, record, cell, quoted = [], [], [], False
    pieces = _PIECE.findall(text)
    k, n = 0, len(pieces)
    while k < n:
        p = pieces[k]
        if p == '"':
            if quoted and k + 1 < n and pieces[k + 1] == '"':
                cell.append('"')
                k += 1
            else:
                quoted = not quoted
        elif p == separator and not quoted:
            record.append("".join(cell))
            cell = []
        elif p == "\n" and not quoted:
            record.append("".join(cell).rstrip("\r"))
            records.append(record)
            record, cell = [], []
        else:
            cell.append(p)
        k += 1
    if quoted:
        raise ValueError("a quote isn't closed")
    if cell and "".join(cell) or record:
        records.append([*record, "".join(cell).rstrip("\r")])
    return records


def _counted(lines: DataFrame) -> DataFrame:
    """(path, block, odd, ends0, ends1) of each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list[int]] = {}
        for batch in batches:  # running counts; a split's lines aren't held
            for line, path, block in zip(*(c.to_pylist() for c in batch.columns)):
                s = state.setdefault((path, block), [0, 0, 0])
                s[0] ^= line.count('"') & 1
                s[1 + s[0]] += 1
        if state:
            (paths, blocks), counts = zip(*state), list(zip(*state.values()))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(blocks, pa.int64()), *(pa.array(c, pa.int64()) for c in counts)], names=["path", "block", "odd", "ends0", "ends1"])

    return lines.mapInArrow(run, "path string, block long, odd long, ends0 long, ends1 long")


RECORDS = "path string, no long, block long, cells array<string>, piece string"


def _parsed(lines: DataFrame) -> DataFrame:
    """The records of splits whose beginning is known: cells of whole ones, and pieces of those that cross splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = None

        def rows():
            columns = list(zip(*out))
            types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "no", "block", "cells", "piece"])

        def close(whole: bool):
            text = "\n".join(held)
            if whole and not crossing:
                told = cells_of(text)
                out.append((key[0], no, key[1], told[0] if told else [], None))
            else:
                out.append((key[0], no, key[1], None, text))

        held, crossing, quoted, no = [], False, 0, 0
        for batch in batches:
            for line, *split in zip(*(c.to_pylist() for c in batch.columns)):
                if split[:2] != key:
                    if held:
                        close(False)
                    key, quoted, no, held = split[:2], split[2], split[3], []
                    crossing = bool(quoted)
                held.append(line)
                quoted ^= line.count('"') & 1
                if not quoted:
                    close(True)
                    held, crossing, no = [], False, no + 1
            if len(out) >= 1000:
                yield rows()
                out = []
        if held:
            close(False)
        if out:
            yield rows()

    return lines.mapInArrow(run, RECORDS)


def _first_cells(texts: pd.Series) -> pd.Series:
    """The cells of texts of one record."""
    return texts.map(lambda t: (cells_of(t) or [[]])[0])


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_index, record) of all CSV files under a path: the first record that isn't blank names the columns, short
    records are padded, blank ones are dropped, of equal names the last wins. A file whose quotes don't close raises ValueError."""
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    splits = materialized(_counted(lines), "splits")
    if splits.count() > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    bad = splits.groupBy("path").agg(F.sum("odd").alias("odd")).where("odd % 2 = 1").first()
    if bad:
        raise ValueError(f"{bad[0]}: a quote isn't closed")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    begun = splits.withColumn("quoted", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)))
    ends = F.when(F.col("quoted") == 0, F.col("ends0")).otherwise(F.col("ends1"))
    begun = begun.withColumn("first", F.coalesce(F.sum(ends).over(before), F.lit(0))).select("path", "block", "quoted", "first")
    known = lines.join(F.broadcast(begun), ["path", "block"]).select("value", "path", "block", "quoted", "first")
    parsed = materialized(_parsed(known), "records")
    pieces = parsed.where("piece is not null").groupBy("path", "no").agg(F.min("block").alias("block"), F.sort_array(F.collect_list(F.struct(F.col("block").alias("at"), "piece"))).alias("pieces"))
    told = F.pandas_udf(_first_cells, ArrayType(StringType()))(F.array_join(F.transform("pieces", lambda p: p["piece"]), "\n"))
    joined = pieces.select("path", "no", "block", told.alias("cells"))
    every = parsed.where("piece is null").select("path", "no", "block", "cells").unionByName(joined)
    every = materialized(every.where(F.exists("cells", lambda c: F.trim(F.regexp_replace(c, r"\s", "")) != "")), "cells")
    heads = materialized(every.groupBy("path").agg(F.min_by("cells", "no").alias("heads"), F.min("no").alias("head_no")), "heads")
    if heads.count() > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files; read them folder by folder")
    names = F.transform("heads", lambda h, i: F.btrim(F.when(i == 0, F.regexp_replace(h, "^﻿", "")).otherwise(h), F.lit(" \t\r\n")))
    last = F.transform("names", lambda n, i: F.forall(F.slice("names", i + 2, F.size("names")), lambda m: m != n))
    heads = heads.withColumn("names", names).withColumn("last", last)
    rows = every.join(F.broadcast(heads), "path").where(F.col("no") > F.col("head_no"))
    # numbers go over splits first, then within them
    per = rows.groupBy("path", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("path", "block").orderBy("no"))).join(F.broadcast(per.drop("n")), ["path", "block"])
    entries = F.transform("names", lambda n, i: F.struct(n.alias("k"), F.coalesce(F.get("cells", i), F.lit("")).alias("v"), F.get("last", i).alias("last")))
    record = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["last"]), lambda e: F.struct(e["k"], e["v"])))
    return numbered.select("path", (F.col("before") + F.col("_rank")).alias("row_index"), record.alias("record"))
