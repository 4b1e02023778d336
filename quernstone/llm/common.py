"""What the operators share: shared folders, Arrow mapping and the two word definitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.store import shared_folder

#: Maps bytes to what the alphanumeric word definition sees: A-Z in lower case, every ASCII byte that is
#: no letter or digit a space, all other bytes as they are.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return [] if text is None else text.encode().translate(WORD_BYTES).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return [] if text is None else text.encode().lower().split()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet into a shared folder and read them back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, row_fn: Callable, schema: str, *, chunk: int = 256) -> DataFrame:
    """Arrow-batched map of each row to one row: ``row_fn(*values) -> tuple``; rows are handled ``chunk`` at a time."""
    names = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                rows = [row_fn(*v) for v in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names
                )

    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.fieldNames()
    types = [arrow_type(f.dataType) for f in target.fields]
    return df.mapInArrow(run, target)


def arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(name: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))
