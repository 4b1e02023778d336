"""Pages of a long ordered list by counts of its ranges.

A list is a store table of *ranges*: its rows ordered, cut into runs of about ``range_rows``, and written with the number of their
run. Beside it stands a table of counts, a row for each run and each value of the facets that pages are filtered by, with the
least and largest leading key. A page sums the counts in order, finds the runs that hold it, and reads those alone, however deep
it lies; the page behind a row that a reader has seen (a cursor) reads the runs from that row's key on. Rows with equal order
keys keep no fixed order, so the order ends with a unique key. Null keys stand where Spark's order puts them; an empty list
has no runs and gives empty pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.values import page_bounds
from quernstone.operators.store import Store

RANGE = "_range"
TASK_ROWS = 1_000_000  # rows that a task cuts into runs


@dataclass(frozen=True)
class Key:
    """A column that the list is ordered by. Nulls come first in a rising order, last in a falling one."""

    name: str
    falling: bool = False

    def order(self):
        return F.col(self.name).desc_nulls_last() if self.falling else F.col(self.name).asc_nulls_first()


class OrderedList:
    """A list ``name`` in a store, ordered by ``keys``, whose pages may be filtered by equal values of ``facets``."""

    def __init__(self, store: Store, name: str, keys: list[Key], facets: list[str] | None = None):
        self.store, self.name, self.keys, self.facets = store, name, keys, facets or []
        self._listed: tuple[int, DataFrame] | None = None

    def _order(self) -> list:
        return [k.order() for k in self.keys]

    def _table(self) -> DataFrame:
        """The list's rows; the folders of its runs are listed once a version."""
        version = self.store.manifest(self.name)["version"]
        if self._listed is None or self._listed[0] != version:
            self._listed = version, self.store.read(self.name)
        return self._listed[1]

    def build(self, rows: DataFrame, *, range_rows: int = 100_000) -> None:
        """The list anew. One pass counts the rows, one samples and writes them, one counts the runs."""
        n_rows = rows.count()
        n_runs, cores = max(1, -(-n_rows // range_rows)), rows.sparkSession.sparkContext.defaultParallelism
        # tasks are far fewer than runs; a given number of partitions isn't merged at run time, so their numbers rise with the order
        n_tasks = min(n_runs, max(cores, -(-n_rows // TASK_ROWS)))
        dealt = rows.repartitionByRange(n_tasks, *self._order()).sortWithinPartitions(*self._order())
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        runs = dealt.withColumn(RANGE, F.spark_partition_id() * F.lit(n_runs).cast("long") + F.floor(place / range_rows))
        self.store.write(self.name, runs.sortWithinPartitions(RANGE, *self._order()), partition=[RANGE])
        lead = F.col(self.keys[0].name)
        counts = self._table().groupBy(RANGE, *self.facets).agg(F.count("*").alias("n"), F.min(lead).alias("least"), F.max(lead).alias("largest"), F.count_if(lead.isNull()).alias("n_null"))
        self.store.write(f"{self.name}_counts", counts.coalesce(1))

    def _runs(self, where: dict) -> DataFrame:
        counts = self.store.read(f"{self.name}_counts")
        for facet, value in where.items():
            counts = counts.where(F.col(facet).eqNullSafe(F.lit(value)))
        return counts

    def _rows(self, runs: list[int], where: dict) -> DataFrame:
        rows = self._table().where(F.col(RANGE).isin(runs))
        for facet, value in where.items():
            rows = rows.where(F.col(facet).eqNullSafe(F.lit(value)))
        return rows

    def total(self, **where) -> int:
        """How many rows the filtered list has, from the counts."""
        return self._runs(where).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, number: int | None, size: int | None, **where) -> DataFrame:
        """``search.page`` over the filtered list; reads the runs that hold the page."""
        _, size, offset = page_bounds(number, size)
        before, held, skipped = 0, [], 0
        for run, n in self._runs(where).groupBy(RANGE).agg(F.sum("n")).orderBy(RANGE).collect():  # a row a run
            if before < offset + size and before + n > offset:
                skipped = skipped if held else before
                held.append(run)
            before += n
        return self._rows(held, where).orderBy(*self._order()).offset(offset - skipped if held else 0).limit(size).drop(RANGE)

    def after(self, cursor: dict | None, size: int, **where) -> DataFrame:
        """The ``size`` rows behind the row whose keys are ``cursor``, which need not be there; from the start where it is None.

        Reads the runs in which such a row can stand, as few as hold ``size`` of them for certain.
        """
        lead, beyond, in_front = self.keys[0], F.lit(cursor is None), F.lit(True)
        if cursor is not None:
            for key in self.keys:
                c, v = F.col(key.name), F.lit(cursor[key.name])
                null = cursor[key.name] is None
                further = (F.lit(False) if null else c.isNull() | (c < v)) if key.falling else (c.isNotNull() if null else c > v)
                beyond, in_front = beyond | (in_front & F.coalesce(further, F.lit(False))), in_front & c.eqNullSafe(v)
        held, certain = [], 0
        first = None if cursor is None else cursor[lead.name]
        for r in self._runs(where).groupBy(RANGE).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.sum("n_null").alias("n_null")).orderBy(RANGE).collect():  # a row a run
            all_in, some_in = cursor is None, cursor is None
            if cursor is not None and first is None:
                some_in = lead.falling is False or r["n_null"] > 0
                all_in = not lead.falling and r["n_null"] == 0
            elif cursor is not None:
                known = r["least"] is not None
                if lead.falling:
                    some_in = r["n_null"] > 0 or (known and r["least"] <= first)
                    all_in = not known or r["largest"] < first
                else:
                    some_in = known and r["largest"] >= first
                    all_in = known and r["n_null"] == 0 and r["least"] > first
            if some_in:
                held.append(r[RANGE])
                certain += r["n"] if all_in else 0
                if certain >= size:
                    break
        return self._rows(held, where).where(beyond).orderBy(*self._order()).limit(size).drop(RANGE)
