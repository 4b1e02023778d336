"""The stored search index: segments of terms, grams, postings and list rows, with tombstones.

An index is a set of store tables that only grow, folder by folder. A change of some items writes one *segment*: their terms,
the grams of their terms, their postings, list rows and lengths, and a tombstone for each of them and of the removed ones. A
tombstone of segment s makes the item's rows of segments before s dead; readers leave these out by an anti-join with the
tombstones, a table of changed ids. Counts of documents and words are kept as deltas, a row a segment. ``compact`` writes the
live rows as one new segment and drops the others.

* ``terms`` are dealt into buckets by a hash of the term, so that a search prunes to its terms' buckets.
* ``grams`` (gram, term) hold each distinct term under its runs of one, two and three characters, sorted by gram. A search for a
  substring reads the rows of its rarest gram, verifies these terms, and meets the buckets of what is left; the dictionary is
  never scanned.
* ``postings`` (token, item, length, places) are ranged by the first bytes of the token, heavy ones over several files, so that
  file and row-group statistics prune to a query's words; a row of the empty token tells each item's length.
* ``listing`` holds an item's row of the list page, ``degrees`` the number of its relations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import relations, search
from quernstone.operators.store import Store, materialized

BUCKETS = 32
GRAM = 3  # characters of the longest grams
TABLES = ("terms", "grams", "postings", "listing", "lengths", "tombstones", "deltas")
LISTING = ["type", "name", "code", "category", "data_status"]


def bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def grams(term: Column) -> Column:
    """The distinct runs of one to ``GRAM`` characters of a term in small letters."""
    low = F.lower(term)

    def runs(n: int) -> Column:
        places = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, places).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*map(runs, range(1, GRAM + 1)))))


def query_grams(query: str) -> list[str]:
    """The longest grams that a term must hold to match ``%query%``; % and _ in the query stand for anything."""
    runs = [r for r in re.split("[%_]", query.lower()) if r]
    if not runs:
        return []
    n = min(GRAM, max(map(len, runs)))
    return sorted({r[i : i + n] for r in runs for i in range(len(r) - n + 1)})


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where fewer files hold them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


#: The token of the row that tells an item's length; no word is empty.
LENGTH = ""
HEAD = 6  # bytes of a token that its postings are ordered by: as a number these are exact in double precision
PART_CHARS = 12_000_000  # characters of the texts whose postings make up a file
SAMPLED = 2_000  # items whose tokens tell where files begin
POSTING = "token string, id long, dl int, places array<long>"


def grouped_places(docs: DataFrame, columns: list[str], bounds: list[int] | None = None) -> DataFrame:
    """(token, id, dl, places) of each row's columns, grouped within the row: no word leaves it before that. A row of the
    token ``LENGTH`` and no places stands for each item. ``head`` is the number of the token's first bytes and ``part`` its
    place among the bounds; a head that is several bounds is dealt to the parts between them by id, the parts staying in order."""
    lists = F.array(*(search.tokens(c) for c in columns))
    edges, n_columns = np.array(bounds or [], np.int64), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cells, n_rows = part.column(1).flatten(), part.num_rows
                words = cells.flatten().dictionary_encode()
                sizes = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
                cell = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + cell % n_columns * search.COLUMN_SPAN
                # word 0 is LENGTH, which every row has and which has no places
                vocabulary = [LENGTH.encode(), *words.dictionary.cast(pa.binary()).to_pylist()]
                told = cell // n_columns * len(vocabulary) + words.indices.to_numpy() + 1
                order = np.argsort(told, kind="stable")
                told = told[order]
                first = np.flatnonzero(np.diff(told, prepend=-1))
                row, word = np.divmod(np.append(told[first], np.arange(n_rows) * len(vocabulary)), len(vocabulary))
                starts = np.append(first, np.full(n_rows + 1, len(told)))
                ids, dl = part.column(0).take(pa.array(row)), sizes.reshape(-1, n_columns).sum(axis=1).astype(np.int32)[row]
                head = (np.array(vocabulary, f"S{HEAD}").astype("S8").view(">u8") >> np.uint64(8 * (8 - HEAD))).astype(np.int64)[word]
                low, high = (np.searchsorted(edges, head, side) for side in ("left", "right"))
                parts = low + ids.fill_null(0).to_numpy() % (high - low + 1)
                places = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(place[order], pa.int64()))
                token = pa.array(vocabulary, pa.binary()).cast(pa.string()).take(pa.array(word))
                yield pa.RecordBatch.from_arrays([token, ids, pa.array(dl), places, pa.array(head), pa.array(parts.astype(np.int32))], names=["token", "id", "dl", "places", "head", "part"])

    return docs.select(F.col("id").cast("long").alias("id"), lists.alias("lists")).mapInArrow(run, POSTING + ", head long, part int")


def ranged_postings(items: DataFrame, columns: list[str]) -> DataFrame:
    """The postings of all items, ranged by token, heavy tokens over several parts, in one pass and one shuffle. Where parts
    begin is told by a sample of some thousands of items; it moves no result, only the sizes of files."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    chars = sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(0).cast("long"))
    n_items, n_chars = items.agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    n = max(-(-n_chars // PART_CHARS), min(cores, -(-n_chars // 600_000)), 1)
    bounds: list[int] = []
    if n > 1:
        sample = items.where(F.pmod(F.xxhash64("id"), F.lit(max(n_items // SAMPLED, 1))) == 0)
        cuts = F.percentile_approx("head", [i / n for i in range(1, n)], F.lit(max(10_000, 10 * n)))
        bounds = grouped_places(sample, columns).agg(cuts).first()[0] or []  # a number a part
    dealt = grouped_places(items, columns, bounds).repartitionById(n, F.col("part"))
    return dealt.sortWithinPartitions("head").drop("head", "part")


class SearchIndex:
    """An index in a store. Items have the columns of ``search.item_table``; the full text is that of ``columns``."""

    def __init__(self, store: Store, columns: list[str], *, detail_is_json: bool = True):
        self.store, self.columns, self.detail_is_json, self.spark = store, columns, detail_is_json, store.spark

    # writing

    def build(self, items: DataFrame, edges: DataFrame | None = None) -> None:
        """The whole index anew, with the items' degrees where ``edges`` are given."""
        self._segment(items, None, first=True)
        if edges is not None:
            self.count_degrees(edges)

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """New and changed items, whole rows, and the ids of removed ones, as one segment."""
        self._segment(changed, removed, first=False)

    def count_degrees(self, edges: DataFrame) -> None:
        """The number of relations of each item and type, written anew."""
        self.store.write("degrees", relations.degrees(edges), keys=["item_id"])

    def edges_changed(self, edges: DataFrame, ids: DataFrame) -> None:
        """The degrees of these items counted anew over ``edges``; only their buckets are written."""
        ids = materialized(ids.select(F.col(ids.columns[0]).alias("item_id")).distinct(), "ids")
        counted = relations.degrees(edges).join(ids, "item_id", "left_semi")
        told = ids.join(counted, "item_id", "left")
        self.store.merge("degrees", told, ["item_id"], lambda old, new: old.join(new.select("item_id").distinct(), "item_id", "left_anti").unionByName(new.where("n is not null")))

    def segments(self) -> list[int]:
        return [r[0] for r in self.store.read("deltas").select("segment").distinct().orderBy("segment").collect()]  # a number a segment

    def _segment(self, items: DataFrame, removed: DataFrame | None, *, first: bool) -> None:
        number = 1 if first else max(self.segments()) + 1
        items = materialized(spread(search.item_table(items)), "changed")
        tag = F.lit(number).alias("segment")
        terms = materialized(search.build_terms(items, detail_is_json=self.detail_is_json), "terms")
        gone = items.select(F.col("id").alias("item_id"))
        gone = (gone if removed is None else gone.unionByName(removed.select(F.col(removed.columns[0]).alias("item_id")))).distinct()
        before = None
        if not first:  # what the tombstones take from the totals
            before = self.live("lengths").join(gone, "item_id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        write = self.store.write if first else self.store.append
        rows = {
            "terms": terms.select("item_id", "term_type", "term", "weight", tag, bucket().alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "term"),
            "grams": _ranged(terms.select("term").distinct().select(F.explode(grams(F.col("term"))).alias("gram"), "term", tag), "gram", "term"),
            "postings": ranged_postings(items, self.columns).withColumn("segment", tag),
            "listing": items.select(F.col("id").alias("item_id"), *LISTING, tag),
            "tombstones": (gone.limit(0) if first else gone).select("item_id", tag),
        }
        for name, df in rows.items():
            write(name, df, partition=["bucket"] if name == "terms" else None)
        told = self.store.read("postings").where((F.col("token") == LENGTH) & (F.col("segment") == number))
        write("lengths", told.select(F.col("id").alias("item_id"), "dl", "segment"))
        lengths = self.store.read("lengths").where(F.col("segment") == number)
        added = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("n_words"))
        if before is not None:
            added = added.select((F.col("n_docs") - before[0]).alias("n_docs"), (F.col("n_words") - before[1]).alias("n_words"))
        write("deltas", added.withColumn("segment", F.lit(number)))  # last: readers count a segment from here on

    def compact(self) -> None:
        """All live rows as one segment, and no tombstones; the segments before stay as the tables' versions before."""
        number = max(self.segments())
        tag = F.lit(number)
        live = {name: materialized(self.live(name).withColumn("segment", tag), name) for name in ("terms", "postings", "listing", "lengths")}
        totals = self.totals().withColumn("n_words", F.col("n_words").cast("long"))
        totals = materialized(totals.select("n_docs", "n_words").withColumn("segment", tag), "deltas")
        words = live["terms"].select("term").distinct().select(F.explode(grams(F.col("term"))).alias("gram"), "term", tag.alias("segment"))
        self.store.write("terms", live["terms"].withColumn("bucket", bucket()).repartition("bucket").sortWithinPartitions("bucket", "term"), partition=["bucket"])
        self.store.write("grams", _ranged(materialized(words, "grams"), "gram", "term"))
        self.store.write("postings", _ranged(live["postings"], "token", "id"))
        for name in ("listing", "lengths"):
            self.store.write(name, live[name])
        self.store.write("tombstones", self.store.read("tombstones").limit(0))
        self.store.write("deltas", totals)

    # reading

    def live(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """A table's rows, or those given of it, without the dead ones."""
        rows = self.store.read(name) if rows is None else rows
        rows = rows.where(F.col("token") != LENGTH) if name == "postings" else rows
        if len(self.store.manifest("deltas")["folders"]) == 1:  # one segment has no dead rows
            return rows
        key = "id" if name == "postings" else "item_id"
        dead = self.store.read("tombstones").groupBy(F.col("item_id").alias("_gone")).agg(F.max("segment").alias("_at"))
        return rows.join(dead, (F.col(key) == F.col("_gone")) & (F.col("segment") < F.col("_at")), "left_anti")

    def totals(self) -> DataFrame:
        """One row: n_docs, n_words and avgdl, from the deltas."""
        sums = self.store.read("deltas").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))
        return sums.withColumn("avgdl", F.col("n_words") / F.nullif(F.col("n_docs"), F.lit(0)))

    def rarest_gram(self, query: str) -> str | None:
        """The gram of the query with the fewest terms; None where the query names none."""
        asked = query_grams(query)
        if len(asked) < 2:
            return asked[0] if asked else None
        counts = dict(self.store.read("grams").where(F.col("gram").isin(asked)).groupBy("gram").count().collect())  # a row a gram of the query
        return min(asked, key=lambda g: (counts.get(g, 0), g))

    def matching_terms(self, query: str) -> DataFrame:
        """(bucket, term) of the distinct terms that hold the query, by the rows of its rarest gram."""
        gram = self.rarest_gram(query)
        rows = self.store.read("grams")
        rows = rows.where(F.col("gram") == gram) if gram is not None else rows
        return rows.where(search.contains_ci("term", query)).select("term").distinct().select(bucket().alias("bucket"), "term")

    def hits(self, query: str) -> DataFrame:
        """The live rows of ``terms`` whose term holds the query."""
        terms = self.store.read("terms")
        return self.live("terms", terms.join(self.matching_terms(query), ["bucket", "term"]))

    def term_search(self, query: str, *, item_type: str | None = None, k: int = 100, listing: DataFrame | None = None) -> DataFrame:
        """``search.term_search`` from the index."""
        return search.term_search(self.hits(query.lower()), self.live("listing") if listing is None else listing, query, item_type=item_type, k=k)

    def bm25(self, query: str) -> DataFrame:
        """``search.bm25`` from the live postings and the totals."""
        return search.scored_postings(lambda want: self.live("postings", self.store.read("postings").where(want)), self.totals(), query)

    def bm25_of(self, queries: DataFrame, k: int) -> DataFrame:
        """``bm25`` of all ``queries(query_id, query)`` in one plan: (query_id, id, bm25, place), the best k of each, ties by id.

        Ids of queries are distinct; a null query, and one without words, finds nothing. Scores are rounded to nine places, so
        that ties are ties. Words are joined to the postings of the live items: a phrase's places are moved to where it
        would begin and met within (query, item); one ASCII word stands for the words that begin with it, met by their
        beginnings of the lengths asked for. The best are ranked in each task before they are shuffled by query.
        """
        words = materialized(queries.where("query is not null").select("query_id", "query", search.tokens("query").alias("words")).where(F.size("words") > 0), "queries")
        alone = F.col("query").rlike(r"\A[A-Za-z0-9]+\z")
        postings = self.live("postings").select("token", "id", "dl", "places")

        begins = words.where(alone).select("query_id", F.get("words", F.lit(0)).alias("beginning"))
        lengths = [r[0] for r in begins.select(F.length("beginning")).distinct().collect()]  # a number a length
        runs = F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.substring(F.col("token"), F.lit(1), n))))
        tokens = _small(materialized(postings.select("token").distinct().select("token", runs.alias("beginning")).join(begins, "beginning").select("query_id", "token"), "begun"))
        by_beginning = postings.join(tokens, "token").groupBy("query_id", "id", "dl").agg(F.sum(F.size("places")).alias("f"))

        each = words.where(~alone).select("query_id", F.size("words").alias("n"), F.posexplode("words").alias("offset", "token"))
        moved = postings.join(_small(each), "token").select("query_id", "n", "id", "dl", F.transform("places", lambda p: p - F.col("offset")).alias("starts"))
        # a group has as many rows as the phrase has words
        met = moved.groupBy("query_id", "n", "id", "dl").agg(F.collect_list("starts").alias("starts")).where(F.size("starts") == F.col("n"))
        first = F.get("starts", F.lit(0))
        begun = F.aggregate(F.slice("starts", F.lit(2), F.size("starts")), first, lambda a, b: F.array_intersect(a, b))
        by_phrase = met.select("query_id", "id", "dl", F.size(begun).cast("long").alias("f")).where("f > 0")

        hits = materialized(by_beginning.unionByName(by_phrase), "hits")
        counts = hits.groupBy("query_id").agg(F.count("*").alias("n_hit"))
        scored = hits.join(counts, "query_id").crossJoin(F.broadcast(self.totals().select("n_docs", "avgdl")))  # a single row
        scored = scored.select("query_id", "id", F.round(search.bm25_score(), 9).alias("bm25"))
        best = Window.partitionBy("query_id").orderBy("bm25", "id")
        return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _small(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """The rows of a written table, broadcast where they are few, so that what they meet needs no shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _ranged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
