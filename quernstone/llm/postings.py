"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents, as search engines do it: a shard holds the documents a task meets, up to about
``shard_words`` words, and for each of its words the ascending list of positions at which it stands. Positions run
through the shard; a gap after each document keeps phrases from crossing. Shards are rows of a Parquet table, and each
is searched alone: the lists of a phrase's words, less the words' offsets, are intersected from the shortest on.

Test items go out in blocks whose byte size is checked before they are broadcast; a larger benchmark takes more passes
over the index, each over all shards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import alnum_words, shared_folder, stored

WINDOW = 13
BLOCK_BYTES = 8 << 20  # of test text in a broadcast block
GAP = 64  # unused positions after each document; proximity windows must be narrower
SLOP = 7  # words that a proximity match may have between those of the passage; at most GAP - WINDOW
INDEX_SCHEMA = "shard string, doc_ids array<long>, n_words array<long>, words binary, ends binary, positions binary"


class ShardIndex:
    """The postings of one shard."""

    def __init__(self, words: list[bytes], ends: np.ndarray, positions: np.ndarray):
        self.at = dict(zip(words, range(len(words))))
        self.ends, self.all = ends, positions

    def list_of(self, word: int) -> np.ndarray:
        return self.all[self.ends[word] : self.ends[word + 1]]

    def phrase(self, words: list[int]) -> np.ndarray:
        """Ascending positions at which the words stand one after another."""
        order = sorted(range(len(words)), key=lambda i: self.ends[words[i] + 1] - self.ends[words[i]])
        found = self.list_of(words[order[0]]) - order[0]
        for i in order[1:]:
            if not len(found):
                break
            with_it = self.list_of(words[i])
            place = np.searchsorted(with_it, found + i)
            place[place == len(with_it)] = 0
            found = found[with_it[place] == found + i]
        return found

    def near(self, words: list[int], span: int, known: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Positions of the rarest word that lie in a stretch of ``span + 1`` words with each of the words, in any order
        and as often as given. Of the positions that have each word at most ``span`` away, those ``known`` are left out."""
        times = Counter(words)
        order = sorted(times, key=lambda w: self.ends[w + 1] - self.ends[w])
        found = self.list_of(order[0])
        for w in order[1:]:
            if not len(found):
                break
            with_it = self.list_of(w)
            place = np.minimum(np.searchsorted(with_it, found - span), len(with_it) - 1)
            found = found[np.abs(with_it[place] - found) <= span]
        if known is not None and len(found):
            found = found[~known(found)]
        near = np.zeros(len(found), bool)
        for before in range(span + 1):  # the stretch begins so many words before the rarest one
            left = np.flatnonzero(~near)
            for w in order:
                if not len(left):
                    break
                begin, with_it = found[left] - before, self.list_of(w)
                last = np.searchsorted(with_it, begin) + times[w] - 1
                left = left[(last < len(with_it)) & (with_it[np.minimum(last, len(with_it) - 1)] <= begin + span)]
            near[left] = True
        return found[near]


def build_index(docs: DataFrame, path: str, *, shard_words: int = 1 << 20) -> None:
    """Write the positional index of ``docs(doc_id, text)`` to ``path``; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        ids: list = []
        counts: list[int] = []
        spelled: dict[bytes, int] = {}
        codes: list[np.ndarray] = []
        held = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, spelled, codes, held, seq
            n = np.array(counts, np.int64)
            starts = np.cumsum(n + GAP) - (n + GAP)
            code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            place = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(code))
            by_word = np.argsort(code, kind="stable")
            positions = place[by_word]
            ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(spelled)))])
            steps = np.diff(positions, prepend=0).astype(np.int32)
            shard = f"{TaskContext.get().partitionId()}-{seq}"
            row = [shard, ids, counts, pack(b" ".join(spelled)), pack(ends.astype("<i4").tobytes()), pack(steps.astype("<i4").tobytes())]
            kinds = [pa.string()] + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 3
            ids, counts, spelled, codes, held, seq = [], [], {}, [], 0, seq + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                words = alnum_words(text.as_py())
                new = set(words).difference(spelled)
                spelled.update(zip(new, range(len(spelled), len(spelled) + len(new))))
                codes.append(np.fromiter(map(spelled.__getitem__, words), np.int32, len(words)))
                ids.append(doc.as_py())
                counts.append(len(words))
                held += len(words) + GAP
                if held >= shard_words:
                    yield flush()
        if ids:
            yield flush()

    docs.select("doc_id", "text").mapInArrow(run, INDEX_SCHEMA).write.parquet(path)


def load_shard(words: bytes, ends: bytes, positions: bytes) -> ShardIndex:
    unpack = zstandard.ZstdDecompressor().decompress
    steps = np.frombuffer(unpack(positions), "<i4")
    return ShardIndex(unpack(words).split(), np.frombuffer(unpack(ends), "<i4"), np.cumsum(steps, dtype=np.int64))


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items, (id as string, text), in blocks of at most ``block_bytes`` of text (or one item), one after another;
    an empty block where there are none. The driver holds a block at a time."""
    block: list[tuple[str, str]] = []
    size, any_block = 0, False
    for item, text in items.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        size += len(text.encode())
        if block and size > block_bytes:
            yield block
            block, size, any_block = [], len(text.encode()), True
        block.append((item, text))
    if block or not any_block:
        yield block


def search(spark, path: str, items: DataFrame, *, window: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact and proximity matches of the items in the index at ``path``, one row for each document.

    Columns: doc_id, n_words, hits (starts and ends of the covered word ranges, end exclusive), items (ids, as
    strings, with an exact window) and near (ids with a window whose words all stand within ``slop`` words more than
    they are, in any order; empty where slop is None). A document without matches has empty lists.
    """
    if slop is not None and window + slop > GAP:
        raise ValueError(f"window and slop together must not pass {GAP} words")
    passes = []
    for block in item_blocks(items, block_bytes):
        sent = spark.sparkContext.broadcast([(i, w) for i, t in block if (w := alnum_words(t))])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield _search_shard(row, sent.value, window, slop)

        passes.append(spark.read.schema(INDEX_SCHEMA).parquet(path).mapInArrow(run, MATCH_SCHEMA))
    if len(passes) == 1:
        return passes[0].drop("row")
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("row", "doc_id", "n_words").agg(
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")),
        *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")),
    )
    return merged.drop("row")


MATCH_SCHEMA = "row string, doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>, near array<string>"


def _search_shard(row: dict, items: list[tuple[str, list[bytes]]], window: int, slop: int | None) -> pa.RecordBatch:
    index = load_shard(row["words"], row["ends"], row["positions"])
    n = np.array(row["n_words"], np.int64)
    shift = np.cumsum(n + GAP) - (n + GAP)  # where each document begins
    starts: list[list[int]] = [[] for _ in n]
    ends: list[list[int]] = [[] for _ in n]
    exact: list[set[str]] = [set() for _ in n]
    close: list[set[str]] = [set() for _ in n]
    for item, words in items:
        codes = [index.at.get(w, -1) for w in words]
        length = min(window, len(words))
        for at in range(len(words) - length + 1):
            part = codes[at : at + length]
            if -1 in part:
                continue
            found = index.phrase(part)
            for d, p in zip((np.searchsorted(shift, found, "right") - 1).tolist(), found.tolist()):
                p -= int(shift[d])
                exact[d].add(item)
                if ends[d] and starts[d][-1] <= p <= ends[d][-1]:
                    ends[d][-1] = max(ends[d][-1], p + length)
                else:
                    starts[d].append(p)
                    ends[d].append(p + length)
            if slop is not None:
                for d in set((np.searchsorted(shift, found, "right") - 1).tolist()):
                    close[d].add(item)
                told = np.fromiter((item in c for c in close), bool, len(n))
                known = lambda at, told=told: told[np.searchsorted(shift, at, "right") - 1]
                for d in set((np.searchsorted(shift, index.near(part, length + slop - 1, known), "right") - 1).tolist()):
                    close[d].add(item)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
    columns = [[f"{row['shard']}-{i}" for i in range(len(n))], row["doc_ids"], row["n_words"], starts, ends, [sorted(x) for x in exact], [sorted(x) for x in close]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in MATCH_SCHEMA.split(", ")])


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, slop: int | None = None, share: int = 20, block_bytes: int = BLOCK_BYTES, shard_words: int = 1 << 20) -> DataFrame:
    """Contamination of each row of ``docs(doc_id, text)`` by ``items(item_id, text)``.

    A document word inside any occurrence of ``window`` consecutive item words (all words of a shorter item) is hit;
    a document is contaminated if at least one word in ``share`` is. Null texts have no words, items without words
    no windows, a null item_id reads as ''; repeated rows and ids stay rows of their own; an empty table on either side gives no hits. Returns
    doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits (covered word ranges), n_near and near (ids of the items with a proximity match, sorted; exact
    matches are among them). Proximity doesn't decide ``contaminated``.
    """
    path = shared_folder(docs.sparkSession, "postings")
    build_index(docs, path, shard_words=shard_words)
    found = search(docs.sparkSession, path, items, window=window, slop=slop, block_bytes=block_bytes)
    spans = F.array_sort(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))
    # cover: the words up to `to` are counted; each span adds what of it lies beyond
    hit = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"),
            F.greatest(a["to"], s["end"]).alias("to"),
        ),
        lambda a: a["n"],
    )
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        spans.alias("hits"),
        F.size("near").cast("long").alias("n_near"),
        F.array_sort("near").alias("near"),
    ).withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated. Contamination is a matter of the text, so texts go by their digest."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = stored(decontaminate(texts, items, **options).where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.alias("d").join(bad.alias("b"), F.xxhash64("d.text") == F.col("b.doc_id"), "left_anti")
