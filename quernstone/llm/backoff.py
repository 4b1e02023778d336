"""Stupid-backoff language-model scores, from n-gram count tables partitioned by hash.

Documents are cut into chunks of about ``chunk_words`` words. A chunk's n-grams of each order, counted within the
chunk, are dealt to partitions by the range of their 64-bit hash; a partition adds up the counts of all chunks (its
part of the count table) and answers the chunks that asked with the counts elsewhere. Then each chunk scores its documents and sums
over their words. An n-gram costs one entry a chunk, however often it occurs, so no hot n-gram makes a hot partition,
and everything a task holds is bounded by a chunk or by ``part_ngrams``.

A document is scored against the rest of the corpus: its own occurrences are taken out of every count. With c the
counts left, order n and a = 0.4, S(w | context) = c(context w) / c(context) if c(context w) > 0, else a times the
score with a context one word shorter; the shortest is c(w) / N, or 1 / (N + 1) for a word that the rest lacks (N:
words of the rest). Contexts don't reach before the document. N-grams are known by their hash: among D distinct ones each
shares its hash with another with a probability of D / 2**64, 5e-8 at a million million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import alnum_words, n_partitions, stored

CHUNK = "chunk string, doc_ids array<long>, lengths array<int>, words binary, hashes binary"
ASKED = "bucket int, chunk string, n int, hashes binary, counts binary"
TOLD = "chunk string, n int, bucket int, counts binary"
BITS = 64  # of an n-gram's hash
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd; multiplies before each word of an n-gram is added


def _pack(values: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(values.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _planes(values: np.ndarray, kind: str = "<u8", level: int = 1) -> bytes:
    """Unsigned integers byte by byte, all lowest bytes first: high bytes that are mostly zero take no room."""
    return _pack(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, int(kind[2:])).T), level)


def _unplanes(data: bytes, kind: str = "<u8") -> np.ndarray:
    return np.ascontiguousarray(_unpack(data, "u1").reshape(int(kind[2:]), -1).T).view(kind).ravel()


def _short(hashes: np.ndarray, base: int) -> bytes:
    """Ascending hashes from ``base`` on, as steps."""
    return _planes(np.diff(hashes, prepend=np.uint64(base)))


def _long(data: bytes, base: int) -> np.ndarray:
    return np.cumsum(_unplanes(data), dtype=np.uint64) + np.uint64(base)


def _base(bucket: int, buckets: int) -> int:
    """The first hash of a bucket."""
    return (bucket << BITS) // buckets


def chunks(docs: DataFrame, chunk_words: int) -> DataFrame:
    """The words of ``docs(doc_id, text)`` as chunk-local numbers, and each chunk's word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        lengths: list[int] = []
        spelled: dict[bytes, int] = {}
        coded: list[np.ndarray] = []
        held = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, spelled, coded, held, seq
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in spelled], "<u8")
            words = np.concatenate(coded)
            order = np.argsort(-np.bincount(words, minlength=len(hashes)), kind="stable")  # common words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words, hashes = rank[words], hashes[order]
            row = [f"{TaskContext.get().partitionId()}-{seq}", ids, lengths, _planes(words, "<u4", 12), hashes.tobytes()]
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            ids, lengths, spelled, coded, held, seq = [], [], {}, [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in CHUNK.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                words = alnum_words(text.as_py())
                new = set(words).difference(spelled)
                spelled.update(zip(new, range(len(spelled), len(spelled) + len(new))))
                coded.append(np.fromiter(map(spelled.__getitem__, words), np.uint32, len(words)))
                ids.append(doc.as_py())
                lengths.append(len(words))
                held += len(words) + 1  # so that documents without words fill a chunk too
                if held >= chunk_words:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK)


class Chunk:
    """A chunk's words as hashes, and its n-grams of each order."""

    def __init__(self, lengths, words: bytes, hashes: bytes):
        self.lengths = np.array(lengths, np.int64)
        self.hash = np.frombuffer(hashes, "<u8")[_unplanes(words, "<u4")] if hashes else np.zeros(0, np.uint64)
        starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.place = (np.arange(len(self.hash)) - starts[self.doc]).astype(np.int32)  # of a word in its document

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places at which an n-gram ends, and its hash."""
        ends = np.flatnonzero(self.place >= n - 1).astype(np.int32)
        h = np.full(len(ends), n, np.uint64)
        for back in range(n - 1, -1, -1):
            h = (h * MIX) ^ self.hash[ends - back]
            h ^= h >> np.uint64(29)
        return ends, (h * MIX) >> np.uint64(64 - BITS)


def asked(chunked: DataFrame, order: int, buckets: int) -> DataFrame:
    """Each chunk's distinct n-grams with counts, sorted and cut by hash range into ``buckets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([_base(b, buckets) for b in range(1, buckets)], np.uint64)
        for batch in batches:
            for r in range(batch.num_rows):
                name, lengths, words, hashes = (batch.column(c)[r].as_py() for c in ("chunk", "lengths", "words", "hashes"))
                chunk = Chunk(lengths, words, hashes)
                for n in range(1, order + 1):
                    distinct, counts = np.unique(chunk.grams(n)[1], return_counts=True)
                    cuts = [0, *np.searchsorted(distinct, edges).tolist(), len(distinct)]
                    rows = [
                        (b, name, n, _short(distinct[x:y], _base(b, buckets)), _planes(counts[x:y], level=9))
                        for b, (x, y) in enumerate(zip(cuts, cuts[1:]))
                        if y > x
                    ]
                    if rows:
                        kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in ASKED.split(", ")]
                        )

    return chunked.mapInArrow(run, ASKED)


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Consecutive rows with equal first ``width`` values."""
    held: list[tuple] = []
    for batch in batches:
        for r in range(batch.num_rows):
            row = tuple(c[r].as_py() for c in batch.columns)
            if held and held[0][:width] != row[:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def told(requests: DataFrame, buckets: int) -> DataFrame:
    """How often every request's n-grams occur outside its chunk: one bucket and order of the count table after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            hashes = [_long(g[3], _base(g[0], buckets)) for g in group]
            _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            own = np.concatenate([_unplanes(g[4]) for g in group]).astype(np.int64)
            totals = np.bincount(inverse, weights=own.astype(float)).astype(np.int64)
            answer = totals[inverse] - own
            cuts = np.cumsum([len(h) for h in hashes])[:-1]
            rows = [(g[2], g[1], g[0], _planes(a, level=9)) for g, a in zip(group, np.split(answer, cuts))]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary()]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), kinds)], names=[c.split()[0] for c in TOLD.split(", ")]
                )

    dealt = requests.select("bucket", "n", "chunk", "hashes", "counts").repartition(buckets, "bucket")
    return dealt.sortWithinPartitions("bucket", "n", "chunk").mapInArrow(run, TOLD)


def score_chunk(chunk: Chunk, order: int, counts: dict[int, np.ndarray], total: int, alpha: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log score of each document by the counts outside the chunk, and how many of its words each order scored (the last: not seen elsewhere)."""
    n_docs = len(chunk.lengths)
    rest = total - chunk.lengths[chunk.doc]
    left = {}
    for n in range(1, order + 1):
        ends, hashes = chunk.grams(n)
        distinct, inverse, here = np.unique(hashes, return_inverse=True, return_counts=True)
        del hashes
        owner = chunk.doc[ends].astype(np.int64) * max(len(distinct), 1) + inverse
        every = (counts.pop(n).astype(np.int64) + here)[inverse] if len(ends) else np.zeros(0, np.int64)
        del distinct, inverse, here
        _, which, own = np.unique(owner, return_inverse=True, return_counts=True)
        left[n] = np.zeros(len(chunk.hash), np.int64)
        left[n][ends] = every - own[which]
        del owner, which, own, every
    log = np.zeros(len(chunk.hash))
    undone = np.ones(len(chunk.hash), bool)
    used = []
    for n in range(order, 0, -1):
        now = undone & (left[n] > 0) & (chunk.place >= n - 1)
        at = np.flatnonzero(now)
        below = left[n - 1][at - 1] if n > 1 else rest[at]
        backed = np.minimum(order, chunk.place[at] + 1) - n  # steps down from the longest context there is
        log[at] = np.log(left[n][at] / below) + backed * np.log(alpha)
        undone[at] = False
        used.append(np.bincount(chunk.doc[at], minlength=n_docs))
    at = np.flatnonzero(undone)
    log[at] = -np.log(rest[at] + 1.0) + (np.minimum(order, chunk.place[at] + 1) - 1) * np.log(alpha)
    used.append(np.bincount(chunk.doc[at], minlength=n_docs))
    return np.bincount(chunk.doc, weights=log, minlength=n_docs), used


def score(docs: DataFrame, *, order: int = 3, alpha: float = 0.4, chunk_words: int = 3 << 20, part_ngrams: int = 3 << 20) -> DataFrame:
    """Stupid-backoff score of each row of ``docs(doc_id, text)`` against all other rows.

    Words are lower-cased runs of letters and digits. Returns doc_id, n_words, log_score (summed over the words),
    mean_log_score (null without words), n_seen (words scored at the full order) and n_unseen (words the rest of the
    corpus lacks). Null and empty texts have no words and score 0; repeated rows count for each other; an empty table
    gives no rows; other columns are ignored.
    """
    chunked = stored(chunks(docs, chunk_words), "chunks")
    total = chunked.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(n_partitions(docs.sparkSession), -(-total * order // part_ngrams))
    answers = told(asked(chunked, order, buckets), buckets)

    none = F.lit(None)
    left = chunked.select("chunk", F.lit(0).alias("n"), F.lit(0).alias("bucket"), F.col("words").alias("data"), "hashes", "doc_ids", "lengths")
    right = answers.select(
        "chunk", "n", "bucket", F.col("counts").alias("data"), none.cast("binary").alias("hashes"),
        none.cast("array<long>").alias("doc_ids"), none.cast("array<int>").alias("lengths"),
    )
    out = "doc_id long, n_words long, log_score double, n_seen long, n_unseen long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            _, _, _, words, hashes, doc_ids, lengths = group[0]
            chunk = Chunk(lengths, words, hashes)
            counts = {n: np.concatenate([np.zeros(0, "<u8"), *(_unplanes(g[3]) for g in group[1:] if g[1] == n)]) for n in range(1, order + 1)}
            log, used = score_chunk(chunk, order, counts, total, alpha)
            columns = [pa.array(doc_ids, pa.int64()), pa.array(chunk.lengths), pa.array(log), pa.array(used[0].astype(np.int64)), pa.array(used[-1].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in out.split(", ")])

    met = left.unionByName(right).repartition(n_partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk", "n", "bucket")
    return met.mapInArrow(run, out).withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
