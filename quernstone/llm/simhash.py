"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints at most k = 4 bits apart are at most t = 2 bits apart in one of their 32-bit halves. The
anchors of a half are the codewords of the [31, 26] Hamming code on its upper 31 bits: a perfect code whose covering
radius is R = 1. Take two halves at most t apart and a word midway between them: the codeword nearest that word lies
within R of it, hence within R + t/2 = 2 of both. So it is enough to copy each fingerprint to every anchor within
the covering radius plus its share of the threshold - 16 of 67 million anchors a half - and to compare the
fingerprints that meet at an anchor on all 64 bits. No link is lost, and only distinct fingerprints are copied.

Anchors with more than ``block`` fingerprints are cut into blocks, and each pair of blocks is a group of its own, so no
task holds an unbounded group. A group gives the edges of a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import n_partitions, space_words, stored
from quernstone.llm.components import connected_components

SEED = 42
FIRST = np.uint64(0x8000000000000000)  # flips the sign bit so that signed longs order as unsigned ones


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority bits of the XXH64 of each ``width``-word shingle; 0 for a text without words."""
    words = space_words(text)
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    hashed = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip((ends - lengths).tolist(), ends[width - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 16):
        raw = np.array(hashed[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, digest and fp (the fingerprint as a signed long) of every row; null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], names=["doc_id", "digest", "fp"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(run, "doc_id long, digest long, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Hamming syndrome of 31-bit words: the XOR of the 1-based places of the set bits."""
    out = np.zeros(len(words), np.uint64)
    for place in range(1, 32):
        out ^= (words >> np.uint64(place - 1) & np.uint64(1)) * np.uint64(place)
    return out


def _pairs() -> np.ndarray:
    """For each syndrome, the error patterns of at most 2 bits with that syndrome; short rows repeat their last."""
    found: list[list[int]] = [[] for _ in range(32)]
    found[0].append(0)
    for p in range(1, 32):
        found[p].append(1 << (p - 1))
        for q in range(p + 1, 32):
            found[p ^ q].append(1 << (p - 1) | 1 << (q - 1))
    width = max(map(len, found))
    return np.array([row + row[-1:] * (width - len(row)) for row in found], np.uint64)


PAIRS = _pairs()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys (half << 31 | codeword) within distance 2, and the index of the fingerprint each belongs to."""
    keys, owners = [], []
    for half in (0, 1):
        words = fps >> np.uint64(32 * half + 1) & np.uint64(0x7FFFFFFF)
        s = syndromes(words)
        near = (words[:, None] ^ PAIRS[s.astype(np.int64)]) | np.uint64(half << 31)
        own = np.ones_like(near, bool)
        own[s == 0, 1:] = False  # a codeword has one anchor that near: itself
        keys.append(near[own])
        owners.append(np.broadcast_to(np.arange(len(fps))[:, None], near.shape)[own])
    return np.concatenate(keys).astype(np.int64), np.concatenate(owners)


def to_anchors(fps: DataFrame) -> DataFrame:
    """(anchor, fp) for every anchor near each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4096):
                some = values[at : at + 4096]
                keys, owners = anchors(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[owners])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(member, smallest of its component) for the links of at most ``distance`` bits among distinct fingerprints."""
    n = len(fps)
    root = np.arange(n)
    for i in range(1, n):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= distance)
        if len(near):
            touched = np.unique(root[near])
            least = touched[0]
            if len(touched) > 1:
                root[:i][np.isin(root[:i], touched)] = least
            root[i] = least
    signed = fps.view(np.int64)
    return [(int(signed[i]), int(signed[r])) for i, r in enumerate(root.tolist()) if r != i]


def links(fps: DataFrame, *, distance: int = 4, block: int = 2048) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints linked by at most ``distance`` (at most 4) bits."""
    if not 0 <= distance <= 4:
        raise ValueError("the anchors cover up to 4 differing bits")
    n = n_partitions(fps.sparkSession)
    at = Window.partitionBy("anchor")
    met = to_anchors(fps).repartition(n, "anchor").withColumn("members", F.count("fp").over(at)).where("members > 1")
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    grouped = (
        met.withColumn("blocks", blocks)
        .withColumn("own", own)
        .select("anchor", "fp", "own", other.alias("other"))
        .select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their group, which may go on in the next batch."""
        rest = None
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = rows if rest is None else np.concatenate([rest, rows])
            cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            rest = rows[cut[-1] :] if len(cut) else rows
            yield from found(np.split(rows[: cut[-1]], cut[:-1]) if len(cut) else [])
        if rest is not None:
            yield from found([rest])

    def found(groups) -> Iterator[pa.RecordBatch]:
        edges = [e for g in groups if len(g) > 1 for e in forest(np.ascontiguousarray(g[:, 3]).view(np.uint64), distance)]
        if edges:
            a, b = zip(*edges)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = grouped.repartition(n, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _components(distinct: DataFrame, distance: int, block: int) -> DataFrame:
    """``distinct`` (one row for each fingerprint ``fp``) and component, a fingerprint: its own where it has no links."""
    edges = stored(links(distinct, distance=distance, block=block), "links")
    joined = connected_components(edges)  # node, component; only of fingerprints with links
    labelled = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    return labelled.withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, *, width: int = 4, distance: int = 4, block: int = 2048) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, fingerprint, component_id and members.

    component_id is the smallest doc_id among all rows reachable over links of at most ``distance`` differing bits;
    a row without links is its own component. Null, empty and wordless texts share the fingerprint 0 and link with
    it like any other. Repeated rows are rows of their own. Null doc_ids take part, but name a component (null) only
    if it has no other. An empty table gives no rows. Other columns are ignored.
    """
    fps = stored(fingerprints(docs, width), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    labelled = _components(distinct, distance, block)
    groups = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members"))
    ids = stored(labelled.join(groups, "component").select("fp", "component_id", "members"), "components")
    return fps.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "members"
    )


def keep_one(docs: DataFrame, *, width: int = 4, distance: int = 4, block: int = 2048) -> DataFrame:
    """One row of ``docs`` for each component: the smallest doc_id (null last), then the smallest digest of the text.

    A fingerprint's own first row is found while its copies are counted as one, so that no join meets a row for each
    copy, and a component's by partial minima.
    """
    fps = fingerprints(docs, width).select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("row"))
    distinct = stored(fps.groupBy("fp").agg(F.min("row").alias("row")), "distinct")
    firsts = _components(distinct, distance, block).groupBy("component").agg(F.min("row").alias("row"))
    keep = stored(firsts.select("row.doc_id", "row.digest").distinct(), "kept")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.digest"))
    kept = docs.alias("d").join(keep.alias("k"), same, "left_semi")
    repeated = docs.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
