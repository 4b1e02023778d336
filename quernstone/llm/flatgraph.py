"""Embedding near-duplicates by a robust-pruned flat graph, searched in ranges.

Equal vectors are one node. Nodes go to their two nearest regions, clusters whose centres are fitted on a bounded sample; Spark
partitions by region, and a region of more than ``block`` nodes is cut into pairs of blocks. In a region nodes are dealt to
overlapping cluster shards, each node to its two nearest. A shard gives each node a candidate list - its nearest nodes and some
drawn from the whole shard - which is pruned robustly (a candidate goes when one already kept is nearer to it, by ``ALPHA``,
than the node is) into a short list of near and far neighbours; lists are joined by their reverse edges, and a node's lists from
its shards are united. Every node is then a query: a greedy search enters at the medoids of the shards nearest to it, and from each
node within range the search is expanded over neighbours until no new one is in range. What is found is verified in
double precision, and links found from either end count once, in the least region that both nodes share.

A hot group, where many nodes lie within a small angle of one of a bounded sample of pivots, doesn't enter the regions: by
the triangle inequality all its nodes are linked with each other, and with any vector whose angle to the pivot is small enough,
so its links are counted without comparing them; only vectors between the bounds are compared, chunk by chunk.

The links of a bounded sample of nodes are counted by brute force over all; where less than ``RECALL`` of them were found, the search
is done again with twice the beam.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import n_partitions, stored
from quernstone.llm.components import connected_components

REGION, BLOCK = 8192, 16384  # nodes of a region aimed at, and of a block at most
MOST_REGIONS, FIT_ROWS = 4096, 32768  # bounds of the fit
SHARD = 1024  # nodes of a shard aimed at; each node is in two
NEAR, FAR, DEGREE, ALPHA = 24, 8, 16, 1.2
BEAM, WIDTH, ENTRIES, QUERIES = 24, 4, 3, 512
PIVOTS, HOT, CHUNK = 256, 4096, 1024
AUDIT, RECALL = 1024, 0.9
EPS, LOOSE = 1e-9, 1e-5  # of a double's bound; of a single's dot product


def centres_of(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Unit centres of k clusters of unit vectors, beginning with evenly spaced rows; an empty cluster keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[at : at + 4096] @ centres.T, axis=1) for at in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-30), centres)
    return centres


def nearest_two(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The two nearest centres of each vector, -1 for a second where there is one centre alone."""
    dots = vectors @ centres.T
    if dots.shape[1] == 1:
        return np.column_stack([np.zeros(len(dots), np.int64), np.full(len(dots), -1)])
    two = np.argpartition(-dots, 1, axis=1)[:, :2]
    swap = dots[np.arange(len(dots)), two[:, 0]] < dots[np.arange(len(dots)), two[:, 1]]
    two[swap] = two[swap][:, ::-1]
    return two


def pruned(vectors: np.ndarray, node: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning for each node of its candidates, nearest first; lists shorter than ``degree`` end in the node itself."""
    dots = np.einsum("bcd,bd->bc", vectors[candidates], vectors[node])
    order = np.argsort(-dots, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), 2 - 2 * np.take_along_axis(dots, order, 1)
    between = 2 - 2 * np.matmul(vectors[candidates], vectors[candidates].transpose(0, 2, 1))
    alive = candidates != node[:, None]
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    out, rows = np.repeat(node[:, None], degree, 1), np.arange(len(node))
    for slot in range(degree):
        first = np.argmax(alive, axis=1)
        has = alive[rows, first]
        if not has.any():
            break
        out[has, slot] = candidates[rows, first][has]
        alive &= ALPHA * ALPHA * between[rows, first] > far
        alive[rows, first] = False
    return out


class Graph:
    """A region's graph: unit vectors, united adjacency lists, and the medoids and centres of its shards."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.exact, self.vectors = vectors, vectors.astype(np.float32)
        n, rng = len(vectors), np.random.default_rng(seed)
        self.centres = centres_of(self.vectors, max(1, -(-2 * n // SHARD)), rounds=3)
        two = np.concatenate([nearest_two(self.vectors[at : at + 4096], self.centres) for at in range(0, n, 4096)])
        heads, tails, medoids = [], [], []
        for s in range(len(self.centres)):
            member = np.flatnonzero((two == s).any(axis=1))
            if not len(member):
                medoids.append(-1)
                continue
            medoids.append(int(member[np.argmax(self.vectors[member] @ self.centres[s])]))
            lists = self._shard(member, rng)
            heads.append(np.repeat(member, lists.shape[1])), tails.append(lists.ravel())
        kept = np.array(medoids) >= 0
        self.medoids, self.centres = np.array(medoids)[kept], self.centres[kept]
        self.adjacency = self._united(np.concatenate(heads), np.concatenate(tails))

    def _shard(self, member: np.ndarray, rng) -> np.ndarray:
        """Pruned lists of a shard's nodes: three quarters of each from its nearest, one from nodes all over the shard."""
        own, out = self.vectors[member], []
        near, most = min(NEAR, len(member) - 1), 3 * DEGREE // 4
        for at in range(0, len(member), QUERIES):
            part = member[at : at + QUERIES]
            dots = own[at : at + QUERIES] @ own.T
            dots[np.arange(len(part)), at + np.arange(len(part))] = -np.inf
            closest = member[np.argpartition(-dots, near - 1, axis=1)[:, :near]] if near else part[:, None]
            drawn = member[rng.integers(0, len(member), (len(part), FAR))]
            out.append(np.hstack([pruned(self.vectors, part, closest, most), pruned(self.vectors, part, drawn, DEGREE - most)]))
        return np.concatenate(out)

    def _united(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """All lists of a node and the edges that lead to it, once each, as one array padded with the node itself. Of the
        edges that lead to it at most ``2 * DEGREE`` are kept, drawn by hash."""
        n = len(self.vectors)
        ahead = np.unique(head[head != tail] * n + tail[head != tail])
        back = np.unique(ahead % n * n + ahead // n)
        back = back[np.lexsort(((back % n) * 2654435761 % 4294967296, back // n))]
        first = np.searchsorted(back // n, back // n)
        both = np.unique(np.concatenate([ahead, back[np.arange(len(back)) - first < 2 * DEGREE]]))
        node, other = both // n, both % n
        place = np.arange(len(both)) - np.searchsorted(node, node)
        lists = np.repeat(np.arange(n)[:, None], max(1, int(place.max(initial=0)) + 1), 1)
        lists[node, place] = other
        return lists

    def search(self, queries: np.ndarray, cosine: float, beam: int) -> np.ndarray:
        """For each of the nodes ``queries`` which nodes were found with at least the cosine, itself out: a boolean matrix."""
        n, m, x = len(self.vectors), len(queries), self.vectors[queries]
        seen, hit = np.zeros((m, n), bool), np.zeros((m, n), bool)
        at, low = np.arange(m), cosine - LOOSE
        seen[at, queries] = True
        entries = min(ENTRIES, len(self.medoids))
        ids = self.medoids[np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :entries]]
        ids, dots = self._met(ids, at, x, seen)
        self._mark(hit, at, ids, dots, low)
        ids, dots = np.pad(ids, ((0, 0), (0, beam))), np.pad(dots, ((0, 0), (0, beam)), constant_values=-np.inf)
        spent = np.isneginf(dots)
        while len(at):
            open_dots = np.where(spent, -np.inf, dots)
            pick = np.argpartition(-open_dots, WIDTH - 1, axis=1)[:, :WIDTH]
            live = ~np.isneginf(np.take_along_axis(open_dots, pick, 1))
            go = live.any(axis=1)
            at, ids, dots, spent, pick, live = at[go], ids[go], dots[go], spent[go], pick[go], live[go]
            if not len(at):
                break
            np.put_along_axis(spent, pick, True, 1)
            taken = np.where(live, np.take_along_axis(ids, pick, 1), self.medoids[0])
            found, near = self._met(self.adjacency[taken].reshape(len(at), -1), at, x[at], seen)
            self._mark(hit, at, found, near, low)
            ids, dots = np.hstack([ids, found]), np.hstack([dots, near])
            spent = np.hstack([spent, np.isneginf(near)])
            best = np.argpartition(-dots, beam - 1, axis=1)[:, :beam]
            ids, dots, spent = (np.take_along_axis(a, best, 1) for a in (ids, dots, spent))
        self._expand(hit, seen, x, low)
        q, node = np.nonzero(hit)
        for begin in range(0, len(q), 1 << 16):  # verified in double precision
            a, b = q[begin : begin + (1 << 16)], node[begin : begin + (1 << 16)]
            hit[a, b] = np.einsum("ij,ij->i", self.exact[queries[a]], self.exact[b]) >= cosine
        return hit

    def _met(self, ids: np.ndarray, at: np.ndarray, x: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dot products of nodes not yet seen, each once; minus infinity for others."""
        ids = np.sort(ids, axis=1)
        new = ~seen[at[:, None], ids]
        new[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        r, c = np.nonzero(new)
        dots = np.full(ids.shape, -np.inf, np.float32)
        seen[at[r], ids[r, c]] = True
        for begin in range(0, len(r), 1 << 16):
            a, b = r[begin : begin + (1 << 16)], c[begin : begin + (1 << 16)]
            dots[a, b] = np.einsum("ij,ij->i", self.vectors[ids[a, b]], x[a])
        return ids, dots

    @staticmethod
    def _mark(hit: np.ndarray, at: np.ndarray, ids: np.ndarray, dots: np.ndarray, low: float) -> None:
        r, c = np.nonzero(dots >= low)
        hit[at[r], ids[r, c]] = True

    def _expand(self, hit: np.ndarray, seen: np.ndarray, x: np.ndarray, low: float) -> None:
        """From all nodes in range on to their neighbours, until no new one is in range."""
        n = len(self.vectors)
        q, node = np.nonzero(hit)
        while len(q):
            next_q, next_node = [], []
            for begin in range(0, len(q), 1 << 14):
                a, lists = q[begin : begin + (1 << 14)], self.adjacency[node[begin : begin + (1 << 14)]]
                r, c = np.nonzero(~seen[a[:, None], lists])
                key = np.unique(a[r] * n + lists[r, c])
                a, b = key // n, key % n
                seen[a, b] = True
                for start in range(0, len(a), 1 << 16):
                    s, t = a[start : start + (1 << 16)], b[start : start + (1 << 16)]
                    ok = np.einsum("ij,ij->i", self.vectors[t], x[s]) >= low
                    next_q.append(s[ok]), next_node.append(t[ok])
            q, node = (np.concatenate(next_q), np.concatenate(next_node)) if next_q else (q[:0], node[:0])
            hit[q, node] = True


def linked(vectors: np.ndarray, cosine: float, beam: int) -> np.ndarray:
    """The links found among unit vectors, from either end, as a matrix of bits (rows packed to bytes)."""
    graph, n = Graph(vectors), len(vectors)
    bits = np.zeros((n, -(-n // 8)), np.uint8)
    for at in range(0, n, QUERIES):
        bits[at : at + QUERIES] = np.packbits(graph.search(np.arange(at, min(n, at + QUERIES)), cosine, beam), axis=1)
    for at in range(0, n, 2048):
        across = np.unpackbits(bits[at : at + 2048], axis=1, count=n)
        for to in range(at, n, 2048):
            there = np.unpackbits(bits[to : to + 2048], axis=1, count=n)[:, at : at + 2048]
            both = across[:, to : to + 2048] | there.T
            across[:, to : to + 2048] = both
            other = np.unpackbits(bits[to : to + 2048], axis=1, count=n)
            other[:, at : at + 2048] = both.T
            bits[to : to + 2048] = np.packbits(other, axis=1)
    return bits


FOUND = "a long, b long, links long"


def region_links(ids, copies, others, block, vectors, region: int, i: int, j: int, cosine: float, beam: int) -> tuple[list, list, list]:
    """Links of a region's group of blocks: counts (node, null, links) and the edges of a spanning forest (a, b, null).

    A pair counts in the least region that both share, and there in the one group of blocks that holds it.
    """
    bits, n = linked(vectors, cosine, beam), len(ids)
    root, links, a, b = np.arange(n), np.zeros(n, np.int64), [], []
    for k in range(n):
        to = np.flatnonzero(np.unpackbits(bits[k], count=n))
        elsewhere = (others[to] == others[k]) & (others[k] >= 0) & (others[k] < region)
        here = ~elsewhere & ((block[to] != block[k]) if i != j else True)
        links[k] = copies[to][here].sum()
        touched = np.unique(root[to[to < k]])
        if len(touched):
            a += [int(ids[k])] * len(touched)
            b += ids[touched].tolist()
            if len(touched) > 1:
                root[:k][np.isin(root[:k], touched)] = touched[0]
            root[k] = touched[0]
    some = np.flatnonzero(links)
    return ids[some].tolist() + a, [None] * len(some) + b, links[some].tolist() + [None] * len(a)


def units(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of raw bytes as unit vectors in double precision."""
    raw = np.stack([np.frombuffer(v, kind) for v in column.to_pylist()]).astype(float)
    raw /= np.abs(raw).max(axis=1, keepdims=True)  # keeps squares of the largest and least numbers finite
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


class Balls:
    """Hot groups: their pivots' unit vectors and nodes, and of each the widest angle to a member and the rows it holds."""

    def __init__(self, pivots: np.ndarray, cosine: float):
        self.pivots, self.reach = pivots, math.acos(cosine)
        self.width = self.reach / 2 * 0.99
        self.radius, self.rows = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1, 1))

    def own(self, angles: np.ndarray) -> np.ndarray:
        """The first ball that holds each vector, -1 without one."""
        inside = angles <= self.width
        return np.where(inside.any(axis=1), np.argmax(inside, axis=1), -1) if inside.shape[1] else np.full(len(angles), -1)


def comparable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, usable): whether the row takes part. v keeps the table's floats or doubles; -0.0 reads as 0.0."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    v = F.transform("embedding", lambda x: x.cast(kind if kind == "float" else "double") + F.lit(0).cast(kind if kind == "float" else "double"))
    rows = vectors.select("vec_id", v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    ok = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    sizes = rows.where(ok).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.withColumn("usable", ok & (F.size("v") == (sizes[0] if sizes else -1)))


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, d1, d2, least, copies, raw): equal vectors as one, told by 128 bits of hash."""
    told = rows.select("vec_id", "v", F.xxhash64("v").alias("d1"), F.xxhash64(F.lit(1), "v").alias("d2"))
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind)
            width = len(flat) // max(1, batch.num_rows)
            raw = pa.array([r.tobytes() for r in flat.reshape(-1, width)], pa.binary()) if width else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([raw, *batch.columns[1:]], names=["raw", "vec_id", "d1", "d2"])

    packed = told.select("v", "vec_id", "d1", "d2").mapInArrow(pack, "raw binary, vec_id long, d1 long, d2 long")
    grouped = packed.groupBy("d1", "d2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    return stored(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _sample(nodes: DataFrame, total: int, count: int, kind: str, salt: int) -> tuple[list[int], np.ndarray]:
    """At most ``count`` of ``total`` nodes by hash; a share by hash first, so that few are sorted."""
    place = F.xxhash64(F.lit(salt), "d1", "d2")
    part = nodes.where(F.pmod(place, F.lit(1 << 31)) < min(1.0, 2 * count / total) * (1 << 31)) if total > 2 * count else nodes
    some = part.orderBy(place, "d1", "d2").limit(count).select("node", "raw").collect()
    return [r[0] for r in some], units(pa.array([r[1] for r in some], pa.binary()), kind) if some else np.empty((0, 0))


def hot_balls(nodes: DataFrame, total: int, cosine: float, kind: str, hot: int) -> Balls:
    """The hot groups around a bounded sample of pivots: those that hold more than ``hot`` nodes."""
    balls = Balls(_sample(nodes, total, PIVOTS, kind, 3)[1], cosine)

    def measured(balls: Balls) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    angles = balls.angles(units(batch.column(0), kind))
                    own = balls.own(angles)
                    at = np.flatnonzero(own >= 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[at]), pa.array(angles[at, own[at]]), batch.column(1).take(pa.array(at))], names=["ball", "angle", "copies"]
                    )

        found = nodes.select("raw", "copies").mapInArrow(run, "ball long, angle double, copies long")
        return found.groupBy("ball").agg(F.count("*"), F.max("angle"), F.sum("copies")).collect()  # a row a pivot

    large = sorted(r[0] for r in measured(balls) if r[1] > hot)
    kept = Balls(balls.pivots[large], cosine)
    if large:
        for ball, _, radius, rows in measured(kept):  # without the other pivots a ball may hold more
            kept.radius[ball], kept.rows[ball] = radius + EPS, rows
    return kept


def ball_links(nodes: DataFrame, balls: Balls, cosine: float, kind: str) -> DataFrame:
    """Links (a, b, links) of hot groups: among their nodes, with each other and with all other nodes. The edges lead to -1
    less the ball's number, a node of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angles, ids = balls.angles(units(batch.column(1), kind)), batch.column(0).to_numpy()
            copies, own = batch.column(2).to_numpy(), balls.own(angles)
            mine = own[:, None] == np.arange(len(balls.pivots))
            sure = ~mine & (angles + balls.radius + EPS <= balls.reach)
            open_ = ~mine & ~sure & (angles - balls.radius - EPS <= balls.reach)
            links = ((mine | sure) * balls.rows).sum(axis=1) - np.where(own >= 0, copies, 0)
            r, c = np.nonzero(mine | sure)
            loose = sure & (own < 0)[:, None]
            k, g = np.nonzero(loose)
            o, p = np.nonzero(open_)
            some = np.flatnonzero(links)
            # kinds: a count, an edge, rows that a ball's members gain, and a vector to compare with a ball's members
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(some), 0), np.full(len(r), 1), np.full(len(k), 2), np.full(len(o), 3)])),
                    pa.array(np.concatenate([ids[some], ids[r], -1 - g, ids[o]])), pa.array(np.concatenate([np.full(len(some), -1), c, g, p])),
                    pa.array(np.concatenate([links[some], np.zeros(len(r), np.int64), copies[k], np.where(own[o] < 0, copies[o], 0)])),
                ],
                names=["kind", "node", "ball", "n"],
            )

    told = stored(nodes.select("node", "raw", "copies").mapInArrow(run, "kind long, node long, ball long, n long"), "balls")
    counts = told.where("kind = 0").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.col("n").alias("links"))
    edges = told.where("kind = 1").select(F.col("node").alias("a"), (-1 - F.col("ball")).alias("b"), F.lit(None).cast("long").alias("links"))
    gains = told.where("kind = 2").groupBy("ball").agg(F.sum("n").alias("links"))
    member = _members(nodes, balls, kind)
    gained = member.join(gains, "ball").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "links")
    return counts.unionByName(edges).unionByName(gained).unionByName(_compared(told.where("kind = 3"), nodes, member, cosine, kind))


def _members(nodes: DataFrame, balls: Balls, kind: str) -> DataFrame:
    """(node, ball, copies, raw) of the hot groups' nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = balls.own(balls.angles(units(batch.column(2), kind)))
                at = pa.array(np.flatnonzero(own >= 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(own).take(at), batch.column(1).take(at), batch.column(2).take(at)], names=["node", "ball", "copies", "raw"])

    return stored(nodes.select("node", "copies", "raw").mapInArrow(run, "node long, ball long, copies long, raw binary"), "members")


def _compared(open_: DataFrame, nodes: DataFrame, member: DataFrame, cosine: float, kind: str) -> DataFrame:
    """Vectors that no bound decides, compared with a ball's members: chunks of either side are joined and multiplied."""
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHUNK)).cast("long")

    def chunked(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("ball").agg(F.count("*").alias("size"))
        told = rows.join(sizes, "ball").withColumn("chunk", chunk)
        return told.groupBy("ball", "chunk").agg(F.collect_list(F.struct("node", "copies", "raw")).alias(name)).drop("chunk")

    asked = open_.select("node", "ball", F.col("n").alias("copies")).join(nodes.select("node", "raw"), "node")
    pairs = chunked(asked, "asked").join(chunked(member, "held"), "ball")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column(0), batch.column(1)):
                x, y = (units(part.values.field("raw"), kind) for part in (asked, held))
                ids, own = (part.values.field("node").to_numpy() for part in (asked, held))
                weight, copies = (part.values.field("copies").to_numpy() for part in (asked, held))
                near = x @ y.T >= cosine
                links, gains, any_ = near @ copies, weight @ near, np.flatnonzero(near.any(axis=1))
                some, gain = np.flatnonzero(links), np.flatnonzero(gains)
                a = np.concatenate([ids[some], own[gain], ids[any_]])
                n = len(some) + len(gain)
                b = [None] * n + own[np.argmax(near[any_], axis=1)].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*links[some].tolist(), *gains[gain].tolist(), *[None] * len(any_)], pa.int64())], names=["a", "b", "links"]
                )

    return pairs.select("asked", "held").mapInArrow(run, FOUND)


def routed(nodes: DataFrame, centres: np.ndarray, balls: Balls, kind: str) -> DataFrame:
    """(region, other, node, copies, raw): each node outside the hot groups in its two nearest regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = units(part.column(2), kind)
                two = nearest_two(x, centres)
                loose = balls.own(balls.angles(x)) < 0 if len(balls.pivots) else np.ones(len(x), bool)
                for mine, other in ((0, 1), (1, 0)):
                    keep = pa.array(np.flatnonzero(loose & (two[:, mine] >= 0)))
                    yield pa.RecordBatch.from_arrays([pa.array(two[:, mine]).take(keep), pa.array(two[:, other]).take(keep), *(c.take(keep) for c in part.columns)], names=["region", "other", "node", "copies", "raw"])

    return nodes.select("node", "copies", "raw").mapInArrow(run, "region long, other long, node long, copies long, raw binary")


def graph_links(nodes: DataFrame, centres: np.ndarray, balls: Balls, cosine: float, kind: str, *, beam: int, block: int) -> DataFrame:
    """Links (a, b, links) that the regions' graphs find."""
    rows = stored(routed(nodes, centres, balls, kind), "regions")
    sizes = rows.groupBy("region").agg(F.ceil(F.count("*") / block).alias("blocks"))  # at most a row a region
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = rows.join(F.broadcast(sizes), "region").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = ["region", "i", "j"]
    dealt = dealt.select("region", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "other", "node", "copies", "raw")
    # a pair of blocks compares within itself, too, where both are the same
    ordered = dealt.repartition(max(n_partitions(nodes.sparkSession), 1), *group).sortWithinPartitions(*group, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done():
            table = pa.Table.from_batches(held)
            ids, copies, others, own = (table.column(c).to_numpy() for c in ("node", "copies", "other", "own"))
            a, b, n = region_links(ids, copies, others, own, units(table.column("raw"), kind), *key, cosine, beam)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])

        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:]):
                if y > x:
                    if key is not None and key != tuple(keys[x].tolist()):
                        yield done()
                        held = []
                    key = tuple(keys[x].tolist())
                    held.append(batch.slice(x, y - x))
        if held:
            yield done()

    return stored(ordered.mapInArrow(run, FOUND), "links")


def audited(nodes: DataFrame, total: int, counted: DataFrame, cosine: float, kind: str, sample: int) -> float:
    """The share of the links of a bounded sample of nodes, counted by brute force over all nodes, that were found."""
    ids, asked = _sample(nodes, total, sample, kind, 5)
    if not ids:
        return 1.0
    place = np.array(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(place), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = units(batch.column(1), kind) @ asked.T >= cosine
                near &= batch.column(0).to_numpy()[:, None] != place
                total += batch.column(2).to_numpy() @ near
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total)], names=["node", "truth"])

    truth = nodes.select("node", "raw", "copies").mapInArrow(run, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    both = truth.join(counted, "node", "left").agg(F.sum("truth"), F.sum(F.least(F.coalesce("links", F.lit(0)), "truth"))).first()
    return both[1] / both[0] if both[0] else 1.0


def near_duplicates(
    vectors: DataFrame, *, cosine: float = 0.9, region: int = REGION, block: int = BLOCK, hot: int = HOT, audit: int = AUDIT, recall: float = RECALL
) -> DataFrame:
    """A row for each row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept and audited_recall.

    Links have a cosine of at least ``cosine``; vectors that are null, zero, hold a null or non-finite component, are not of the
    commonest length, or have a null vec_id link with nothing and are components of their own. Equal vectors link, and
    repeated rows are vectors of their own (equal vec_ids share their component). kept tells the rows whose vec_id is that of
    their component, null vec_ids among them. An empty table gives no rows. Other columns are ignored.
    """
    told = comparable(vectors)
    rows = told.where("usable")
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    nodes = _nodes(rows)
    total = nodes.count()
    labels, share = vectors.sparkSession.createDataFrame([], "d1 long, d2 long, links long, component_id long"), 1.0
    if total:
        regions = min(MOST_REGIONS, -(-total // region))
        centres = centres_of(_sample(nodes, total, min(FIT_ROWS, 64 * regions), kind, 1)[1], regions)
        balls, beam = hot_balls(nodes, total, cosine, kind, hot), BEAM
        held = stored(ball_links(nodes, balls, cosine, kind), "ball-links") if len(balls.pivots) else None
        while True:
            found = graph_links(nodes, centres, balls, cosine, kind, beam=beam, block=block)
            found = found if held is None else found.unionByName(held)
            counted = stored(found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "counted")
            share = audited(nodes, total, counted, cosine, kind, audit)
            if share >= recall or beam >= 8 * BEAM:
                break
            beam *= 2
        joined = connected_components(found.where("b is not null").select("a", "b"))
        labelled = nodes.join(joined, "node", "left").join(counted, "node", "left")
        labelled = stored(
            labelled.select("d1", "d2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component")), "labelled"
        )
        least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
        labels = labelled.join(least, "component").select("d1", "d2", "links", "component_id")
    linked_rows = rows.select("vec_id", F.xxhash64("v").alias("d1"), F.xxhash64(F.lit(1), "v").alias("d2")).join(labels, ["d1", "d2"])
    alone = told.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked_rows.select("vec_id", F.col("links").alias("n_links"), "component_id").unionByName(alone)
    return both.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(share)).alias("audited_recall"))
