"""Token-ID output: one wavelet matrix per shard.

A wavelet matrix holds a token sequence as bit-planes, the most significant bit of each token's dense code first.
Each plane lists the tokens in the order that stably sorting by the planes above gives, so rank and select on the
planes answer access, counting and occurrence lookup without unpacking the sequence. Codes are positions in the
shard's own sorted alphabet, so a shard with 4,000 distinct ids takes 12 bits a token.

Documents are dealt by range of ``doc_id`` and encoded where they lie; a task writes a shard as soon as it holds
``shard_tokens`` ids, so memory is bounded by a shard and the longest document. Shards are binary rows of a Parquet
table: Spark's committer keeps the table whole when an executor is lost, and any file system Spark knows will do.
"""

from __future__ import annotations

import contextlib
import gc
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import n_partitions

MAGIC = b"QWM1"
BLOCK = 512  # bits between entries of the rank directory


class WaveletMatrix:
    """Succinct token sequence with access, rank, select and count; all positions count from 0."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.alphabet, self.zeros, self.planes, self.ranks = n, alphabet, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        alphabet, codes = _dense(ids)
        zeros, planes, ranks = [], [], []
        for shift in range(max(len(alphabet) - 1, 0).bit_length() - 1, -1, -1):
            bits = (codes >> shift & 1).astype(bool)
            packed = np.zeros(-(-n // BLOCK) * (BLOCK // 8), np.uint8)
            packed[: -(-n // 8)] = np.packbits(bits, bitorder="little")
            ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
            planes.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            low = np.compress(~bits, codes)
            zeros.append(len(low))
            codes = np.concatenate([low, np.compress(bits, codes)])
        return cls(n, alphabet, zeros, planes, ranks)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK)
        at = block * (BLOCK // 8)
        word = int.from_bytes(self.planes[level][at : at + BLOCK // 8].tobytes(), "little")
        return int(self.ranks[level][block]) + (word & ((1 << rest) - 1)).bit_count()

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, zero in enumerate(self.zeros):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            ones = self.rank1(level, i)
            code, i = code << 1 | bit, zero + ones if bit else i - ones
        return int(self.alphabet[code])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        """Where the token's occurrences of [lo, hi) lie below the last plane, and where all its occurrences begin."""
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return None
        first, top = 0, len(self.zeros) - 1
        for level, zero in enumerate(self.zeros):
            a, b, c = (self.rank1(level, x) for x in (lo, hi, first))
            lo, hi, first = (zero + a, zero + b, zero + c) if code >> (top - level) & 1 else (lo - a, hi - b, first - c)
        return lo, hi, first

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before position i."""
        found = self._range(token, 0, min(max(i, 0), self.n))
        return 0 if found is None else found[1] - found[0]

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the token at positions lo to hi - 1."""
        return self.rank(token, self.n if hi is None else hi) - self.rank(token, lo)

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, k from 0; -1 if it has no more than k."""
        found = self._range(token, 0, self.n)
        if found is None or not 0 <= k < found[1] - found[0]:
            return -1
        code, at = int(np.searchsorted(self.alphabet, token)), found[2] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = code >> (len(self.zeros) - 1 - level) & 1
            want = at - self.zeros[level] if bit else at
            lo, hi = 0, self.n  # the smallest i with more than `want` such bits among the first i + 1
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self.rank1(level, mid + 1)
                if (ones if bit else mid + 1 - ones) > want:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        codes = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above, zero = np.empty_like(codes), self.zeros[level]
            above[np.flatnonzero(~bits)] = codes[:zero]
            above[np.flatnonzero(bits)] = codes[zero:] | codes.dtype.type(1 << (len(self.zeros) - 1 - level))
            codes = above
        return self.alphabet[codes] if self.n else np.zeros(0, np.uint32)

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sQIB", MAGIC, self.n, len(self.alphabet), len(self.zeros))
        body = [self.alphabet.astype("<u4"), np.array(self.zeros, "<u8"), *self.planes, *(r.astype("<u4") for r in self.ranks)]
        return head + b"".join(x.tobytes() for x in body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, n, sigma, levels = struct.unpack_from("<4sQIB", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<4sQIB")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        alphabet, zeros = take("<u4", sigma), take("<u8", levels).tolist()
        blocks = -(-n // BLOCK)
        planes = [take("u1", blocks * (BLOCK // 8)) for _ in range(levels)]
        return cls(n, alphabet, zeros, planes, [take("<u4", blocks + 1) for _ in range(levels)])


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct ids, and each id's place among them."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint16)
    seen = np.bincount(ids) > 0
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    place = np.cumsum(seen) - 1
    return alphabet, place.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)[ids]


ODD = re.compile(r" \s")
RUN = 500  # pieces encoded at a time
PIECE = 64  # characters of the longest piece that is remembered
ENTRY = 170  # bytes of a remembered piece beside its characters and ids
MARKS = ".,!?;:%&$#*|"


class PieceEncoder:
    """Encodes texts through a byte-level BPE tokenizer, remembering what each space-led piece encodes to.

    The tokenizer splits a text before it merges, and a single space between two other characters always begins a
    part of its own. So a text may be cut before such spaces, each piece encoded once and looked up from then on.
    Texts with a space before other white space, and those that hold an added token (``<|endoftext|>``), which the
    tokenizer takes out before it splits, are encoded whole. Pieces of up to ``PIECE`` characters are remembered, until
    ``limit`` of them or ``room`` bytes are held: a full memory becomes the old one, and what is met again moves from there
    to the new. So at most two memories are held, and longer pieces (unspaced scripts) are encoded each time.
    """

    def __init__(self, tokenizer_path: str, limit: int = 900_000, room: int = 160 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.leads = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.leads[i] = token.startswith("Ġ")  # how this vocabulary writes a leading space
        self.limit, self.room, self.held = limit, room, 0
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def has_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _runs(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """(piece, ids) of pieces encoded in runs; the ids of each begin with one that has a leading space."""
        runs = [pieces[at : at + RUN] for at in range(0, len(pieces), RUN)]
        joined = [" " + " ".join(r) for r in runs]
        done = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        for run, text, encoding in zip(runs, joined, done):
            ids = np.array(encoding.ids, self.kind)
            cuts = np.flatnonzero(self.leads[ids])
            if len(cuts) != len(run) or self.has_added(text):  # an added token with a space may arise between pieces
                yield from ((p, self.whole(" " + p)) for p in run)
                continue
            raw, width = ids.tobytes(), ids.itemsize
            cuts = (cuts * width).tolist()
            yield from zip(run, (raw[x:y] for x, y in zip(cuts, [*cuts[1:], len(raw)])))

    def _learn(self, pieces: set[str]) -> None:
        """Encodes new pieces. One of letters and a tail of marks is the letters' ids and the tail's, as the tokenizer
        splits it there; so a word is encoded once, whatever mark follows it."""
        plain, split = [], []
        for p in pieces:
            if not p or p[0].isspace() or p[-1].isspace():
                self.known[p] = self.whole(" " + p)
                continue
            head = p.rstrip(MARKS)
            if len(head) < len(p) and head.isalpha():
                split.append((p, head))
            else:
                plain.append(p)
        heads = {h for _, h in split}.difference(self.known, plain)
        self.known.update(self._runs([*plain, *heads]))
        for p, head in split:
            tail = p[len(head) :]
            if tail not in self.tails:
                self.tails[tail] = self.whole(tail)
            self.known[p] = self.known[head] + self.tails[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if len(self.known) > self.limit or self.held > self.room:
            self.known, self.old, self.held = {}, self.known, 0
        if len(self.tails) > 100_000:
            self.tails = {}
        split = [None if ODD.search(t) or self.has_added(t) else t.split(" ") for t in texts]
        firsts = [s[0] for s in split if s]
        begun = self.tokenizer.encode_batch_fast(firsts, add_special_tokens=False)
        begins = iter([np.array(e.ids, self.kind).tobytes() for e in begun])
        new = set().union(*(s[1:] for s in split if s)).difference(self.known)
        again = self.old.keys() & new if self.old else ()
        self.known.update((p, self.old[p]) for p in again)
        if len(again) < len(new):
            self._learn(new.difference(again))
        look = self.known.__getitem__
        done = [self.whole(t) if s is None else next(begins) + b"".join(map(look, s[1:])) for t, s in zip(texts, split)]
        for p in [p for p in new if len(p) > PIECE]:
            del self.known[p]
        self.held += sum(len(p) + ENTRY for p in new)
        return done


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of an installed public vocabulary, the default of the ``tokenizer_path`` parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(tokenizer_path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = PieceEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


@contextlib.contextmanager
def no_collection():
    """Without cyclic garbage collection: nothing here makes cycles, and going through the lists of pieces takes a tenth
    of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


SHARD_SCHEMA = "part int, seq int, start_in_part long, n_docs int, n_tokens long, payload binary"


def pack_shard(doc_ids: list[int | None], sequences: list[bytes], kind) -> bytes:
    """A shard: document ids, their lengths, and the wavelet matrix of all their tokens (ids as bytes of ``kind``)."""
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    lengths = np.array([len(s) for s in sequences], "<u8") // np.dtype(kind).itemsize
    tokens = np.frombuffer(b"".join(sequences), kind)
    return struct.pack("<I", len(ids)) + ids.tobytes() + null.tobytes() + lengths.tobytes() + WaveletMatrix.build(tokens).to_bytes()


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    (n,) = struct.unpack_from("<I", data)
    ids, null = np.frombuffer(data, "<i8", n, 4).tolist(), np.frombuffer(data, np.uint8, n, 4 + 8 * n)
    lengths = np.frombuffer(data, "<u8", n, 4 + 9 * n)
    return [None if x else d for d, x in zip(ids, null)], lengths, WaveletMatrix.from_bytes(data[4 + 17 * n :])


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 0, shard_tokens: int = 1 << 20, partitions: int | None = None, order: tuple[str, ...] = ()) -> None:
    """Encode ``docs(doc_id, text)`` into wavelet shards at ``path``, in the order of the ``order`` columns, nulls first,
    and then in ascending doc_id order.

    A null or empty text holds the end id only; a null doc_id sorts first; rows with the same doc_id stay apart, in
    order of their text's hash. An empty table gives a table without shards. Columns other than these are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_collection():
            yield from shards(batches)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, held = TaskContext.get().partitionId(), 0, 0, 0
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.kind).tobytes()
        ids: list = []
        sequences: list = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, held, ids, sequences
            row = [part, seq, start, len(ids), held, pack_shard(ids, sequences, enc.kind)]
            seq, start, held, ids, sequences = seq + 1, start + held, 0, [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for doc, raw in zip(some.column(0).to_pylist(), enc.encode([t or "" for t in some.column(1).to_pylist()])):
                    ids.append(doc)
                    sequences.append(raw + end)
                    held += len(sequences[-1]) // len(end)
                    if held >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    n = partitions or n_partitions(docs.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in (*order, "doc_id")]
    ordered = docs.select("doc_id", "text", *order).repartitionByRange(n, *keys).sortWithinPartitions(*keys, F.xxhash64("text"))
    ordered.select("doc_id", "text").mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def _based(spark, path: str) -> DataFrame:
    """The shards at ``path`` with ``start``, the ids of all shards before: one sum for each written partition passes the
    driver, in the order of the partitions."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    bases, total = [], 0
    for part, n in sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect()):
        bases.append((part, total))
        total += n
    based = shards.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
    return based.select((F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "payload")


def _asked(shards: DataFrame, answer: Callable[[WaveletMatrix, int], list[tuple]], schema: str) -> DataFrame:
    """What ``answer(matrix, start)`` gives for each shard."""
    target = shards.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = answer(unpack_shard(data.as_py())[2], start)
                columns = list(zip(*rows)) or [[]] * len(target)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=target.fieldNames())

    return shards.select("start", "payload").mapInArrow(run, schema)


def token_counts(spark, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each of a few ids in the whole sequence at ``path``, by rank in each shard."""
    each = _asked(_based(spark, path), lambda m, _: [(t, m.count(t)) for t in sorted(set(tokens))], "token long, n long")
    return each.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark, path: str, token: int) -> DataFrame:
    """(position): every place of the id in the whole sequence, by select in each shard."""
    return _asked(_based(spark, path), lambda m, at: [(at + m.select(token, k),) for k in range(m.count(token))], "position long")


def tokens_at(spark, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) for each row of ``positions(position)`` that the sequence has, by access in the shard that holds it.

    A shard is asked once, with its positions as an array; shards without any aren't opened."""
    shards = _based(spark, path)
    starts = sorted(r[0] for r in shards.where("n_tokens > 0").select("start").collect())  # a number a shard
    table = spark.createDataFrame([(a, b) for a, b in zip(starts, [*starts[1:], None])], "start long, stop long")
    last = shards.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] or 0
    # a shard's range in blocks of 2**20 positions, so that the range join has a key
    table = table.select("start", F.coalesce("stop", F.lit(last)).alias("stop")).withColumn("block", F.explode(F.sequence(F.shiftright("start", 20), F.shiftright(F.col("stop") - 1, 20))))
    asked = positions.select("position").distinct().withColumn("block", F.shiftright("position", 20))
    met = asked.join(table, "block").where("position >= start and position < stop")
    held = met.groupBy("start").agg(F.collect_set("position").alias("positions"))  # at most a shard's length each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                matrix = unpack_shard(data.as_py())[2]
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([matrix.access(p - start) for p in wanted], pa.int64())], names=["position", "token"])

    return shards.where("n_tokens > 0").select("start", "payload").join(held, "start").select("start", "payload", "positions").mapInArrow(run, "position long, token long")


def read_shards(spark, path: str) -> DataFrame:
    """Per document of the shards at ``path``: doc_id, start, n_tokens and ids_crc32, decoded from the bit-planes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, lengths, matrix = unpack_shard(data.as_py())
                tokens = matrix.decode()
                raw = memoryview(tokens.astype("<u4").tobytes())
                ends = np.cumsum(lengths).astype(np.int64)
                begins = ends - lengths.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(begins + start), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return _based(spark, path).select("start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, path: str, **options) -> DataFrame:
    """Write the shards of ``docs`` to ``path`` and return what ``read_shards`` finds there."""
    write_shards(docs, path, tokenizer_path, **options)
    return read_shards(docs.sparkSession, path)
