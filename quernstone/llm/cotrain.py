"""Quality classifier by co-training.

Two views of a document: its content (hashed words, rates of characters, line layout) and its page metadata (source,
language, recorded length). Each view has a logistic model, fitted on labelled rows. Then, round after round, both score
every unlabelled document of the corpus, and of the documents that a view is calibrated to be sure of the ``exchange``
surest of each class are handed to the other view as pseudo-labels. At the end each view is calibrated on labelled rows
kept out of the fit, the two log-odds are combined by a logistic model on the same rows, and all documents are scored.

The features of all rows are extracted once into a table, so that a round reads numbers, not texts. A task fits: it holds at
most ``labelled`` labelled rows and what the rounds exchange (``exchange`` a round, class and view); the driver holds keys,
labels and models.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import WORD_BYTES, stored

PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
WORD_SLOTS = 1 << 18  # hashed columns of the content view
SLOTS = 256  # hashed one-hot columns for source and language
VIEWS = ("content", "meta")
FEATURES = "doc_id long, digest long, cols binary, counts binary, dense binary, slots binary, sizes binary"


class Slots(dict):
    """Column of each word, remembered; cleared when it has grown."""

    def __missing__(self, word: bytes) -> int:
        slot = zlib.crc32(word) % WORD_SLOTS
        if len(word) <= 32:
            self[word] = slot
        return slot


def content_view(raw: bytes, n_chars: int, slots: Slots) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Columns of the words (lower-cased runs of letters and digits) and their counts, and rates of characters and lines."""
    words = raw.translate(WORD_BYTES).split()
    cols, counts = np.unique(np.fromiter(map(slots.__getitem__, words), np.int32, len(words)), return_counts=True)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, total, lines = max(n_chars, 1), max(len(words), 1), int(seen[10]) + 1
    dense = [
        *np.sqrt(seen[PUNCTUATION] / n), np.sqrt(seen[48:58].sum() / n), seen[65:91].sum() / n, n_chars / total / 10, len(cols) / total,
        np.log1p(len(words)) / 10, np.log1p(lines) / 5, np.log1p(n_chars / lines) / 10, raw.count(b"\n\n") / lines,
    ]
    return cols, counts, dense


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> tuple[list[int], list[float]]:
    """Columns of source and language (null is a value of its own), and the recorded length with whether there is one."""
    slots = [zlib.crc32(f"{kind}={v}".encode()) % SLOTS for kind, v in (("source", source), ("lang", lang))]
    return slots, [np.log1p(max(n_chars or 0, 0)) / 10, float(n_chars is None)]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns that the views read, null texts as empty ones; metadata that the table lacks is null."""
    have = set(docs.columns)
    meta = ((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long")))
    return docs.select("doc_id", F.xxhash64("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text"), *meta)


def _batch(schema: str, columns: list, kinds: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])


def features(docs: DataFrame) -> DataFrame:
    """Both views of each row as packed numbers: int32 columns, uint32 counts, floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Slots()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(2)
                packed: list[list[bytes]] = [[] for _ in range(5)]
                rows = zip(texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist(), *(part.column(i).to_pylist() for i in (3, 4, 5)))
                for raw, n, source, lang, n_chars in rows:
                    cols, counts, dense = content_view(raw, n, known)
                    slots, sizes = metadata_view(source, lang, n_chars)
                    values = cols, counts.astype("<u4"), np.array(dense, "<f4"), np.array(slots, "<i4"), np.array(sizes, "<f4")
                    for column, value in zip(packed, values):
                        column.append(value.tobytes())
                if len(known) > 400_000:
                    known.clear()
                yield _batch(FEATURES, [part.column(0), part.column(1), *packed], [None, None] + [pa.binary()] * 5)

    return _columns(docs).mapInArrow(run, FEATURES)


class Rows:
    """Feature rows of one view: a sparse part (row, column, value) and a dense one."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, dense: np.ndarray):
        self.row, self.col, self.value, self.dense = row, col, value, dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.col], minlength=len(self.dense))

    def take(self, which: np.ndarray) -> Rows:
        place = np.full(len(self.dense), -1)
        place[which] = np.arange(len(which))
        keep = place[self.row] >= 0
        return Rows(place[self.row[keep]], self.col[keep], self.value[keep], self.dense[which])


def unpack(batch) -> dict[str, Rows]:
    """Both views of packed feature rows; words weigh 1 + log of their counts."""

    def flat(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)

    n = batch.num_rows
    each = np.array([len(v) // 4 for v in batch.column("cols").to_pylist()], np.int64)
    row = np.repeat(np.arange(n), each)
    value = 1 + np.log(flat("counts", "<u4").astype(np.float32))
    content = Rows(row, flat("cols", "<i4"), value, flat("dense", "<f4").reshape(n, -1).astype(float) if n else np.zeros((0, 0)))
    slots = flat("slots", "<i4")
    meta = Rows(np.repeat(np.arange(n), 2), slots, np.ones(len(slots)), flat("sizes", "<f4").reshape(n, -1).astype(float) if n else np.zeros((0, 0)))
    return {"content": content, "meta": meta}


@dataclass
class Linear:
    """Logistic model over sparse columns and standardized dense ones."""

    sparse: np.ndarray
    dense: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: Rows) -> np.ndarray:
        return x.dot(self.sparse) + (x.dense - self.mean) / self.scale @ self.dense + self.bias


def fit(x: Rows, y: np.ndarray, weight: np.ndarray, width: int, *, steps: int = 60, ridge: float = 2e-4, rate: float = 0.15, least: int = 2, prior: float = 10.0) -> Linear:
    """Full-batch logistic regression by Adam; both classes weigh the same. Columns met in fewer than ``least`` rows get no
    weight; the others are scaled by the log ratio of their shares in the classes, drawn to 0 by ``prior`` rows."""
    mean, scale = x.dense.mean(axis=0), x.dense.std(axis=0) + 1e-6
    dense = (x.dense - mean) / scale
    share = np.array([max(weight[y == c].sum(), 1e-9) for c in (0, 1)])
    met = np.bincount(x.col, minlength=width)
    used = np.flatnonzero(met >= least)
    place = np.full(width, -1, np.int64)
    place[used] = np.arange(len(used))
    keep = met[x.col] >= least
    row, col, value = x.row[keep], place[x.col[keep]], x.value[keep]
    n, m = len(used), dense.shape[1]
    in_class = [np.bincount(col, weights=weight[row] * (y[row] == c), minlength=n) for c in (0, 1)]
    ratio = np.log((in_class[1] + prior * share[1] / share.sum()) / share[1]) - np.log((in_class[0] + prior * share[0] / share.sum()) / share[0])
    value = value * ratio[col]
    weight = weight / share[y] / 2
    w = np.zeros(n + m + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=value * w[col], minlength=len(y)) + dense @ w[n:-1] + w[-1]
        r = (sigmoid(z) - y) * weight
        g = np.concatenate([np.bincount(col, weights=value * r[row], minlength=n), dense.T @ r, [r.sum()]]) + ridge * np.append(w[:-1], 0)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    sparse = np.zeros(width)
    sparse[used] = w[:n] * ratio
    return Linear(sparse, w[n:-1], float(w[-1]), mean, scale)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias last) of a ridged logistic model on the columns of z, by Newton steps; and its probabilities."""
    z = np.column_stack([np.clip(z, -30, 30).reshape(len(y), -1), np.ones(len(y))])
    w = np.zeros(z.shape[1])
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))  # Platt's targets
    for _ in range(50):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (p - soft) + 1e-3 * w)
    return w, sigmoid(z @ w)


@dataclass
class CoModel:
    """What scoring needs of one target: the views' models and calibrations, their combination, the threshold."""

    views: dict[str, Linear]
    calibration: dict[str, np.ndarray]
    combine: np.ndarray
    threshold: float

    def odds(self, x: dict[str, Rows]) -> dict[str, np.ndarray]:
        """Calibrated log-odds of each view."""
        return {k: np.clip(m.score(x[k]), -30, 30) * self.calibration[k][0] + self.calibration[k][1] for k, m in self.views.items()}

    def combined(self, odds: dict[str, np.ndarray]) -> np.ndarray:
        return sigmoid(sum(odds[k] * self.combine[i] for i, k in enumerate(VIEWS)) + self.combine[-1])


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors, in the middle of the widest gap among the best; 0.5 where labels don't tell."""
    if len(set(y.tolist())) < 2:
        return 0.5
    order = np.argsort(p)
    p, y = p[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[0.0], p, [1.0]])
    gaps = np.where(errors == errors.min(), np.diff(edges), -1.0)
    at = int(np.argmax(gaps))
    return float((edges[at] + edges[at + 1]) / 2)


KEY = ["doc_id", "digest"]


def _taught(feats: DataFrame, keys: DataFrame, round_: int) -> DataFrame:
    """The feature rows of a bounded set of keys, each once, written, with the round that they are met in first."""
    rows = feats.join(F.broadcast(keys.select(*KEY)), KEY, "left_semi").dropDuplicates(KEY)
    return stored(rows.withColumn("round", F.lit(round_)), "taught")


def chosen(feats: DataFrame, told: DataFrame, labelled: int) -> DataFrame:
    """At most ``labelled`` rows with labels, first by hash of doc_id, with their labels."""
    one = feats.select(*KEY).where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    return one.join(told, "doc_id").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(labelled)


def surest(feats: DataFrame, told: DataFrame, models: dict[str, CoModel], given: dict[tuple[str, str], np.ndarray], sure: float, exchange: int) -> list[tuple]:
    """(target, view, label, doc_id, digest): of all unlabelled rows, those that a view is surest of, at most ``exchange``
    of each target, view and class, without the documents that the other view was ``given`` before.

    The best of each of 64 salts are found first, so no task ranks all sure rows of a class."""
    sent = feats.sparkSession.sparkContext.broadcast((models, given))
    out = "target string, view string, label int, sureness double, doc_id long, digest long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told_models, before = sent.value
        for batch in batches:
            x = unpack(batch)
            ids, digests = (batch.column(k).to_numpy(zero_copy_only=False) for k in KEY)
            for target, model in told_models.items():
                for view, z in model.odds(x).items():
                    p = sigmoid(z)
                    fresh = ~np.isin(ids, before[target, view])
                    for label, s in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero(fresh & (s >= sure))
                        if len(at):
                            n = len(at)
                            yield _batch(out, [[target] * n, [view] * n, np.full(n, label, np.int32), s[at], ids[at], digests[at]], [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()])

    sure_rows = feats.where("doc_id is not null").mapInArrow(run, out).join(told.select("doc_id"), "doc_id", "left_anti")
    group = ["target", "view", "label"]
    order = (F.desc("sureness"), F.xxhash64(F.lit(12), *KEY), *KEY)
    salted = sure_rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(13), *KEY), F.lit(64)))
    for keys in ([*group, "salt"], group):
        salted = salted.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= exchange)
    best = [tuple(r) for r in salted.select(*group, *KEY).orderBy(*group, *KEY).collect()]
    sent.destroy()
    return best


Pseudo = dict[tuple[str, str], dict[tuple, int]]


def _models(table: pa.Table, said: dict[tuple, dict], pseudo: Pseudo, targets: list[str]) -> dict[str, CoModel]:
    """The model of each target from all rows taught: those of round 0 have labels, the others pseudo-labels."""
    table = table.combine_chunks().sort_by([(k, "ascending") for k in ("round", *KEY)])
    names = list(zip(*(table.column(k).to_pylist() for k in KEY)))
    n_labelled = table.column("round").to_pylist().count(0)
    x, more = unpack(table.slice(0, n_labelled)), unpack(table.slice(n_labelled))
    place = {k: i for i, k in enumerate(names[n_labelled:])}
    models = {}
    for t in targets:
        y = np.array([-1 if said[k][t] is None else int(said[k][t]) for k in names[:n_labelled]], np.int64)
        have, rng = np.flatnonzero(y >= 0), np.random.default_rng(14)
        held = np.sort(np.concatenate([rng.permutation(np.flatnonzero(y == c))[::4] for c in (0, 1)]))
        fitted = np.setdiff1d(have, held)
        if len(set(y[fitted].tolist())) < 2:
            held = fitted = have
        linear, calibration = {}, {}
        for v in VIEWS:
            got = [(place[k], label) for k, label in pseudo[t, v].items() if k in place]
            base = x[v].take(fitted)
            labels_, weight = y[fitted], np.ones(len(fitted))
            if got:
                at, label = (np.array(c, np.int64) for c in zip(*got))
                add = more[v].take(at)
                base = Rows(
                    np.concatenate([base.row, add.row + len(base.dense)]), np.concatenate([base.col, add.col]),
                    np.concatenate([base.value, add.value]), np.concatenate([base.dense, add.dense]),
                )
                labels_, weight = np.concatenate([labels_, label]), np.concatenate([weight, np.full(len(label), 0.5)])
            linear[v] = fit(base, labels_, weight, WORD_SLOTS if v == "content" else SLOTS)
            calibration[v], _ = platt(linear[v].score(x[v].take(held)), y[held])
        z = [np.clip(linear[v].score(x[v].take(held)), -30, 30) * calibration[v][0] + calibration[v][1] for v in VIEWS]
        combine, p = platt(np.column_stack(z), y[held])
        # never above one half: a document isn't turned down while it is likelier good than bad
        models[t] = CoModel(linear, calibration, combine, min(_best_threshold(p, y[held]), 0.5))
    return models


def fitted_models(taught: DataFrame, said: dict[tuple, dict], pseudo: Pseudo, targets: list[str]) -> dict[str, CoModel]:
    """``_models`` of the bounded rows taught, fitted in a task: the driver gets the packed models alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := list(batches):
            packed = zlib.compress(pickle.dumps(_models(pa.Table.from_batches(parts), said, pseudo, targets)), 1)
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["packed"])

    return pickle.loads(zlib.decompress(taught.coalesce(1).mapInArrow(run, "packed binary").first()[0]))


def train(feats: DataFrame, labels: DataFrame, *, targets=("quality",), labelled: int = 4000, rounds: int = 3, sure: float = 0.95, exchange: int = 500) -> dict[str, CoModel | None]:
    """A model for each target column of ``labels``; None where the labels hold fewer than two classes.

    A fourth of the labelled rows of each class is kept out of the fits and calibrates them. A pseudo-label counts half."""
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(t).alias(t) for t in targets))
    keys = stored(chosen(feats, told, labelled), "labelled")
    said = {(r.doc_id, r.digest): {t: r[t] for t in targets} for r in keys.collect()}
    active = [t for t in targets if {0, 1} <= {int(r[t]) for r in said.values() if r[t] is not None}]
    if not active:
        return dict.fromkeys(targets)
    pseudo: Pseudo = {(t, v): {} for t in active for v in VIEWS}
    other = dict(zip(VIEWS, VIEWS[::-1]))
    taught, known = _taught(feats, keys, 0), set()
    for round_ in range(rounds + 1):
        models = fitted_models(taught, said, pseudo, active)
        if round_ == rounds:
            break
        given = {(t, v): np.array([k[0] for k in pseudo[t, other[v]]], np.int64) for t in active for v in VIEWS}
        for t, v, label, doc, digest in surest(feats, told, models, given, sure, exchange):
            pseudo[t, other[v]].setdefault((doc, digest), label)
        want = sorted({k for p in pseudo.values() for k in p} - known)
        if want:
            known.update(want)
            taught = taught.unionByName(_taught(feats, feats.sparkSession.createDataFrame(want, "doc_id long, digest long"), round_ + 1))
    return {t: models.get(t) for t in targets}


def score(feats: DataFrame, models: dict[str, CoModel | None]) -> DataFrame:
    """For each feature row and target: its combined probability (``p_<target>``), the calibrated ones of the two views
    and the decision (``is_<target>``). Without a model the probabilities are null, and the decision is too but for
    quality: there all documents are accepted."""
    fields = ["doc_id long", "digest long"]
    for t in models:
        fields += [f"p_{t} double", f"p_{t}_content double", f"p_{t}_meta double", f"is_{t} boolean"]
    schema = ", ".join(fields)
    sent = feats.sparkSession.sparkContext.broadcast(models)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpack(batch)
            columns = [batch.column("doc_id"), batch.column("digest")]
            for target, model in sent.value.items():
                if model is None:
                    none = pa.nulls(batch.num_rows, pa.float64())
                    columns += [none, none, none, pa.array([True if target == "quality" else None] * batch.num_rows, pa.bool_())]
                    continue
                odds = model.odds(x)
                p = model.combined(odds)
                columns += [pa.array(p), *(pa.array(sigmoid(odds[v])) for v in VIEWS), pa.array(p >= model.threshold)]
            yield _batch(schema, columns, [None] * len(columns))

    return feats.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, *, targets=("quality",), **options) -> DataFrame:
    """Score every row of ``docs(doc_id, text[, source, lang, n_chars])`` by models co-trained on ``labels``.

    Null texts read as empty and null metadata is a value of its own. A document with several label rows takes the
    largest label. Rows with a null doc_id are scored but take no part in the fit. Without labels of both classes every
    row has null probabilities; it is accepted as to quality, and any other decision is null. Repeated rows are scored
    each; ties of sureness go by hash; an empty table gives no rows; other columns are ignored.
    """
    feats = stored(features(docs), "features")
    return score(feats, train(feats, labels, targets=targets, **options)).drop("digest")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the quality model accepts, with docs' own columns."""
    feats = stored(features(docs), "features")
    good = score(feats, train(feats, labels, **options)).where("is_quality").select("doc_id", "digest").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.digest"))
    return docs.alias("d").join(good.alias("g"), same, "left_semi")
