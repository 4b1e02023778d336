"""Each operator against a brute-force version, and on nulls, empty and long texts, repeated rows, empty tables and
columns with clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import backoff, components, cotrain, curriculum, hilbert, notices, postings, secrets, simhash, surrogates, wavelet
from quernstone.llm.common import shared_folder

from .conftest import ODD, SF

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


ENCODER = wavelet.PieceEncoder(wavelet.vocabulary())


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# 1: wavelet shards


def test_wavelet_answers():
    ids = np.random.default_rng(1).integers(0, 40, 5000).astype(np.uint16) * 7
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert (m.decode() == ids).all() and [m.access(i) for i in (0, 511, 512, 4999)] == ids[[0, 511, 512, 4999]].tolist()
    for token in (0, 7, 273):
        at = np.flatnonzero(ids == token)
        assert m.count(token) == len(at) and m.count(token, 100, 900) == int(((at >= 100) & (at < 900)).sum()) and m.rank(token, 512) == int((at < 512).sum())
        assert [m.select(token, k) for k in (0, len(at) - 1, len(at))] == [at[0], at[-1], -1]
    assert m.count(3) == 0 and m.select(3, 0) == -1
    for tiny in ([], [5], [5, 5]):
        t = wavelet.WaveletMatrix.build(np.array(tiny, np.uint16))
        assert t.decode().tolist() == tiny and t.count(5) == len(tiny) and t.select(5, 1) == (1 if len(tiny) == 2 else -1)


def token_rows(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(wavelet.vocabulary())
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_output(spark, docs, texts):
    got = wavelet.token_output(docs, wavelet.vocabulary(), shared_folder(spark, "t"), shard_tokens=5000)
    assert sorted(map(tuple, got.collect())) == sorted(token_rows(texts.items()))


def test_token_output_odd(spark, odd, empty):
    got = sorted(map(tuple, wavelet.token_output(odd, wavelet.vocabulary(), shared_folder(spark, "t")).collect()), key=lambda r: r[1])
    want = token_rows(ODD)
    assert [r[0] for r in got] == [r[0] for r in want] and sorted(r[2:] for r in got) == sorted(r[2:] for r in want) and [r[1] for r in got][0] == 0
    assert wavelet.token_output(empty, wavelet.vocabulary(), shared_folder(spark, "t")).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n b \n c", "   ", "it's  'll we're 12ab\tx", "é 漢 字 x　y", "a   b", "<|endoftext|> x", "x\x1c y \x1d z", "foo  \n\n bar"])
def test_pieces_encode_alike(text):
    enc = wavelet.PieceEncoder(wavelet.vocabulary())
    for _ in range(2):  # learned, then remembered
        assert enc.encode([text, text + " tail"]) == [enc.whole(text), enc.whole(text + " tail")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é'1s.\n\t  \u3000\u00a0\x1c\x85漢!", max_size=40))
def test_any_text_encodes_alike(text):
    assert ENCODER.encode([text]) == [ENCODER.whole(text)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=700))
def test_any_sequence_comes_back(ids):
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(np.array(ids, np.uint16)).to_bytes())
    assert m.decode().tolist() == ids and all(m.count(t) == ids.count(t) for t in range(10))


def test_lookups_over_a_table_of_shards(spark, docs, texts):
    path = shared_folder(spark, "t")
    wavelet.write_shards(docs, path, wavelet.vocabulary(), shard_tokens=5000)
    ids = [i for d in sorted(texts) for i in [*ENCODER.tokenizer.encode(texts[d], add_special_tokens=False).ids, 0]]
    common = Counter(ids).most_common(3)[-1][0]
    counts = {r.token: r.n for r in wavelet.token_counts(spark, path, [0, common, 50_000]).collect()}
    assert counts == {t: ids.count(t) for t in (0, common, 50_000)}
    assert sorted(r[0] for r in wavelet.occurrences(spark, path, common).collect()) == [i for i, t in enumerate(ids) if t == common]
    asked = [0, 1, 4999, 5000, len(ids) - 1, len(ids), -1]
    got = wavelet.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert {r.position: r.token for r in got} == {p: ids[p] for p in asked if 0 <= p < len(ids)}


def test_memory_of_pieces_is_bounded():
    enc, rng = wavelet.PieceEncoder(wavelet.vocabulary(), room=20_000), np.random.default_rng(4)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice(list("abcdé漢"), n)) for n in (3, 200, 12, 7)) for _ in range(8)]
        assert enc.encode(texts) == [enc.whole(t) for t in texts]
        assert all(len(p) <= wavelet.PIECE for p in enc.known) and len(enc.known) * wavelet.ENTRY < 40_000


# 2: co-training


def held_out(spark, base, targets):
    """Decisions on labelled documents that the fit never saw, with their labels."""
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    out = labels.where("pmod(xxhash64(99L, doc_id), 4L) = 0")
    told = labels.join(out.select("doc_id"), "doc_id", "left_anti")
    return cotrain.classify(docs, told, targets=targets).join(out, "doc_id").collect()


def test_held_out_accuracy(spark):
    got = held_out(spark, "/root/testdata/sf0.1", ("quality", "toxic"))
    assert len(got) > 500 and all(0 <= r.p_quality <= 1 for r in got)
    assert np.mean([bool(r.quality) == r.is_quality for r in got]) > 0.97 and np.mean([r.is_quality for r in got if r.quality]) > 0.99
    toxic = [r.is_toxic for r in got if r.toxic]
    assert np.mean([bool(r.toxic) == r.is_toxic for r in got]) > 0.96 and np.mean(toxic) > 0.8
    assert np.mean([bool(r.toxic) for r in got if r.is_toxic]) > 0.9


def test_exchange_sees_every_unlabelled_document(spark):
    """The surest documents are those of the whole corpus, the labelled ones and those already given aside."""
    docs = spark.createDataFrame([(i, "good fine text " * (1 + i % 7) if i % 2 else "bad poor text " * (1 + i % 5), "s", "en", 10) for i in range(600)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    feats = cotrain.stored(cotrain.features(docs), "features")
    models = cotrain.train(feats, labels, rounds=0)
    told = labels.select("doc_id")
    given = {("quality", v): np.array([81, 82]) for v in cotrain.VIEWS}
    p = {r.doc_id: r.p_quality_content for r in cotrain.score(feats, models).collect()}
    for exchange in (7, 10_000):
        got = [r for r in cotrain.surest(feats, told, models, given, 0.6, exchange) if r[1] == "content"]
        for label in (0, 1):
            sure = {i: p[i] if label else 1 - p[i] for i in range(80, 600) if i not in (81, 82)}
            sure = {i: s for i, s in sure.items() if s >= 0.6}
            mine = [r[3] for r in got if r[2] == label]
            assert len(set(mine)) == len(mine) == min(exchange, len(sure)) > 0
            assert min(sure[i] for i in mine) >= sorted(sure.values(), reverse=True)[len(mine) - 1]


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, "own"), (2, 0, "own"), (5, 1, "own"), (6, 0, "own"), (6, 1, "own"), (99, 1, "own"), (None, 1, "own"), (7, None, "own")], "doc_id long, quality int, digest string")
    assert cotrain.classify(odd, labels).count() == len(ODD)
    kept = cotrain.accepted(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(ODD)
    one_class = labels.where("quality = 1")
    assert cotrain.accepted(odd, one_class).count() == len(ODD)  # nothing to learn from: all stay
    assert cotrain.classify(empty, labels).count() == 0 and cotrain.accepted(odd, labels.limit(0)).count() == len(ODD)


# 3: Hilbert curves


def test_hilbert_is_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512)) and np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_neighbours(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:20]
        want += [(int(ids[q]), k + 1, int(ids[j]), float(s[j])) for k, j in enumerate(order)]
    assert sorted(map(tuple, hilbert.nearest(df, window=64, chunk=3).collect())) == sorted(want)
    double = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted(map(tuple, hilbert.nearest(double, window=64).collect())) == sorted(want)


def test_recall_of_the_windows(spark):
    """On clustered vectors, which neighbour search is for, the windows alone find nine in ten."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((300, 32))
    x = (centres[rng.integers(0, 300, 12_000)] + 0.15 * rng.standard_normal((12_000, 32))).astype("float32")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in hilbert.nearest(df, window=512, exact=False).collect()}
    best = np.argsort(-(x[::20] @ x.T - 1e9 * (np.arange(0, 12_000, 20)[:, None] == np.arange(12_000))), axis=1)[:, :20]
    want = {(20 * q, int(j)) for q, row in enumerate(best) for j in row}
    assert len(got & want) / len(want) >= 0.9


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0], "own"), (1, [1.0, 0.0], "own"), (2, [1.0, 0.0], "own"), (3, [0.0, 0.0], "own"), (4, None, "own"), (5, [None, 1.0], "own"), (6, [float("nan"), 1.0], "own"), (7, [float("inf"), 1.0], "own"), (8, [0.5, 0.0], "own"), (None, [1.0, 1.0], "own"), (9, [1.0], "own"), (20, [2.0, 0.0], "own")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = sorted(map(tuple, hilbert.nearest(df, window=2).collect()))
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 8, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0), (20, 4, 8, 1.0)]
    assert hilbert.nearest(df.limit(0)).count() == 0


# 4: SimHash


def brute_fingerprint(t):
    import xxhash

    w = SPACED.findall(lower(t))
    shingles = [" ".join(w)] if 0 < len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance=4):
    """Component id of each row."""
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    names = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            names[r] = min(d, names.get(r, d))
    return [(d, f"{f:016x}", names.get(r)) for (d, _), f, r in zip(rows, fps, root)]


def sort_null(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block", [2048, 2])
def test_near_duplicates(docs, texts, block):
    got = simhash.near_duplicates(docs, block=block).select("doc_id", "fingerprint", "component_id").collect()
    assert sort_null(map(tuple, got)) == sort_null(brute_components(list(texts.items())))


def test_near_duplicates_odd(odd, empty):
    got = simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect()
    assert sort_null(map(tuple, got)) == sort_null(brute_components(ODD))
    kept = simhash.keep_one(odd)
    want = brute_components(ODD)
    groups = {(c, f if c is None else "") for _, f, c in want}
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert simhash.near_duplicates(empty).count() == 0 == simhash.keep_one(empty).count()


def test_anchors_cover():
    """Any two words at most four bits apart share an anchor."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
            b ^= 1 << bit
        keys, owners = simhash.anchors(np.array([a, b], np.uint64))
        assert set(keys[owners == 0]) & set(keys[owners == 1])


def test_components_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


# 5: stupid backoff


def brute_scores(rows, order=3, a=0.4):
    w = [backoff.alnum_words(t) for _, t in rows]
    grams = (lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)))
    c = {n: sum((grams(x, n) for x in w), Counter()) for n in range(1, order + 1)}
    total, out = sum(map(len, w)), []
    for (d, _), x in zip(rows, w):
        own = {n: grams(x, n) for n in range(1, order + 1)}
        s = 0.0
        for i in range(len(x)):
            top = min(order, i + 1)
            for n in range(top, 0, -1):
                g = tuple(x[i - n + 1 : i + 1])
                left = c[n][g] - own[n][g]
                if left > 0:
                    s += math.log(left / ((c[n - 1][g[:-1]] - own[n - 1][g[:-1]]) if n > 1 else total - len(x))) + (top - n) * math.log(a)
                    break
            else:
                s += -math.log(total - len(x) + 1) + (top - 1) * math.log(a)
        out.append((d, len(x), s))
    return out


def test_backoff_like_joins(docs, odd):
    from .relational_backoff import score

    for df in (docs, odd):
        got, want = (sort_null((r.doc_id, r.n_words, round(r.log_score, 4)) for r in x.collect()) for x in (backoff.score(df), score(df)))
        assert got == want


@pytest.mark.parametrize("words", [1 << 21, 3000])
def test_backoff(docs, texts, words):
    got = sorted(tuple(r)[:3] for r in backoff.score(docs, chunk_words=words).collect())
    want = sorted(brute_scores(list(texts.items())))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])


def test_backoff_odd(odd, empty):
    got = sort_null((r.doc_id, r.n_words, round(r.log_score, 4)) for r in backoff.score(odd).collect())
    assert got == sort_null((d, n, round(s, 4)) for d, n, s in brute_scores(ODD))
    assert backoff.score(empty).count() == 0


# 6: surrogates


def test_surrogates():
    made = surrogates.Surrogates(b"k")
    text = "Dr. Anna Schmidt (anna@web.de, +49 30 1234567, 123-45-6789, 4111 1111 1111 1111, DE89 3704 0044 0532 0130 00) met Иван Петров and Frau Schmidt at 10.0.0.1; Anna Schmidt"
    new, spans = surrogates.replace(text, made)
    kinds = Counter(k for k, *_ in spans)
    assert kinds == {"person": 4, "email": 1, "phone": 1, "ssn": 1, "card": 1, "iban": 1, "ip": 1}
    by = {text[a:b]: s for _, a, b, s in spans}
    assert by["Dr. Anna Schmidt"] == "Dr. " + by["Anna Schmidt"] and by["Frau Schmidt"].split()[1] == by["Anna Schmidt"].split()[1]
    assert by["Anna Schmidt"].split()[0] in surrogates.NAMES["latin", "f", "given"] and by["Иван Петров"].split()[0] in surrogates.NAMES["cyrillic", "m", "given"]
    assert surrogates.luhn(re.sub(r"\D", "", by["4111 1111 1111 1111"])) and re.sub(r"\d", "0", by["+49 30 1234567"]) == "+00 00 0000000"
    iban = by["DE89 3704 0044 0532 0130 00"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert all(old not in new for old in by)
    assert surrogates.replace(text, surrogates.Surrogates(b"other"))[0] != new
    assert surrogates.detect("ST-36 in 1999-2020, v1.2.3, Anna went, 12345") == []


def test_permutation():
    assert sorted(surrogates.permute(b"k" * 32, "t", v, 1000) for v in range(1000)) == list(range(1000))
    even = [v for v in range(1000) if v % 2 == 0]
    assert sorted(surrogates.permute(b"k" * 32, "t", v, 1000, lambda x: x % 2 == 0) for v in even) == even


def test_pseudonymize(docs, texts, odd, empty):
    rows = surrogates.pseudonymize(docs, b"key").collect()
    for r in rows:
        old = texts[r.doc_id]
        assert all(old[s.start : s.end] not in r.text for s in r.spans if s.kind == "email")
        assert (r.text == old) == (not r.spans)
    got = surrogates.pseudonymize(odd, b"key")
    assert got.count() == len(ODD) and got.where("text is null").count() == 2 and surrogates.pseudonymize(empty, b"key").count() == 0


# 7: curriculum


def brute_targets(sizes, share=1.5, most=2):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    got, left, free = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and free:
        total = sum(weights[s] for s in free)
        for s in free:
            got[s] += left * weights[s] / total
        left = sum(max(0.0, got[s] - most * sizes[s]) for s in free)
        for s in list(free):
            if got[s] >= most * sizes[s]:
                got[s] = float(most * sizes[s])
                free.discard(s)
    return got


def test_mix(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    size = {r.doc_id: len(SPACED.findall(r.text)) for r in rows}
    source = {r.doc_id: r.source for r in rows}
    sizes = Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    targets = brute_targets(sizes)
    plan = curriculum.plan(docs).collect()
    taken = Counter()
    for r in plan:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and math.isclose(r.target, targets[source[r.doc_id]]) and r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, plan), key=repr) == sorted(map(tuple, curriculum.plan(docs.repartition(7)).collect()), key=repr)
    mixed = curriculum.mix(docs)
    assert mixed.columns == [*docs.columns, curriculum.POSITION]
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(SPACED.findall(r.text))
    assert words == +taken


def test_mix_odd(odd, empty):
    plan = curriculum.plan(odd)
    assert plan.count() == len(ODD) and plan.agg(F.sum("size")).first()[0] == sum(len(SPACED.findall(t or "")) for _, t in ODD)
    mixed = curriculum.mix(odd)
    assert mixed.columns == [*odd.columns, curriculum.POSITION] and curriculum.mix(odd.withColumn(curriculum.POSITION, F.lit("own"))).columns == mixed.columns
    assert mixed.where("size != 'own' or position != 'own'").count() == 0
    assert curriculum.plan(empty).count() == 0 == curriculum.mix(empty).count()


def test_schedule_inverts(spark):
    for knots in curriculum.SCHEDULES:
        us = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
        got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(curriculum.inverse_demand(F.col("u"), knots)).collect()]
        grid = np.linspace(0, 1, 200_001)
        w = np.interp(grid, *zip(*knots))
        demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert np.allclose(np.interp(got, grid, demand / demand[-1]), us, atol=1e-6)


# 8: secrets


def brute_spans(x):
    a = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end(), "assign") for m in a.finditer(x) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", x) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secrets(docs, texts, odd, empty):
    for r in secrets.find_secrets(docs).collect():
        assert r.base_sha256 == hashlib.sha256(brute_spans(texts[r.doc_id]).encode()).hexdigest()
    got = [(r.doc_id, r.base_sha256) for r in secrets.find_secrets(odd).collect()]
    assert sort_null(got) == sort_null((d, hashlib.sha256(brute_spans(t or "").encode()).hexdigest()) for d, t in ODD)
    assert secrets.find_secrets(empty).count() == 0


def test_failed_assignment_uses_up_its_text():
    assert secrets.base_spans("secret=token:abcdefgh") == [] and secrets.base_spans("TOKEN = 'abc_123'") == [("assign", 0, 16)]
    assert secrets.base_spans("ſecret=abcdefg") == []


CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def found_secrets(spark, texts):
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {texts[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for r in got for s in r.spans.split(",") if s.startswith("random")}


@pytest.mark.parametrize("alphabet, length, share", [(CHARS, 56, 0.95), (CHARS, 32, 0.9), (CHARS[:26] + "234567", 56, 0.8), (CHARS[26:52], 48, 0.8), ("0123456789ABCDEF", 40, 0.9)])
def test_random_tokens(spark, alphabet, length, share):
    """Most random keys are found among ten times as many long words; words and repeats aren't."""
    rng = np.random.default_rng(5)
    syllables = ["the", "an", "ing", "tion", "er", "on", "re", "at", "es", "or"]
    words = ["".join(rng.choice(syllables, 14)) for _ in range(600)]
    keys = ["".join(rng.choice(list(alphabet), length)) for _ in range(60)]
    dull = ["abc123" * 8] * 60
    found = found_secrets(spark, [" ".join([*words[10 * i : 10 * i + 10], keys[i], dull[i]]) for i in range(60)])
    assert len(found & set(keys)) >= share * 60 and not found & set(dull) and len(found & set(words)) <= 3


def test_secrets_without_words_beside_them(spark):
    """A small corpus of keys alone, some of letters alone, is told as well as a large one."""
    rng = np.random.default_rng(6)
    keys = ["".join(rng.choice(list(a), 48)) for a in (CHARS, CHARS[:52]) for _ in range(10)]
    assert len(found_secrets(spark, keys) & set(keys)) >= 18
    assert found_secrets(spark, ["internationalizationsupport getUserAccountDetailsByName", "abcdefghijklmnopqrstuvwxyz0123456789"]) == set()


def test_language_null_is_a_fair_bound():
    """p-values of draws from the language model itself are no smaller than they should be."""
    rng = np.random.default_rng(7)
    for name in ("lower", "base64", "hex"):
        place = [t.name for t in secrets.TABLES].index(name)
        t = secrets.TABLES[place]
        p = []
        for _ in range(500):
            groups = rng.choice(len(t.language), 40, p=t.language)
            p.append(secrets.language_p(place, np.array([rng.choice(np.flatnonzero(t.group == g)) for g in groups])))
        assert all(np.mean(np.array(p) <= level) <= level + 0.02 for level in (0.01, 0.05, 0.2))


# 9: decontamination


def brute_hits(rows, items):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, ids = ALNUM.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    ids |= windows[k]
                    hit |= set(range(a, a + n))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("block, shard", [(8 << 20, 1 << 20), (300, 500)])
def test_decontaminate(spark, docs, texts, block, shard):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = postings.decontaminate(docs, items, block_bytes=block, shard_words=shard).select(*COLUMNS).collect()
    want = brute_hits(texts.items(), [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, got)) == sorted(want) and any(r[5] for r in want)


def test_decontaminate_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "Alpha-beta GAMMA"), (10, "漢字"), (3, None), (4, ""), (1, "long long"), (None, "x")], "item_id long, text string").withColumn("doc_id", F.lit("own"))
    got = postings.decontaminate(odd, items).select(*COLUMNS).collect()
    want = brute_hits(ODD, [("" if r.item_id is None else r.item_id, r.text) for r in items.collect()])
    assert sort_null(map(tuple, got)) == sort_null(want)
    kept = postings.clean(odd, items)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id = 3").count() == 1
    assert postings.decontaminate(empty, items).count() == 0 and postings.clean(odd, items.limit(0)).count() == len(ODD)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one x two y three"), (2, "three two one"), (3, "one two"), (4, "one " + "z " * 30 + "two three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in postings.decontaminate(docs, items, slop=3).collect()}
    assert got == {1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


# 10: licenses


def brute_places(t):
    w, places, labels = ALNUM.findall(lower(t)), [], set()
    for phrase, label in notices.BASE:
        p = phrase.split()
        for a in range(len(w) - len(p) + 1):
            if w[a : a + len(p)] == p:
                places.append(a)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_notices(docs, texts, odd, empty):
    for r in notices.scan_notices(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_places(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert sort_null((r.doc_id, r.n_words) for r in notices.scan_notices(odd).collect()) == sort_null((d, len(ALNUM.findall(lower(t)))) for d, t in ODD)
    assert notices.scan_notices(empty).count() == 0


def test_fuzzy_notices(spark):
    rows = [(1, "Licenced under the Apache  License, Version 2.0!"), (2, "All rigths reserved; CC-BY cc by cc by"), (3, "GNU Lesser General Public License"), (4, "the apache tribe"), (5, "permision is hereby grantd, free of charge, to any persn obtaining a copy")]
    got = {r.doc_id: r for r in notices.scan_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache-2.0" and got[1].score < 1 and got[1].spans == ["apache-2.0:0:7:1"]
    assert got[2].n_base == 3 and got[2].base_labels == "cc-by" and "reserved" in got[2].labels
    assert set(got[3].labels.split(",")) >= {"gpl", "lgpl"} and got[4].labels == "" and got[4].score == 0 and got[5].labels == "mit"
