"""Whitening, the flat graph and spelling variants against brute-force versions."""

import collections
import math
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import flatgraph, queries, variants, whitening

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>"


def with_clashes(df):
    return df.withColumns({c: F.lit("own") for c in ("node", "component", "n", "links", "v", "d1", "size", "word", "kept")})


def random_vectors(n, size, seed=1):
    return np.random.default_rng(seed).standard_normal((n, size))


# whitening


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(3)
    b = rng.integers(-50, 50, (9, 6)).astype(object)
    a = b.T.dot(b)
    told = whitening.characteristic(spark, a)
    for t in (-3, 0, 7, 1000):  # against the determinant by fractions
        m = [[Fraction(int((t if i == j else 0) - a[i, j])) for j in range(6)] for i in range(6)]
        det = Fraction(1)
        for i in range(6):
            p = next(r for r in range(i, 6) if m[r][i])
            if p != i:
                m[i], m[p], det = m[p], m[i], -det
            det *= m[i][i]
            for r in range(i + 1, 6):
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
        assert det == sum(c * t**k for k, c in enumerate(told))


def test_repeated_roots_have_orthogonal_vectors(spark):
    a = np.diag([6, 6, 6, 2, 0, 0]).astype(object)
    roots, power = whitening.largest_roots(whitening.characteristic(spark, a), 20, 6)
    assert [r / (1 << power) for r in roots] == pytest.approx([6, 6, 6, 2, 0, 0], abs=1e-20)
    v = whitening.null_vectors(a, roots[:4], power)
    assert np.abs(v @ v.T - np.eye(4)).max() < 1e-15 and np.abs(v[:3, 3:]).max() < 1e-15


@pytest.mark.parametrize("size, n", [(12, 300), (3, 40)])
def test_whitened_like_numpy(spark, size, n):
    x = random_vectors(n, size) * np.linspace(1, 3, size)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    rows = whitening.whiten(with_clashes(df)).collect()
    k = min(8, size)
    assert len(rows) == n * k
    whole = np.floor(1024 * x) + 100000
    cov = np.cov(whole.T, bias=True)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    sums = [int(c) for c in whole.sum(axis=0)]
    signs = {}
    for r in rows:
        c = r.component - 1
        expect = (whole[r.vec_id] - whole.mean(axis=0)) @ v[:, c] / math.sqrt(e[c])
        signs.setdefault(c, np.sign(expect * r.whitened))
        assert r.whitened == pytest.approx(signs[c] * expect, abs=1e-9)
        assert r.explained == pytest.approx(e[c] / np.trace(cov), rel=1e-10)
        assert r.deviation == sum((n * int(a) - s) ** 2 for a, s in zip(whole[r.vec_id], sums)) == r.deviation_exact
    assert rows[0].identity_error < 1e-12 and len({r.identity_error for r in rows}) == 1


def test_whitening_of_odd_rows(spark):
    odd = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [NAN, 1.0]), (4, [INF, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [-1.0, 0.5]), (8, [0.0, 0.0])]
    rows = whitening.whiten(spark.createDataFrame(odd, VECTORS)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in rows) == sorted((i is None, i or 0, c) for i in (1, 1, None, 8) for c in (1, 2))
    assert {r.n for r in rows} == {4}
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25]) for i in range(3)], VECTORS)).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in same} == {(None, None, 0, 0.0)}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], VECTORS)).collect()
    assert {r.whitened is None for r in flat if r.component == 2} == {True} and all(r.whitened is not None for r in flat if r.component == 1)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e12, 5.0]), (3, [3.0, 4.0])], VECTORS)).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id == 1)


# the flat graph


def brute_links(ids, x, cosine):
    """{row: links}, {row: component} by comparing all pairs."""
    length = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(length, length) >= cosine
    np.fill_diagonal(near, False)
    root = list(range(len(x)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(near)):
        p, q = find(int(a)), find(int(b))
        root[max(p, q)] = min(p, q)
    least = {}
    for k in range(len(x)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return near.sum(axis=1), [least[find(k)] for k in range(len(x))]


def clustered(n, size, groups, spread, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, size))
    for g, members in enumerate(groups):
        centre = rng.standard_normal(size)
        at = rng.choice(n, members, replace=False)
        base[at] = centre + spread * rng.standard_normal((members, size))
    return base


@pytest.mark.parametrize("options", [{}, {"region": 300, "block": 200}, {"hot": 100, "region": 400}])
def test_links_like_brute_force(spark, options):
    x = clustered(1500, 32, [2] * 40 + [9] * 10 + [240], 0.15, 5).astype(np.float32)
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = {r.vec_id: r for r in flatgraph.near_duplicates(with_clashes(df), **options).collect()}
    links, component = brute_links([i * 3 for i in range(len(x))], x.astype(float), 0.9)
    found = sum(r.n_links for r in rows.values())
    assert all(rows[i * 3].n_links <= links[i] for i in range(len(x)))
    assert found >= 0.99 * links.sum()
    assert sum(rows[i * 3].component_id != component[i] for i in range(len(x))) <= 5
    assert all(r.kept == (r.vec_id == r.component_id) and r.audited_recall >= 0.9 for r in rows.values())


def test_vectors_between_the_bounds_of_hot_groups_are_compared(spark):
    """Two hot groups and vectors around them whose cosines lie about the threshold."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal(16)
    b = a + 0.45 * rng.standard_normal(16)
    x = np.concatenate([a + 0.05 * rng.standard_normal((150, 16)), b + 0.05 * rng.standard_normal((150, 16)), a + 0.42 * rng.standard_normal((120, 16)), rng.standard_normal((60, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    rows = {r.vec_id: r for r in flatgraph.near_duplicates(df, hot=100).collect()}
    links, component = brute_links(list(range(len(x))), x, 0.9)
    assert [rows[i].component_id for i in range(len(x))] == component
    assert sum(rows[i].n_links for i in range(len(x))) >= 0.99 * links.sum() and all(rows[i].n_links == links[i] for i in range(300))


def test_links_of_odd_rows(spark):
    odd = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [NAN, 1.0]), (6, [1.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [-0.0, 3.0]), (9, [None, 1.0]), (10, [1e300, 1.0]), (11, [])]
    rows = flatgraph.near_duplicates(spark.createDataFrame(odd, VECTORS)).collect()
    told = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in rows)
    assert told == [(0, 0, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True), (10, 3, 1, False), (11, 0, 11, True)]
    assert flatgraph.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    copies = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"))
    assert {(r.n_links, r.component_id) for r in flatgraph.near_duplicates(copies).collect()} == {(2999, 0)}


# spelling variants


def brute_variants(docs, least=3, every=97):
    count = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in count.items() if n >= least and len(w) >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    by = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :], len(w)].add(w)
            by[w[:i] + w[i + 1 :], "", 0].add(w)
        by[w, "", 0].add(w)
    others = collections.defaultdict(set)
    for group in by.values():
        for a in group:
            others[a] |= {b for b in group if b not in others[a] and near(a, b)}
    form = {}
    for w in words:
        if others[w]:
            best = min(others[w], key=lambda o: (-words[o], o))
            if words[best] >= 2 * words[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(others[w]), form.get(w) or "", words.get(form.get(w), 0), root(w)) for w, n in words.items())


def told_variants(df, **options):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in variants.group_variants(df, **options).collect())


def test_variants_like_brute_force(spark):
    rng = np.random.default_rng(2)
    base = ["strasse", "straße", "größer", "kleiner", "letter", "letters", "litter", "bitter", "better", "batter", "élève", "éleve", "aaaaa", "aaaa", "aaaaaa", "ÿÿÿÿÿ", "×÷×÷×"]
    texts = []
    for d in range(60):
        words = [base[i] for i in rng.integers(0, len(base), 40)]
        for k in range(0, 40, 5):
            i = rng.integers(0, len(words[k]))
            words[k] = words[k][:i] + rng.choice(list("abcé")) + words[k][i + 1 :]
        texts.append((int(d) if d % 7 else None, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    texts += [(1, None), (2, ""), (3, texts[3][1]), (3, texts[3][1]), (4, "x" * 70000), (5, "abcde" * 20000 + " abcde")]
    df = with_clashes(spark.createDataFrame(texts, "doc_id long, text string"))
    for every in (97, 3):
        assert told_variants(df, every=every) == brute_variants(texts, every=every)


def test_variants_of_documents_like_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    told = con.execute(f"select word, n, n_near, coalesce(form, ''), coalesce(form_n, 0), root from ({queries.ORACLE_SQL['op13_spelling_variants']})").fetchall()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert told_variants(docs) == sorted(told) == brute_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_no_variants_of_an_empty_table(spark):
    assert variants.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_join_of_variants_goes_through_the_driver(spark, tmp_path):
    """Exploded signatures are taken to be as few bytes as the words' file, and were collected for a broadcast."""
    spark.createDataFrame([("letter", 9), ("letters", 4), ("litter", 3)], "word string, n long").write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    formed = variants.forms(words)
    for rows in (variants.near_pairs(words), formed, variants.roots(formed)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, formed.collect())) == [("letter", 9, 2, None, None), ("letters", 4, 1, "letter", 9), ("litter", 3, 1, "letter", 9)]
    docs = spark.createDataFrame([(1, "letter " * 9 + "letters " * 4)], "doc_id long, text string")
    assert "Broadcast" not in variants.group_variants(docs)._jdf.queryExecution().executedPlan().toString()


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    numbers = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert {f"op{k}" for k in range(1, 14)} <= numbers and "pipeline" in entry.queries()


# surrogates of long runs


def test_long_runs_end_without_error():
    import time

    from quernstone.llm import surrogates

    made = surrogates.Surrogates(b"k")
    for n in (1, 63, 64, 65, 220, 250, 3100, 200_000):
        for text in ("q" * n + "@b.org", "a@" + "b" * n + ".org", "a@" + "a." * n, "Mr K" + "k" * n, "Mr " * n, "Mr " + "A. " * n, "Анна " * n, "1" * n, "AB12 " * n, "é" * n, "@" * n, "a.b@c.de " * (n // 8)):
            began = time.time()
            new, spans = surrogates.replace(text, made)
            assert time.time() - began < 30 and (new == text) == (not spans)
    runs = ["x" * k + "@b.org" for k in range(1, 64)] + ["Mr K" + "k" * k for k in range(1, 63)]
    assert len({surrogates.replace(t, made)[0] for t in runs}) == len(runs)


def test_names_keep_gender_capitals_and_blanks():
    from quernstone.llm import surrogates

    made = surrogates.Surrogates(b"k")
    men, women = ({n for k, names in surrogates.NAMES.items() if k[1:] == (g, "given") for n in names} for g in "mf")
    for text, names in (("Robert Jones", men), ("Mary Smith", women), ("MR ROBERT JONES", men), ("Dr  Katharina Weber", women), ("Виктор Орлов", men)):
        new, spans = surrogates.replace(text, made)
        assert len(spans) == 1 and any(w.title() in names for w in new.split()), new
        assert new.isupper() == text.isupper() and new.count(" ") == text.count(" ")
    assert surrogates.replace("Robert Jones and ROBERT JONES", made)[0].split(" and ")[0].upper() == surrogates.replace("Robert Jones and ROBERT JONES", made)[0].split(" and ")[1]
