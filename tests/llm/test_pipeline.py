"""The pipeline against brute-force versions of its stages, each on its own input."""

from collections import Counter

import duckdb

import corpus_pipeline
from quernstone.llm import cotrain, curriculum
from quernstone.llm.common import stored

from .conftest import SF
from .test_ops import SPACED, brute_components, brute_hits, token_rows


def test_stages(spark, docs):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "token_output"]
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = state, stored(stage(spark, state, SF), name)
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name != "token_output":
            assert out.columns == docs.columns + [curriculum.POSITION] * (name == "mixture")
            ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "quality":
            good = cotrain.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).where("is_quality").collect()
            assert sorted(ids) == sorted(r.doc_id for r in good)
        elif name == "near_duplicates":
            assert sorted(ids) == sorted({c for _, _, c in brute_components(rows)})
        elif name == "decontamination":
            assert sorted(ids) == sorted(d for d, *_, bad in brute_hits(rows, items) if not bad)
        elif name == "mixture":
            want = {r.doc_id: r.taken for r in curriculum.plan(before).collect() if r.taken}
            got = Counter()
            for r in out.collect():
                got[r.doc_id] += len(SPACED.findall(r.text))
            assert got == want
        else:
            order = before.orderBy(curriculum.POSITION, "doc_id").select("doc_id", "text").collect()
            got = sorted(map(tuple, out.collect()), key=lambda r: r[1])
            assert [r[0] for r in got] == [r.doc_id for r in order] != sorted(r.doc_id for r in order)
            assert [r[2:] for r in got] == [next(iter(token_rows([(0, r.text)])))[2:] for r in order]
        state = out


def test_odd_rows_go_through_every_stage(spark, odd):
    state = odd
    for name, stage in corpus_pipeline.STAGES:
        before, state = state, stored(stage(spark, state, SF), name)
        if name in ("quality", "near_duplicates", "decontamination"):
            assert state.columns == odd.columns and state.where("digest != 'own'").count() == 0
        elif name == "mixture":
            assert before.where("text is null").count() <= 1 and state.where("text is null or trim(text) = ''").count() == 0
            n = state.count()
    rows = state.collect()
    assert len(rows) == n > 0 and sorted(r.start for r in rows) == sorted(sum(r.n_tokens for r in rows if r.start < s.start) for s in rows)


def test_empty(spark, empty):
    state = empty
    for name, stage in corpus_pipeline.STAGES:
        state = stored(stage(spark, state, SF), name)
        assert state.count() == 0
