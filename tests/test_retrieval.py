"""Many questions against one at a time, pages against offsets, commentary by rules worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from quernstone.operators import answers, curate, search
from quernstone.operators import index as ix
from quernstone.operators import store as st
from quernstone.operators.index import SearchIndex
from quernstone.operators.pages import Key, OrderedList

ITEMS = "id long, type string, name string, alias string, category string, summary string, content string, source_note string, tags string, detail string"
ROWS = [
    (1, "formula", "桂枝汤", None, "太阳病", "解肌", "太阳病，发热汗出，桂枝汤主之。", None, "经方", None),
    (2, "formula", "麻黄汤", "", None, None, "太阳病，无汗而喘。", None, None, '{"x": "咳嗽"}'),
    (3, "herb", "桂枝", None, None, None, "桂枝汤、麻黄汤皆用。治咳嗽。", "Shang Han", None, None),
    (4, "acupoint", "足三里", None, None, "胃经", "咳嗽亦取之。", None, None, None),
    (5, "theory", "条文", None, "太阳病", None, "", None, None, None),
    (6, None, "无名", None, None, None, "咳嗽", None, None, None),
    (7, "formula", None, None, None, None, None, None, None, None),
    (8, "note", "shang", None, None, None, "Lung HEAT and cough", None, None, None),
]
QUESTIONS = [
    (1, "太阳病用什么方？", 3), (2, "咳嗽怎么治", None), (3, "桂枝汤的组成", 1), (4, "", 2), (5, None, None), (6, "   ", 999), (7, "足三里穴在哪", 4),
    (8, "lung heat，cough", None), (9, "没有的词语", None), (10, "太阳病、太阳病；咳嗽", 3),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, ITEMS)


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame([(1, "太阳病注：麻黄汤与桂枝汤"), (2, "咳嗽"), (3, "咳嗽用麻黄汤"), (None, "太阳病"), (1, None)], "item_id long, content string")


def test_contexts_like_one_question_at_a_time(spark, items):
    questions = spark.createDataFrame(QUESTIONS, "question_id long, question string, related_id long")
    got = answers.context_items_of(items, questions, max_items=1).collect()
    for qid, question, _ in QUESTIONS:
        one = [(r["id"], r["seq"]) for r in answers.context_items(items, question, max_items=1).collect()] if question and question.strip() else []
        assert [(r["id"], r["seq"]) for r in sorted(got, key=lambda r: r["place"]) if r["question_id"] == qid] == one, question


def test_candidates_like_one_question_at_a_time(spark, items, notes):
    questions = spark.createDataFrame(QUESTIONS, "question_id long, question string, related_id long")
    got = {}
    for r in answers.formula_scores_of(items, notes, questions).collect():
        got.setdefault(r["question_id"], {})[r["item_id"]] = r["score"]
    for qid, question, related in QUESTIONS[:4] + QUESTIONS[6:]:
        one = {r["item_id"]: r["score"] for r in answers.formula_scores(items, notes, question, related_id=related).collect()}
        assert got.get(qid, {}) == one, question
    assert answers.formula_scores_of(items.limit(0), notes.limit(0), questions).count() == 0
    assert answers.formula_scores_of(items, notes, questions.limit(0)).count() == 0


def test_a_thousand_searches_like_one_at_a_time(spark, tmp_path):
    texts = ["a b a b a", "a_b c", "cough, Cough coughing!", "", None, "हिन्दी भाषा", "x" * 5000 + " cough", "b a", "b a", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    index = SearchIndex(st.Store(spark, str(tmp_path)), ["content"], detail_is_json=False)
    index.build(docs)
    index.apply(docs.where("id = 2").withColumn("content", F.lit("cough now")), docs.where("id = 7").select("id"))
    asked = ["a b", "b a", "a b a", "cough", "c", "a", "...", "", "भाषा", "हिन्दी भाषा", "a_b", "absent", "absent words", "cough\n"]
    rows = [(i, q) for i, q in enumerate(asked)] + [(i, f"word{i} a") for i in range(20, 1000)] + [(1000, None)]
    got = {}
    for r in index.bm25_of(spark.createDataFrame(rows, "query_id long, query string"), 3).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["bm25"], 6)))
    for i, q in enumerate(asked):
        one = [(r["id"], round(r["b"], 6)) for r in index.bm25(q).select("id", F.round("bm25", 9).alias("b")).orderBy("b", "id").limit(3).collect()]
        assert got.get(i, []) == one, q
    assert max(got) < 20
    assert index.bm25_of(spark.createDataFrame([], "query_id long, query string"), 3).count() == 0


def test_postings_in_ranges_with_heavy_words_over_several(spark):
    texts = [f"heavy été heavy w{i} w{i // 9}" for i in range(400)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    head = int.from_bytes(b"heavy\0", "big")
    got = ix.grouped_places(docs, ["content", "content"], [head, head, head, int.from_bytes(b"w2\0\0\0\0", "big")]).collect()
    want = set()
    for i, text in enumerate(texts):
        words = [w for w in (text or "").split()]
        for t in {"", *words}:
            want.add((t, i, 2 * len(words), tuple(c * search.COLUMN_SPAN + k for c in (0, 1) for k, w in enumerate(words) if w == t)))
    assert {(r["token"], r["id"], r["dl"], tuple(r["places"])) for r in got} == want and len(got) == len(want)
    assert {r["part"] for r in got if r["token"] == "heavy"} == {0, 1, 2, 3}
    by_part = {p: [r["token"].encode()[:6] for r in got if r["part"] == p] for p in {r["part"] for r in got}}
    assert all(max(by_part[a]) <= min(by_part[b]) for a, b in zip(sorted(by_part), sorted(by_part)[1:]))


def runs_read(df) -> int:
    """How many runs the scan's partition filter lets through; none where the plan has no scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "FileScan" not in plan:
        return 0
    told = re.search(r"PartitionFilters: \[[^\]]*?_range#\d+(?:L)? (?:IN \(([^)]*)\)|= (\d+))", plan)
    return len((told[1] or told[2]).split(","))


@pytest.mark.parametrize("falling", [True, False])
def test_pages_like_offsets(spark, tmp_path, falling):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 != 0, (F.col("id") * 37) % 50).alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("f"), F.col("id") % 3)).alias("facet"))
    keys = [Key("k", falling), Key("id", not falling)]
    pages = OrderedList(st.Store(spark, str(tmp_path)), "rows", keys, ["facet"])
    pages.build(rows, range_rows=100)
    everything = [tuple(r) for r in rows.orderBy(*(k.order() for k in keys)).collect()]
    for where in ({}, {"facet": "f1"}, {"facet": None}):
        want = [r for r in everything if not where or r[2] == where["facet"]]
        assert pages.total(**where) == len(want)
        for number, size in ((1, 10), (4, 33), (len(want) // 7, 7), (10_000, 5), (None, None)):
            n, s = max(number or 1, 1), size or 50
            found = pages.page(number, size, **where)
            assert [tuple(r) for r in found.collect()] == want[(n - 1) * s : n * s]
            assert runs_read(found) <= 6
        for at in (0, 5, len(want) // 2, len(want) - 3, len(want) - 1):
            cursor = {"k": want[at][1], "id": want[at][0]}
            found = pages.after(cursor, 9, **where)
            assert [tuple(r) for r in found.collect()] == want[at + 1 : at + 10]
        assert [tuple(r) for r in pages.after(None, 9, **where).collect()] == want[:9]
    pages.build(rows.limit(0))
    assert pages.total() == 0 and pages.page(3, 10).count() == 0 and pages.after({"k": 1, "id": 1}, 5).count() == 0


def test_page_ten_thousand_reads_few_ranges(spark, sf, tmp_path):
    items = spark.range(60_000).select("id", (F.col("id") * 7919 % 60_000).alias("k"))
    pages = OrderedList(st.Store(spark, str(tmp_path)), "many", [Key("k"), Key("id")])
    pages.build(items, range_rows=1_000)
    found = pages.page(10_000, 5)
    assert [r["k"] for r in found.collect()] == list(range(49_995, 50_000))
    assert 0 < runs_read(found) <= 2


COMMENTARIES = [  # worked out by hand from the rules
    ("觀\n其\n脈\n證\n太阳 病，\n脉浮。\n治", "", "太阳病，脉浮。"),
    ("觀其脈證知犯何逆隨證治之十二：头痛。。项强；；\n恶寒", "", "头痛。\n项强；\n恶寒".replace("；", "")),
    ("一二：太阳之为病。注：此为提纲。", "太阳之为病。", "注：此为提纲。"),
    ("太阳 之为\n病。其义如下。", "太阳 之为病。", "其义如下。"),
    ("「协热利」不止", None, "协热利不止"),
    ("\n\n", "x", ""),
]


@pytest.mark.parametrize("text,original,want", COMMENTARIES)
def test_commentary(spark, text, original, want):
    row = spark.createDataFrame([(text, original)], "t string, o string").select(curate.commentary("t", F.col("o")).alias("c"), curate.structured("o", F.lit(want), F.lit("r")).alias("s")).first()
    assert row["c"] == want
    head = f"【原文】\n{original}\n\n" if original else ""
    assert row["s"] == head + (f"【注解整理】\n{want}" if want else "【正文整理】\nr")


def test_tidied(spark):
    broken = "\n".join(["觀", "其", "脈", "證", "知", "太阳之为病。", "此条", "是", "提纲"])
    rows = [(1, broken, "条", "太阳之为病。", True), (2, broken, "条", None, False), (3, "好文。", "条", None, True), (4, None, None, None, None), (5, "校排\n正文", "条", None, False), (6, "", "x", "", True)]
    got = {r["id"]: r for r in curate.tidied(spark.createDataFrame(rows, "id int, content string, name string, original string, classic boolean")).collect()}
    assert got[1]["tidied"] and got[1]["content"] == "【原文】\n太阳之为病。\n\n【注解整理】\n此条是提纲" and not got[1]["review"]
    assert got[2]["content"] == rows[1][1] or got[2]["tidied"]
    assert (got[3]["content"], got[3]["tidied"]) == ("好文。", False)
    assert got[4]["content"] is None and not got[4]["tidied"]
    assert (got[5]["content"], got[5]["tidied"]) == ("正文", True)
    assert (got[6]["content"], got[6]["tidied"]) == ("", False)


def test_channel_description(spark):
    d = spark.range(1).select(curate.channel_description(*map(F.lit, ("督脉", "GV", "奇经八脉", "阳脉之海", " ", "脑", ""))).alias("d")).first()["d"]
    assert d["summary"] == "督脉，奇经八脉，联系脏腑：脑。"
    assert d["content"] == "督脉，国际代码 GV，类别：奇经八脉。阴阳属性：阳脉之海；手足属性：未单列。传统经络归属联系：脑。"


def test_cards_and_answers(spark):
    fields = "id long, type string, name string, category string, summary string, content string, source_note string, source_package string, detail string"
    items = spark.createDataFrame([
        (1, "formula", "桂枝汤", "太阳", "中风", "组成\n：桂枝三两，芍药二两。煎服法：水煮\n余", "卷一", None, None),
        (2, "formula", "麻黄汤", None, None, None, None, None, '{"ingredients": ["麻黄", "杏仁"], "clauseNo": 35, "usage": " 温服 ", "dosage": ""}'),
        (3, "formula", "空方", "", None, "", " ", "", "not json"),
        (4, "herb", "桂枝", None, None, None, None, None, None),
    ], fields)
    notes = spark.createDataFrame(
        [(3, i, i // 2, "书" if i % 2 else None, None if i % 2 else "页", f"{'字' * 160}{i}" if i == 9 else f"注解：其{i}。") for i in range(10)] + [(None, 99, 1, "x", "y", "z"), (4, 98, 1, "x", "y", "z")],
        "item_id long, id long, created_at long, source_title string, source_note string, content string",
    )
    cards = answers.formula_cards(items, notes)
    got = {r["item_id"]: r for r in cards.withColumn("block", answers.card_text()).collect()}
    assert set(got) == {1, 2, 3}
    one, two, three = got[1], got[2], got[3]
    assert (one["composition"], one["usage"], one["decoction_method"], one["indications"], one["related_pattern"]) == ("桂枝三两，芍药二两", "水煮", "水煮", "中风", "太阳")
    assert one["ratio"] and [tuple(s) for s in one["sources"]] == [("太阳", "卷一")] and one["annotation_snippets"] == []
    assert (two["composition"], two["original_dosage"], two["related_pattern"], two["usage"], two["sources"]) == ("麻黄，杏仁", "麻黄，杏仁", "35", "温服", [])
    assert two["block"] == "方剂：麻黄汤\n\n本地资料原方组成：\n* 麻黄\n* 杏仁\n\n原文煎服法：\n温服\n\n资料依据：\n* 未记录来源；该卡片仅可作为待补来源资料。\n---"
    assert three["missing_composition"] and three["explanation"] == "其8" and [tuple(s) for s in three["sources"]] == [("书", None), (None, "页")]
    assert three["annotation_snippets"] == ["字" * 150 + "...", "注解：其8。", "注解：其7。", "注解：其6。"]
    text = spark.range(1).select(
        answers.answer_text(F.lit("多少克"), F.array(F.lit("A"), F.lit("B"))).alias("a"), answers.answer_text(F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("b")
    ).first()
    assert text["a"] == f"{answers.ANSWER_HEAD}\n问题：多少克\n\n{answers.DOSE_LIMIT}\n\nA\nB"
    assert text["b"] == f"{answers.ANSWER_HEAD}\n问题：\n\n{answers.NO_COMPOSITION}\n{answers.NOTHING_MADE_UP}"
    assert answers.formula_cards(items.limit(0), notes.limit(0)).count() == 0


def test_notes_of_a_detail(spark):
    from quernstone.operators import imports

    details = ['{"Volume": 3, "annotation": {"b": [1, "x"]}, "own": 1}', '{"own": "x"}', "[1]", "no json", None, '{"classic id": null, "work_title": "伤寒\\"论"}', '{"notes": "own", "volume": 1}']
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(details)], "i int, d string")
    got = {r["i"]: r["n"] for r in rows.select("i", F.try_element_at(imports.lift_detail(F.create_map(F.lit("name"), F.lit("n"), F.lit("detail"), F.col("d"))), F.lit("notes")).alias("n")).collect()}
    assert got == {0: '{"annotation":{"b":[1,"x"]},"volume":3}', 1: None, 2: None, 3: None, 4: None, 5: '{"classic_id":null,"work_title":"伤寒\\"论"}', 6: "own"}


def test_herb_text_is_computed_once(spark):
    text = F.translate("t", "x", "y")
    herb = spark.createDataFrame([("【性味】x甘温，主治【功效】补\n归脾经",)], "t string").select(curate.channels(text).alias("c"), curate.nature_flavor(text)[0].alias("n"))
    assert tuple(herb.first()) == ("脾经", "y甘温")
    assert herb._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 2


def test_tasks_of_a_list_are_fewer_than_its_runs(spark, tmp_path):
    pages = OrderedList(st.Store(spark, str(tmp_path)), "rows", [Key("id")])
    pages.build(spark.range(50_000).select("id"), range_rows=100)
    tasks = {re.search(r"/part-(\d+)", f)[1] for f in pages._table().inputFiles()}
    assert len(tasks) <= spark.sparkContext.defaultParallelism and pages._table() is pages._table()
    assert pages._table().select("_range").distinct().count() >= 500 and pages.total() == 50_000
    assert [r["id"] for r in pages.page(401, 100).collect()] == list(range(40_000, 40_100))
    assert [r["id"] for r in pages.after({"id": 40_049}, 100).collect()] == list(range(40_050, 40_150))


def test_plan_meets_few_items_without_a_shuffle_and_runs_once(spark):
    from quernstone.operators import imports

    items = spark.createDataFrame([(1, "herb", "n", "long text", "s")], "id long, type string, name string, content string, source_note string")
    drafts = items.select(F.col("id").alias("row_index"), "type", "name", F.lit("text").alias("content"), F.lit("s2").alias("source_note")).unionByName(
        items.select(F.lit(2).cast("long").alias("row_index"), "type", F.lit("other").alias("name"), "content", "source_note"))
    planned = imports.plan(drafts, items, "classic_text")
    plan = planned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "broadcast" in plan
    after, _, log = imports.execute(planned, items, 1)
    assert "Join" not in log._jdf.queryExecution().optimizedPlan().toString().split("Union")[-1].split("\n")[1]
    assert [tuple(r) for r in after.select("id", "name").orderBy("id").collect()] == [(1, "n"), (2, "other")]
