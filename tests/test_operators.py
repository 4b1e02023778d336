"""Operators on small fixtures: BM25 vectors, duplicates, imports, packages, the store, streams."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import history, imports, relations, resolve, search, store
from quernstone.sources import generate, records
from quernstone.streaming import live

ITEMS = "id long, type string, code string, name string, alias string, pinyin string, category string, content string"


@pytest.mark.parametrize("query, want", [("足三里", {1: -1.1436}), ("黄芪", {3: -1.0652}), ("味甘", {3: -0.7456}), ("st36", {1: -0.8248}), ("st3", {4: 0.0, 1: 0.0}), ("气", {})])
def test_bm25(spark, query, want):
    docs = spark.createDataFrame([(1, "足三里", "ST36", "足三里 足阳明胃经"), (2, "足阳明胃经", "ST", "足三里用于测试"), (3, "黄芪", "H0001", "补气 黄芪，味甘"), (4, "x", "ST3", "y")], "id long, name string, code string, content string")
    got = {r.id: r.bm25 for r in search.bm25(docs, ["name", "code", "content"], query).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_duplicates(spark):
    items = spark.createDataFrame([
        (1, "acupoint", "ST36", "足三里", None, "zusanli", "胃经", "a"), (2, "acupoint", "st36", "足三里穴", "足三里", "zusanli", "胃经", "b"),
        (3, "herb", "H0001", "黄芪", None, None, None, "c"), (4, "herb", "H0002", "黄耆", "黄芪", None, None, "d"),
    ], ITEMS)
    got = {(r.item_id, r.duplicate_id, r.match_type) for r in resolve.candidates(items).collect()}
    assert {(1, 2, "type_code_exact"), (1, 2, "name_alias_match"), (1, 2, "pinyin_category_suspect"), (1, 2, "fingerprint_match"), (3, 4, "name_alias_match")} == got


def test_star_is_linear(spark):
    rows = spark.range(500).select("id", F.lit("t").alias("type"), F.lit("n").alias("name_norm"))
    assert resolve.star(rows, ["type", "name_norm"], "type_name_exact").count() == 499


def test_suggestions(spark):
    items = spark.createDataFrame([
        (1, "herb", None, "黄芪", None, None, "", None), (2, "herb", None, "白术", "于术", None, "", None), (3, "formula", None, "补中益气汤", None, None, "黄芪 于术", None),
        (4, "meridian", "ST", "胃经", None, None, "", None), (5, "acupoint", "ST36", "足三里", None, "x", "", 4), (6, "acupoint", "st40", "丰隆", None, None, "", None),
        (7, "disease", None, "病", None, None, "用补中益气汤", None),
    ], "id long, type string, code string, name string, alias string, category string, text string, meridian_id long")
    got = {(r.source_id, r.target_id, r.relation_type, r.confidence) for r in relations.suggest(items).collect()}
    assert got == {(3, 1, "contains_herb", 0.86), (3, 2, "contains_herb", 0.86), (5, 4, "belongs_to_meridian", 0.96), (6, 4, "belongs_to_meridian", 0.84), (7, 3, "mentions_formula", 0.72)}


def test_mention_blocks_agree(spark):
    texts = spark.createDataFrame([(1, "ab cd"), (2, None), (3, "")], "id long, text string")
    wanted = spark.createDataFrame([(10, "abcd"), (11, "bc"), (12, "zz")], "target_id long, needle string")
    whole = sorted(map(tuple, relations.mentions(texts, wanted).collect()))
    assert whole == [(1, 10), (1, 11)] == sorted(map(tuple, relations.mentions(texts, wanted, needle_bytes=1).collect()))
    assert relations.mentions(texts, wanted.limit(0)).count() == 0


def test_detection():
    assert imports.detect_type("x/search_terms.json", []) == ("search_terms_v1", 0.98)
    assert imports.detect_type("a.json", ["type", "name", "content"]) == ("knowledge_items_v1", 0.94)
    assert imports.detect_type("a.json", ["canonical_key", "content", "source_note"]) == ("annotation_items_v1", 0.95)
    assert imports.detect_type("a.csv", ["x"], "csv") == ("generic_csv", 0.5)


def test_mapping_bands(spark):
    rows = spark.createDataFrame([(1, {"名称": "黄芪", "原文": "补气" * 20, "随机列": "z"})], "row_index long, record map<string,string>")
    told = {s["source"]: (s["target"], s["decision"]) for s in imports.score_mapping(rows, "herb")}
    assert told["名称"][0] == "name" and told["随机列"][1] == "ignore" and told["原文"][1] in ("auto", "confirm")


def test_plan_table(spark):
    items = spark.createDataFrame([(1, "herb", None, "A", None, None, None, "old text"), (2, "herb", None, "B", None, None, None, "")], ITEMS).withColumn("source_note", F.lit("book"))
    drafts = spark.createDataFrame([(1, "herb", "A", "other", "x"), (2, "herb", "A", "OLD  text", "x"), (3, "herb", "B", "new", "x"), (4, "herb", "C", "new", "x"), (5, "herb", "", "new", "x"), (6, "herb", "A", "", "x")], "row_index long, type string, name string, content string, source_note string")

    def actions(intent, policy=None):
        return {r.row_index: r.action for r in imports.plan(drafts, items, intent, policy).collect()}

    assert actions("other") == {1: "needs_review", 2: "skip_duplicate", 3: "merge_empty_fields", 4: "create_new", 5: "reject_invalid", 6: "reject_invalid"}
    assert actions("other", "ask_on_conflict")[3] == "needs_review"
    assert actions("annotation_enrichment")[1] == "attach_annotation" and actions("search_terms")[1] == "skip_duplicate" and actions("classic_text")[1] == "create_new"
    planned = imports.plan(drafts, items, "other")
    after, _, log = imports.execute(planned, items, 7)
    assert {r.id: (r.name, r.content) for r in after.collect()} == {1: ("A", "old text"), 2: ("B", "new"), 3: ("C", "new")}
    assert sorted(r.id for r in imports.rollback(items, after.select(items.columns), log, after.select(items.columns)).collect()) == [1, 2]


def test_packages(spark, tmp_path):
    root = tmp_path / "pack"
    (root / "json").mkdir(parents=True)
    (root / "json/knowledge_items_import.json").write_text(json.dumps({"rows": [{"type": "herb", "code": "H1", "name": "黄芪", "tags": ["a", "b"]}, {"name": "x"}]}), "utf-8")
    (root / "json/terms.json").write_text(json.dumps([{"item_code": "H1", "term": "qi", "term_type": "k", "weight": 900}]), "utf-8")
    manifest = {"files": [{"path": "json/knowledge_items_import.json", "type": "knowledge_items_v1", "target": "items", "primary": True}, {"path": "json/terms.json", "type": "search_terms_v1", "target": "terms"}, {"path": "gone.pdf", "type": "pdf", "required": False}], "import_order": ["items"]}
    (root / "import_manifest.json").write_text(json.dumps(manifest), "utf-8")
    pack = records.read_package(spark, str(root))
    assert [f["staged"] for f in pack["files"]] == [True, False, False]
    rows = records.attach_terms(pack["rows"], pack["terms"]).orderBy("row_index").collect()
    assert rows[0].record["tags"] == '["a", "b"]' and rows[0].package_terms[0].weight == 200 and rows[1].package_terms is None
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        for f in root.rglob("*.json"):
            z.write(f, f"top/{f.relative_to(root)}")
    assert records.read_package(spark, str(tmp_path / "pack.zip"))["rows"].count() == 2
    (root / "import_manifest.json").unlink()
    assert records.read_package(spark, str(root))["rows"].count() == 2
    (root / "json/knowledge_items_import.json").unlink()
    with pytest.raises(records.SourceError):
        records.read_package(spark, str(root))


def test_record_formats():
    assert records.csv_records('﻿名称,编号,编号\r\n"a ""q""\nb",1\r\n\r\n') == [{"名称": 'a "q"\nb', "编号": ""}]
    with pytest.raises(records.SourceError):
        records.csv_records('a,b\n"x')
    with pytest.raises(records.SourceError):
        records.json_records("[1]")
    assert records.json_records('{"a": 1}') == [{"a": "1"}]


def test_xlsx(tmp_path):
    import io

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>黄芪</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row/><row><c r="A3" t="s"><v>1</v></c><c r="C3"><v>5</v></c></row></sheetData></worksheet>')
    assert records.xlsx_records(data.getvalue()) == [{"name": "黄芪", "n": "5"}]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.write("items", spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    s.write("notes", spark.createDataFrame([(1, 1), (2, 2)], "id long, item_id long"))
    s.upsert("items", spark.createDataFrame([(2, "B"), (3, "c")], "id long, name string"), ["id"])
    assert sorted(map(tuple, s.read("items").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    s.backup(["items"], str(tmp_path / "backup"))
    s.delete("items", spark.createDataFrame([(1,)], "id long"), children={"notes": "item_id"})
    assert [r.id for r in s.read("notes").collect()] == [2] and s.read("items").count() == 2
    s.restore(["items"], str(tmp_path / "backup"))
    assert s.read("items").count() == 3
    s.clear(["items"])
    assert s.read("items").count() == 0 and s.versions("items") == [1, 2, 3, 4, 5]


def test_versions(spark):
    items = spark.createDataFrame([(1, "a")], "id long, name string")
    versions = spark.createDataFrame([(1, 1, '{"item": {"id": 1, "name": "old"}}')], "item_id long, version_no int, snapshot string")
    assert history.with_snapshot(items, versions).first().version_no == 2
    assert history.rolled_back(items, versions, 1, 1).first().name == "old"


def test_generator(spark):
    items = generate.items(spark, 10).orderBy("id").collect()
    assert [r.code for r in items[:5]] == ["ST36", "ST", "H0001", "F0001", "T00005"]
    assert generate.relations(spark, 47, 200).count() < 200 == generate.relations(spark, 47, 200, loops="retarget").count()


def test_other_generators(spark):
    assert imports.stage(generate.import_rows(spark, 5)).where("status = 'valid'").count() == 5
    assert generate.duplicates(spark, 10, 40).agg(F.max("score")).first()[0] == pytest.approx(0.99)
    assert generate.suggestions(spark, 47, 100).count() == 100


def test_top_n(spark):
    rows = spark.createDataFrame([(1, 5), (1, 7), (1, 6), (2, 1)], "item_id long, at long")
    assert sorted(map(tuple, store.latest(rows, ["item_id"], [F.desc("at")], 2).collect())) == [(1, 6), (1, 7), (2, 1)]


def test_answers(spark):
    from quernstone.operators import answers

    assert answers.query_terms("请问太阳病用什么方？桂枝汤") == ["请问太阳病用什么方", "桂枝汤", "太阳病"]
    assert answers.query_terms("  ") == [] and answers.asks_for_medicine("咳嗽怎么治") and not answers.asks_for_medicine("咳嗽扎什么穴")


def test_rules_and_maintenance(spark):
    rules = [{"field_name": "code", "rule_type": "pattern", "rule_params": {"pattern": "^H"}, "severity": "warning", "message": "code"}, {"field_name": "kind", "rule_type": "enum", "rule_params": {"allowed_values": ["a"]}, "severity": "error", "message": "kind"}, {"field_name": "name", "rule_type": "required", "severity": "error", "message": "name"}]
    row = spark.createDataFrame([("X1", "b", " ")], "code string, kind string, name string")
    found = row.select(F.filter(F.array(*imports.rule_issues(rules, F.col)), lambda i: i.isNotNull()).alias("i")).first().i
    assert [i.message for i in found] == ["code", "kind", "name"]
    assert imports.infer_intent(None, "classics_curated_v1", "x") == "classic_text" and imports.infer_intent(None, None, "search_terms_v1") == "search_terms"


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    stream = live.event_stream(spark, folder, events.schema)
    live.run_to_end(live.windowed_counts(stream, size="1 day"), "daily", str(tmp_path / "c1"), mode="complete")
    assert spark.sql("select sum(n) from daily").first()[0] == events.count()
    s = store.Store(spark, str(tmp_path / "live"))
    query = stream.writeStream.foreachBatch(live.upsert_sink(s, "latest", ["user_id"], "ts")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r.user_id: r.ts for r in events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).collect()}
    assert {r.user_id: r.ts for r in s.read("latest").collect()} == want


def test_every_item_that_a_row_meets(spark):
    """Two items with one alias are both candidates of a row of that name."""
    from quernstone.operators import resolve

    schema = "id long, type string, code string, name string, alias string, pinyin string, category string"
    items = spark.createDataFrame([(1, "h", "A1", "x", "y|zz", None, None), (2, "h", "A2", "w", "zz", None, None), (3, "g", None, "zz", None, None, None)], schema)
    rows = spark.createDataFrame([(9, "h", None, "ZZ", None, None, None), (10, "h", "a-2", "new", None, None, None)], schema)
    links, members = resolve.row_candidates(rows, items)
    got = {tuple(r) for r in resolve.candidate_pairs(links, members, rows.select(F.col("id").alias("row_id"))).collect()}
    assert got == {(9, 1, "name_alias_match", 0.9), (9, 2, "name_alias_match", 0.9), (10, 2, "type_code_exact", 1.0), (10, 2, "fingerprint_match", 0.95)}
    assert {(r.row_id, r.match_type): r.n_items for r in links.collect()}[9, "name_alias_match"] == 2


def test_headers_met_late_are_kept(spark):
    from quernstone.operators import imports

    rows = [(i, {"名称": f"n{i}"}) for i in range(25)] + [(25, {"名称": "last", "功效": "补气", "无关": "x"})]
    df = spark.createDataFrame(rows, "row_index long, record map<string,string>")
    mapped = imports.apply_mapping(df, "herb", imports.score_mapping(df, "herb"))
    last = mapped.where("row_index = 25").first()["record"]
    assert last["name"] == "last" and last["effects"] == "补气" and "无关" not in last and imports.headers(df) == ["功效", "名称", "无关"]


def test_working_tables_need_a_shared_folder_off_local_mode():
    import pytest

    from quernstone.operators.store import shared_folder

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(), "x")


def test_header_mapping_like_a_loop_over_the_fields(spark, sf):
    from quernstone.functions import text as T
    from quernstone.functions.udfs import jaro_value
    from quernstone.plans import registry

    def one(header):
        key = T.header_key_text(header)
        if key in imports.ALIAS_TARGET:
            return imports.ALIAS_TARGET[key].removeprefix("detail.")
        best, top = None, imports.NEAR_FIELD
        for field in imports.TARGET_FIELDS:  # strictly better ones alone: of equal ones the first stays
            score = jaro_value(key, T.header_key_text(field))
            if score > top:
                best, top = field, score
        return best

    got = {r.header: r.field for r in registry.QUERIES["header_mapping"](spark, sf).collect()}
    assert len(got) > 100 and all(one(h) == f for h, f in got.items())
    told = spark.createDataFrame([("名称",), ("qqqq",), ("meridian_cod",), ("",)], "header string")
    assert {r.header: r.field for r in imports.auto_mapping(told).collect()} == {h: one(h) for h in ("名称", "qqqq", "meridian_cod", "") if one(h)}


def test_two_writers_conflict(spark, tmp_path):
    """Of two writers that began at one version the second fails, and the first one's rows stay."""
    one, two = (store.Store(spark, str(tmp_path / "store")) for _ in range(2))
    rows = spark.range(10).withColumnRenamed("id", "k")
    one.write("t", rows, keys=["k"])
    base = two.manifest("t")
    one.upsert("t", spark.createDataFrame([(99,)], "k long"), ["k"])
    with pytest.raises(store.Conflict):
        two._commit("t", base, {**base, "folders": []})
    assert one.read("t").count() == 11
    one.append("t", spark.createDataFrame([(100, "x")], "k long, extra string"))
    assert one.read("t").count() == 12 and one.read("t").where("extra is not null").count() == 1
    assert one.vacuum("t") and one.read("t").count() == 12 and len(one.versions("t")) == 1


def test_restore_checks_the_backup(spark, tmp_path):
    import shutil

    s = store.Store(spark, str(tmp_path / "store"))
    s.write("a", spark.range(5).toDF("id"))
    assert s.backup(["a"], str(tmp_path / "one")) == {"a": 5}
    s.append("a", spark.range(5, 7).toDF("id"))
    with pytest.raises(FileNotFoundError):
        s.restore(["a", "b"], str(tmp_path / "one"))
    s.restore(["a"], str(tmp_path / "one"), safety=str(tmp_path / "safe"))
    assert s.read("a").count() == 5 and spark.read.parquet(str(tmp_path / "safe/a")).count() == 7
    shutil.copytree(tmp_path / "one", tmp_path / "two")
    for f in sorted((tmp_path / "two/a").glob("part-*"))[:1]:
        f.unlink()
    for f in (tmp_path / "two/a").glob(".part-*"):
        f.unlink()
    if spark.read.parquet(str(tmp_path / "two/a")).count() != 5:
        with pytest.raises(ValueError):
            s.restore(["a"], str(tmp_path / "two"))
    assert s.read("a").count() == 5


def test_index_follows_its_table(spark, tmp_path):
    """A table that is rewritten gets a new index; degrees are counted anew for the items asked alone."""
    from quernstone.operators.index import SearchIndex
    from quernstone.plans import stored

    path = str(tmp_path / "t.parquet")

    def ask(text):
        rows = spark.createDataFrame([(1, text)], "id long, content string")
        rows.write.mode("overwrite").parquet(path)
        return stored.index(spark, path, "t", lambda: spark.read.parquet(path), ["content"]).bm25("beta").count()

    assert [ask("alpha"), ask("alpha beta"), ask("alpha")] == [0, 1, 0]
    index = SearchIndex(store.Store(spark, str(tmp_path / "s")), ["name"], detail_is_json=False)
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    edge = "source_id long, target_id long, relation_type string"
    index.build(items, spark.createDataFrame([(1, 2, "r"), (2, 3, "r")], edge))
    index.edges_changed(spark.createDataFrame([(1, 2, "r")], edge), spark.createDataFrame([(2,), (3,)], "id long"))
    assert {(r.item_id, r.n) for r in index.store.read("degrees").collect()} == {(1, 1), (2, 1)}
    for query in ("...", "", "_"):
        assert index.bm25(query).count() == 0


def test_candidates_by_grams_are_not_sent_through_the_driver(spark):
    """Candidates of texts and needles compress so well that their bytes don't tell how many they are."""
    texts = spark.createDataFrame([(i, f"some words {i % 3}") for i in range(20)], "source_id long, text string")
    wanted = spark.createDataFrame([(1, "word"), (2, "ords1"), (3, "none")], "target_id long, needle string")
    found = relations.by_grams(texts.withColumn("text", F.replace("text", F.lit(" "), F.lit(""))), wanted)
    assert "SortMergeJoin [source_id" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted([(i, 1) for i in range(20)] + [(i, 2) for i in range(20) if i % 3 == 1])


def test_a_detail_is_parsed_once_however_often_its_fields_are_read(spark):
    rows = spark.createDataFrame([({"name": "n", "effects": "own", "detail": '{"功效": "e", "Page-Title": "p", "page_title": "q", "x": null}'},), ({"name": "n", "detail": "no object"},)], "record map<string,string>")
    lifted = rows.select(imports.lift_detail(F.col("record")).alias("record"))
    assert lifted._jdf.queryExecution().analyzed().toString().count("from_json(") == 2  # texts, and values as they are
    got = [r.record for r in lifted.collect()]
    assert got[0] == {"name": "n", "effects": "own", "Page-Title": "p", "page_title": "q", "notes": '{"page_title":"p"}', "source_note": "q"}
    assert got[1] == {"name": "n"}


def test_targets_of_equal_needles_are_one_class(spark):
    wanted = spark.createDataFrame([(i, "red") for i in range(1, 9)] + [(9, "red"), (9, "blue")], "target_id long, needle string")
    members, named = relations.needle_classes(wanted)
    assert sorted(map(tuple, members.collect())) == [(1, i) for i in range(1, 9)] + [(9, 9)]
    assert sorted(map(tuple, named.collect())) == [(1, "red"), (9, "blue"), (9, "red")]
    texts = spark.createDataFrame([(1, "redblue"), (2, "blue"), (3, "green")], "source_id long, text string")
    for most in (0, 1 << 20):
        found = sorted(map(tuple, relations.held(texts, wanted, needle_bytes=most).collect()))
        assert found == [(1, i) for i in range(1, 10)] + [(2, 9)]


def test_needles_are_met_whole_and_no_candidate_is_looked_for_in_its_text(spark):
    long = "an unusually long needle that is met by its rarest gram and not whole".replace(" ", "")
    texts = [(1, "abcabcab"), (2, "日本語😀abc"), (3, ""), (4, None), (5, "x" * 40 + "y"), (6, f"_{long}_abc"), (7, "ab" * 70_000 + "ca"), (8, "nothing")]
    needles = ["a", "ab", "abc", "bcab", "cabcab", "本", "語😀a", "x" * 40, "x" * 40 + "y", "babababababac", "bca", "zz", "本語😀b"]
    frame = spark.createDataFrame(texts, "source_id long, text string")

    def asked(needles, texts=texts):
        wanted = spark.createDataFrame([(k // 2, n) for k, n in enumerate(needles, 100)], "target_id long, needle string")
        told = {(i, t) for i, text in texts for t, n in wanted.collect() if text and n in text}
        found = relations.held(spark.createDataFrame(texts, "source_id long, text string"), wanted, needle_bytes=0)
        return found, sorted(map(tuple, found.collect())) == sorted(told)

    assert asked(needles + [long])[1] and asked([*needles, "ab", "abc"])[1] and asked(["a", "ab"], [*texts, (1, "ab"), (1, "b")])[1]
    found = relations.held(frame, spark.createDataFrame(list(enumerate(needles)), "target_id long, needle string"), needle_bytes=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in plan and "BroadcastHashJoin" not in plan
    assert sorted(map(tuple, found.collect())) == sorted((i, k) for i, text in texts for k, n in enumerate(needles) if text and n in text)


def test_runs_of_one_hash_are_told_apart():
    own = relations.Windows(["abcab", "", "xabc"])
    at = np.array([0, 1, 2, 5, 6])
    for h in (own.hashes(at, 3), np.zeros(5, np.uint64)):
        names, run, text = own.pieces(at, h, 3)
        assert sorted((names[r], t) for r, t in zip(run, text)) == [("abc", 0), ("abc", 2), ("bca", 0), ("cab", 0), ("xab", 2)]


def test_rows_of_a_hot_key_are_not_dealt_to_one_task(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "herb", None, "Red" if i % 4 else f"n{i}", None, None, None, None) for i in range(40)], ITEMS)
    items = spark.createDataFrame([(i, "herb", None, n, None, None, None, None) for i, n in ((100, "red"), (101, "red"), (102, "n8"))], ITEMS)
    monkeypatch.setattr(resolve, "HOT_ROWS", 5)
    links, _ = resolve.row_candidates(rows, items)
    got = {(r.row_id, r.class_id, r.match_type, r.n_items) for r in links.collect()}
    assert got == {(i, 102 if i == 8 else 100, m, 1 if i == 8 else 2) for i in range(40) if i % 4 or i == 8 for m in ("type_name_exact", "fingerprint_match")}


def test_row_keys_are_small_and_met_like_their_values(spark, monkeypatch):
    """Keys were hex digests of 64 characters, three or four a row, written, counted by a shuffle and dealt."""
    rng = np.random.default_rng(3)

    def some(*values):
        return [values[i] for i in rng.integers(0, len(values), 60)]

    kinds = some("h", "g", None, "a|code|B", ""), some("A1", "a-1", None, "", "B"), some("x", "X ", "yy", None, "", "w"), some("x", "x,yy;zz", None, "yy|x", "w"), some("p", "P1", None), some("c", None, "a|code|1", "x")
    both = [(i, *values, None) for i, values in enumerate(zip(*kinds))]
    rows, items = (spark.createDataFrame(part, ITEMS) for part in (both[:30], both[30:]))
    monkeypatch.setattr(resolve, "materialized", None)  # nothing is written
    told = {(r.id, i.id, rule) for r in resolve.keyed(rows).collect() for i in resolve.keyed(items).collect() for rule, same in {
        "type_code_exact": None not in (r.type, r.code_norm) and (r.type, r.code_norm) == (i.type, i.code_norm),
        "type_name_exact": None not in (r.type, r.name_norm) and (r.type, r.name_norm) == (i.type, i.name_norm),
        "pinyin_category_suspect": None not in (r.type, r.pinyin_norm, r.category_norm) and (r.type, r.pinyin_norm, r.category_norm) == (i.type, i.pinyin_norm, i.category_norm),
        "fingerprint_match": r.fingerprint == i.fingerprint,
        "name_alias_match": None not in (r.type, r.name_norm) and r.type == i.type and r.name_norm in (i.alias_norm or "").split("|"),
    }.items() if same}
    assert len({rule for *_, rule in told}) == 5
    for most in (2, 100_000):
        monkeypatch.setattr(resolve, "HOT_ROWS", most)
        links, members = resolve.row_candidates(rows, items)
        assert {tuple(r)[:3] for r in resolve.candidate_pairs(links, members, rows.select(F.col("id").alias("row_id"))).collect()} == told
        found = {(r.row_id, r.match_type): (r.class_id, r.n_items, r.score, len(r.key)) for r in links.collect()}
        assert len(found) == links.count()
        items_of = {k: [i for r, i, rule in told if (r, rule) == k] for k in found}
        assert found == {k: (min(v), len(v), resolve.SCORES[k[1]], 16) for k, v in items_of.items()} and found.keys() == {(r, rule) for r, _, rule in told}
