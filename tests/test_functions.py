"""Scalar vectors of the functions."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import udfs
from quernstone.functions import values as V
from quernstone.operators import curate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("made, want", [
    (lambda: T.normalize(F.lit("　ＳＴ ３６ ")), "st36"),
    (lambda: T.normalize(F.lit("Zu San Li")), "zusanli"),
    (lambda: T.code_key(F.lit("st-36")), "ST36"),
    (lambda: T.alias_key(F.lit("黄耆，北芪;黄耆")), "|北芪|黄耆|"),
    (lambda: T.alias_key(F.lit("")), "||"),
    (lambda: T.split_join(F.lit("a，b;;c/d")), "a,b,c/d"),
    (lambda: T.valid_code(F.lit("ST36")), True),
    (lambda: T.valid_code(F.lit("st36")), False),
    (lambda: T.valid_code(F.lit("36ST")), False),
    (lambda: T.valid_code(F.lit("A_1-2")), True),
    (lambda: F.round(T.overlap_similarity(F.lit("abc"), F.lit("abd")), 3), 0.667),
    (lambda: F.round(udfs.jaro_winkler(F.lit("abcd"), F.lit("axyz")), 6), 0.55),
    (lambda: V.chinese_number(F.lit("半")), 0.5),
    (lambda: V.chinese_number(F.lit("十")), 10.0),
    (lambda: V.chinese_number(F.lit("十二")), 12.0),
    (lambda: V.chinese_number(F.lit("三十")), 30.0),
    (lambda: V.chinese_number(F.lit("二半")), 2.5),
    (lambda: V.chinese_number(F.lit("三百")), None),
    (lambda: T.half_width(F.lit("ＡＢ，１")), "AB,1"),
    (lambda: T.merge_tags(F.lit("A,b"), F.lit("B，c")), "A，b，c"),
    (lambda: T.percent_encode(F.lit("a b~*/")), "a%20b~%2A%2F"),
    (lambda: T.unescape(T.strip_tags(F.lit("<b>a&amp;lt;</b> > c<d"))), "a<  c"),
    (lambda: T.item_type(F.lit("穴位")), "acupuncture"),
    (lambda: T.item_type(F.lit(None).cast("string")), "note"),
    (lambda: T.labelled_text(F.lit("x功效：补气。主治：虚"), ["功效：", "主治："]), "补气"),
    (lambda: T.labelled_section(F.lit("【性味】甘温【归经】脾"), "性味", ["性味", "归经"]), "甘温"),
    (lambda: T.truncate(F.lit("abcdef"), 3), "abc..."),
    (lambda: V.amount(F.lit(2.5)), "2.5"),
    (lambda: V.amount(F.lit(3.0)), "3"),
    (lambda: V.lenient_long(F.lit(" 12.9 ")), 12),
    (lambda: curate.without_reminders(F.lit("甘草 。仅供学习参考。请勿服用。")), "甘草。"),
    (lambda: curate.first_rule(F.lit("大 寒"), curate.NATURE_RULES), "deep-cold"),
    (lambda: curate.first_rule(F.lit("ST36"), curate.ELEMENT_RULES), "earth"),
    (lambda: T.canonical_key(F.lit("classic_passage:B:N:001"))[0], "syndrome"),
    (lambda: T.canonical_key(F.lit("classic_passage:B:N:001"))[1], "N"),
    (lambda: T.canonical_key(F.lit("acupoint:X"))[1], "X"),
    (lambda: T.canonical_key(F.lit("x"))[0], "note"),
    (lambda: udfs.flatten_json(F.lit('{"b": [1, true, " x "], "a": null}')), "1 true x"),
])
def test_vectors(spark, made, want):
    assert one(spark, made()) == want


def test_ratio():
    assert udfs.ratio_text("桂枝三两 芍药三两 甘草二两 生姜三两 大枣十二枚") == "桂枝 : 芍药 : 甘草 : 生姜 = 3 : 3 : 2 : 3；大枣十二枚另计。"
    assert udfs.ratio_text("甘草一两") is None


def test_clean_lines():
    text = "乌头汤方 治脚气。\n乌头汤方\n麻黄\n麻黄三两\n倪海厦注\n勤求古訓 博采眾方\n乌头\n呚\n五枚\n【原PDF对应页完整文本校对备份】\n校排"
    cleaned = udfs.clean_lines_text(text, "乌头汤方")
    assert cleaned.splitlines()[0] == "乌头汤方 治脚气。" and "麻黄三两" in cleaned and "五枚" in cleaned
    assert "倪海厦注" not in cleaned and "呚" not in cleaned and "\n麻黄\n" not in cleaned


def test_formula_names():
    assert udfs.formula_names_in("用：桂枝汤、麻黄汤。小青龙汤。桂枝汤；汤") == ["桂枝汤", "麻黄汤", "小青龙汤"]


def test_card(spark):
    card = curate.formula_card(F.lit("桂枝汤"), F.lit("主治：中风。"), F.lit(None).cast("string"))
    row = spark.range(1).select(card.alias("c"), curate.answer(card).alias("a")).first()
    assert row.c.missing_composition and row.c.indications == "中风" and row.a == "### 桂枝汤\n- 主治：中风"
