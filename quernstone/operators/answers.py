"""Retrieval for questions: query terms, context selection, formula candidates."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from quernstone.functions import text as T
from quernstone.functions.udfs import formula_names, formula_names_in, ratio
from quernstone.operators.relations import held
from quernstone.operators.search import contains_ci
from quernstone.operators.store import materialized

# Conditions that are terms of their own, filler phrases, and characters that edge a term.
MARKERS = ["太阳病", "少阳病", "阳明病", "太阴病", "少阴病", "厥阴病", "上热下寒", "长期咳嗽", "久咳", "咳嗽"]
FILLERS = ["如果", "请问", "应该", "可以", "什么药", "用药", "用什么", "怎么治", "治疗", "长期"]
EDGES = "有哪些可以参考什么方向的组成用药治"
BREAKS = r"[\s，。、；;:：？?！!]"
NEEDLE_TYPES = ["acupuncture", "acupoint", "meridian"]


def query_terms(question: str) -> list[str]:
    """Formula names, known conditions and what is left of the question's parts without fillers; at least the question."""
    full = question.strip()
    out = dict.fromkeys([*formula_names_in(full), *(m for m in MARKERS if m in full)])
    for part in re.split(BREAKS, full):
        bare = part
        for f in FILLERS:
            bare = bare.replace(f, "")
        bare = bare.strip(EDGES).strip()
        if len(bare) >= 2:
            out.setdefault(bare)
    return list(out) or ([full] if full else [])


def asks_for_medicine(question: str) -> bool:
    return not any(w in question for w in T.NEEDLE_WORDS) and any(w in question for w in T.MEDICINE_WORDS)


FIELDS = ["name", "alias", "category", "summary", "content", "source_note", "tags", "detail"]


def matches(term: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(contains_ci(c, term), F.lit(False)) for c in columns))


def context_items(items: DataFrame, question: str, *, max_items: int = 8) -> DataFrame:
    """Items that match a term of the question, with ``seq``, the first such term: formulas first, then by term, then id.

    A question about medicine leaves out needle types. Three times ``max_items`` are kept for the budget to choose from.
    """
    terms = query_terms(question)
    seq = F.coalesce(*(F.when(matches(t, ["name", "alias", "summary", "content", "tags", "detail"]), i) for i, t in enumerate(terms)))
    found = items.withColumn("seq", seq).where(F.col("seq").isNotNull())
    if asks_for_medicine(question):
        found = found.where(~F.col("type").isin(NEEDLE_TYPES))
    return found.orderBy(F.desc(F.col("type") == "formula"), "seq", "id").limit(3 * max_items)


def name_hits(items: DataFrame, names: DataFrame, score: int) -> DataFrame:
    """(item_id, score) for each formula whose name is one of ``names(name)``, for every time that it is named."""
    formulas = items.where("type = 'formula'").select(F.col("id").alias("item_id"), "name")
    return names.join(formulas, "name").select("item_id", F.lit(score).alias("score"))


def formula_scores(items: DataFrame, annotations: DataFrame, question: str, *, related_id: int | None = None) -> DataFrame:
    """(item_id, score): what speaks for each formula, summed over all hits.

    200 for the related formula itself, 120 for names in its text, 160 for names in the question, 90 for a term in any
    of its fields or its annotations, 70 and 65 for names in other items and annotations that hold a term.
    """
    spark = items.sparkSession
    formulas = items.where("type = 'formula'")
    hits = [name_hits(items, spark.createDataFrame([(n,) for n in formula_names_in(question)], "name string"), 160)]
    if related_id is not None:
        related = items.where(F.col("id") == related_id)
        hits.append(related.where("type = 'formula'").select(F.col("id").alias("item_id"), F.lit(200).alias("score")))
        named = related.select(F.explode(formula_names(F.concat_ws("\n", "name", "content", "summary", "detail"))).alias("name"))
        hits.append(name_hits(items, named, 120))
    for term in query_terms(question):
        hits.append(formulas.where(matches(term, FIELDS)).select(F.col("id").alias("item_id"), F.lit(90).alias("score")))
        others = items.where((F.col("type") != "formula") & matches(term, [f for f in FIELDS if f not in ("alias", "category")]))
        named = others.select(F.explode(formula_names(F.concat_ws("\n", "name", "content", "summary", "detail"))).alias("name"))
        hits.append(name_hits(items, named, 70))
        notes = annotations.where(matches(term, ["content"]))
        hits.append(notes.join(formulas.select(F.col("id").alias("item_id")), "item_id", "left_semi").select("item_id", F.lit(90).alias("score")))
        hits.append(name_hits(items, notes.select(F.explode(formula_names("content")).alias("name")), 65))
    return reduce(DataFrame.unionByName, hits).groupBy("item_id").agg(F.sum("score").alias("score"))


# many questions at once


@F.pandas_udf(ty.ArrayType(ty.StringType()))
def _terms_of(questions: pd.Series) -> pd.Series:
    return questions.map(lambda q: [] if q is None else query_terms(q))


@F.pandas_udf(ty.BooleanType())
def _for_medicine(questions: pd.Series) -> pd.Series:
    return questions.map(lambda q: q is not None and asks_for_medicine(q))


NAMING = ["name", "content", "summary", "detail"]


def _asked(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question_id, medicine, seq, term_id) of every term of every question, and the distinct terms (target_id, needle)."""
    told = questions.select("question_id", _for_medicine("question").alias("medicine"), F.posexplode(_terms_of("question")).alias("seq", "term"))
    told = materialized(told.withColumn("needle", F.lower("term")), "asked")
    terms = materialized(told.select("needle").distinct().select(F.monotonically_increasing_id().alias("target_id"), "needle"), "asked-terms")
    return told.join(terms, "needle").select("question_id", "medicine", "seq", F.col("target_id").alias("term_id")), terms


def _holding(rows: DataFrame, columns: list[str], terms: DataFrame, key: str = "id") -> DataFrame:
    """(id, term_id): which rows hold which term in one of the columns, in either case. One pass whatever the number of terms."""
    apart = F.concat_ws("\x1f", *(F.lower(F.col(c).cast("string")) for c in columns))  # no term reaches over two columns
    found = held(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("source_id"), apart.alias("text")), terms)
    return found.select(F.col("source_id").alias("id"), F.col("target_id").alias("term_id"))


def context_items_of(items: DataFrame, questions: DataFrame, *, max_items: int = 8) -> DataFrame:
    """``context_items`` of all ``questions(question_id, question)`` in one plan: (question_id, id, seq, place).

    Ids of questions and of items are distinct, and item ids whole numbers. The distinct terms of all questions are looked for
    in one pass over the items; a question's best are ranked in each task before they are shuffled. ``%`` and ``_`` stand for
    themselves here. A null or empty question, and one whose terms no item holds, has no rows.
    """
    asked, terms = _asked(questions)
    found = _holding(items, ["name", "alias", "summary", "content", "tags", "detail"], terms)
    hits = found.join(asked, "term_id").join(items.select("id", "type"), "id")
    hits = hits.where(~(F.col("medicine") & F.col("type").isin(NEEDLE_TYPES)))
    per = hits.groupBy("question_id", "id", "type").agg(F.min("seq").alias("seq"))
    best = Window.partitionBy("question_id").orderBy(F.desc(F.col("type") == "formula"), "seq", "id")
    return per.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 3 * max_items).select("question_id", "id", "seq", "place")


def formula_scores_of(items: DataFrame, annotations: DataFrame, questions: DataFrame) -> DataFrame:
    """``formula_scores`` of all ``questions(question_id, question, related_id)`` in one plan: (question_id, item_id, score).

    What speaks for a formula by a term is summed by term first, once for all questions that ask it; items and annotations
    are read once whatever the number of questions. ``%`` and ``_`` stand for themselves here.
    """
    asked, terms = _asked(questions)
    formulas = items.where("type = 'formula'")
    others = items.where("type != 'formula'")
    named = materialized(formulas.select(F.col("id").alias("item_id"), "name"), "formula-names")

    def by_name(names: DataFrame, score: int) -> DataFrame:
        """Rows with a column name, and the formulas of that name in its place."""
        return names.join(named, "name").drop("name").withColumn("score", F.lit(score))

    texts = F.concat_ws("\n", *NAMING)
    notes = annotations.select(F.monotonically_increasing_id().alias("id"), "item_id", "content")
    notes = materialized(notes, "annotations")
    in_others = _holding(others, [f for f in FIELDS if f not in ("alias", "category")], terms)
    in_notes = materialized(_holding(notes, ["content"], terms), "noted-terms")
    told_others = others.select("id", F.explode(formula_names(texts)).alias("name"))
    told_notes = notes.select("id", F.explode(formula_names("content")).alias("name"))
    by_term = [
        _holding(formulas, FIELDS, terms).select("term_id", F.col("id").alias("item_id"), F.lit(90).alias("score")),
        in_others.join(by_name(told_others, 70), "id").select("term_id", "item_id", "score"),
        in_notes.join(notes.select("id", "item_id"), "id").join(named.select("item_id"), "item_id", "left_semi").select("term_id", "item_id", F.lit(90).alias("score")),
        in_notes.join(by_name(told_notes, 65), "id").select("term_id", "item_id", "score"),
    ]
    sums = reduce(DataFrame.unionByName, by_term).groupBy("term_id", "item_id").agg(F.sum("score").alias("score"))
    related = questions.select("question_id", F.col("related_id").alias("id")).where("id is not null").join(items, "id")
    by_question = [
        asked.select("question_id", "term_id").join(sums, "term_id").select("question_id", "item_id", "score"),
        by_name(questions.where("question is not null").select("question_id", F.explode(formula_names("question")).alias("name")), 160),
        related.where("type = 'formula'").select("question_id", F.col("id").alias("item_id"), F.lit(200).alias("score")),
        by_name(related.select("question_id", F.explode(formula_names(texts)).alias("name")), 120),
    ]
    every = reduce(DataFrame.unionByName, (h.select("question_id", "item_id", F.col("score").cast("long").alias("score")) for h in by_question))
    return every.groupBy("question_id", "item_id").agg(F.sum("score").alias("score"))


# cards with sources, and answers made of them

# Where a part of a card stands, in the detail by key and in texts by label, and how many annotations are shown.
CARD_KEYS = {
    "composition": ["composition", "ingredients", "originalFormula", "original_formula", "formula_composition"],
    "original_dosage": ["originalDosage", "original_dosage", "dosage"], "usage": ["usage", "administration", "preparation"],
    "decoction_method": ["decoctionMethod", "decoction_method", "preparation"],
    "original_text": ["originalText", "original_text", "sourceText", "source_text", "classic_original"],
    "indications": ["indications", "pattern", "symptoms"], "explanation": ["explanation", "niNote", "ni_note", "notes"],
    "contraindications": ["contraindications", "precautions"], "related_pattern": ["pattern", "clauseNo", "clause_no"],
}
COMPOSITION_LABELS, NOTED_COMPOSITION_LABELS = ["组成", "原方组成", "本地资料原方组成"], ["组成", "原方组成"]
USAGE_LABELS, DECOCTION_LABELS, NOTED_EXPLANATION_LABELS = ["煎服法", "服法", "用法"], ["煎服法", "煎法"], ["方义", "注解", "倪注"]
NOTES_READ, NOTES_SHOWN, SNIPPET, EXPLAINED = 8, 4, 150, 220
HEADINGS = {
    "composition": "本地资料原方组成：", "ratio": "药材比例：", "usage": "原文煎服法：", "indications": "适用描述 / 关联证候：", "explanation": "本地注解摘要：",
    "contraindications": "谨慎或不适用情况：", "sources": "资料依据：",
}
FORMULA_LINE, NO_COMPOSITION, NO_SOURCE, CARD_END = "方剂：", "本地资料中未检索到完整组成。", "* 未记录来源；该卡片仅可作为待补来源资料。", "---"
ANSWER_HEAD, ASKED_LINE = "本回答基于本地知识库检索，展示的是本地资料原方信息和古籍/讲义原文记录。", "问题："
DOSE_WORDS = ["克", "吃几天", "直接告诉我"]
DOSE_LIMIT = "剂量边界：可以展示本地资料中的原文剂量和比例，但不直接给个人服用剂量、加减和疗程；实际用药需由专业中医师结合面诊确认。"
NOTHING_MADE_UP = "提示：没有来源支撑的方剂组成不会编造。"


def labelled(c, labels: list[str]) -> Column:
    """The text behind the first place of a label, colons and blanks left out, up to a line's end or a full stop; of the labels
    the first that has one."""
    text = T.col(c)

    def one(label: str) -> Column:
        tail = F.regexp_replace(F.substr(text, F.instr(text, label) + len(label)), r"\A[：: \n\r]+", "")
        return F.when(F.contains(text, F.lit(label)), T.blank_to_null(F.regexp_extract(tail, r"\A[^\n。]*", 0)))

    return F.coalesce(*map(one, labels))


def _camel(key: str) -> str:
    first, *rest = key.split("_")
    return first + "".join(w[:1].upper() + w[1:] for w in rest)


def _picked(detail: Column, keys: list[str]) -> Column:
    """The first of the keys, or its camel form, that has a text; the texts of a list are joined."""
    tried = []
    for key in dict.fromkeys(k for key in keys for k in (key, _camel(key))):
        value = F.try_element_at(detail, F.lit(key))
        parts = F.array_join(F.from_json(F.when(F.startswith(value, F.lit("[")), value), "array<string>"), "，")
        tried.append(T.blank_to_null(F.coalesce(parts, value)))
    return F.coalesce(*tried)


def formula_cards(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """A card of each formula: its parts from the detail, else from labels in the content and the annotations; the snippets of the
    latest annotations; the distinct sources that have a title or note, the item's own first.

    Items have source_package and category; annotations item_id, id, created_at, source_title, source_note and content. Of an item
    the latest eight annotations are read, as many as a card may rest on; they are ranked in each task before the shuffle.
    """
    latest = Window.partitionBy("item_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = annotations.withColumn("_place", F.row_number().over(latest)).where(F.col("_place") <= NOTES_READ)
    read = ranked.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("_place", "source_title", "source_note", "content"))).alias("_notes"))
    rows = items.where("type = 'formula'").withColumnRenamed("id", "item_id").join(read, "item_id", "left")
    rows = rows.withColumn("_notes", F.coalesce("_notes", F.array().cast(read.schema["_notes"].dataType))).withColumn("_detail", F.from_json("detail", "map<string,string>"))
    pick = {field: _picked(F.col("_detail"), keys) for field, keys in CARD_KEYS.items()}

    def noted(labels: list[str]) -> Column:
        return F.get(F.filter(F.transform("_notes", lambda n: labelled(n["content"], labels)), lambda x: x.isNotNull()), F.lit(0))

    rows = rows.withColumn("composition", F.coalesce(pick["composition"], labelled("content", COMPOSITION_LABELS), noted(NOTED_COMPOSITION_LABELS)))
    own = F.array(F.struct(F.coalesce("source_package", "category").alias("title"), F.col("source_note").alias("note")))
    told = F.concat(own, F.transform("_notes", lambda n: F.struct(n["source_title"].alias("title"), n["source_note"].alias("note"))))
    some = F.filter(told, lambda x: F.coalesce(T.blank_to_null(x["title"]), T.blank_to_null(x["note"])).isNotNull())
    keys = F.transform(some, lambda x: F.concat(F.coalesce(x["title"], F.lit("")), F.lit("|"), F.coalesce(x["note"], F.lit(""))))
    return rows.select(
        "item_id", F.col("name").alias("formula_name"), F.coalesce(pick["related_pattern"], "category").alias("related_pattern"), "composition",
        F.coalesce(pick["original_dosage"], "composition").alias("original_dosage"), ratio(F.col("composition")).alias("ratio"),
        F.coalesce(pick["usage"], labelled("content", USAGE_LABELS)).alias("usage"),
        F.coalesce(pick["decoction_method"], labelled("content", DECOCTION_LABELS)).alias("decoction_method"),
        F.coalesce(pick["original_text"], "content").alias("original_text"), F.coalesce(pick["indications"], "summary").alias("indications"),
        F.coalesce(pick["explanation"], noted(NOTED_EXPLANATION_LABELS)).alias("explanation"), pick["contraindications"].alias("contraindications"),
        F.transform(F.slice("_notes", F.lit(1), F.lit(NOTES_SHOWN)), lambda n: T.truncate(n["content"], SNIPPET)).alias("annotation_snippets"),
        F.filter(some, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1).alias("sources"), F.col("composition").isNull().alias("missing_composition"),
    )


def card_text() -> Column:
    """The block of a row of ``formula_cards`` in an answer; parts that it lacks are left out."""
    def part(field: str, text: Column, otherwise: str | None = None) -> Column:
        there = F.concat(F.lit(HEADINGS[field] + "\n"), text)
        return there if otherwise is None else F.coalesce(there, F.lit(HEADINGS[field] + "\n" + otherwise))

    listed = F.filter(F.transform(F.split("composition", "[\n，,、;；]"), T.strip), lambda x: x != "")
    bullets = F.when(F.size(listed) >= 2, F.array_join(F.transform(listed, lambda x: F.concat(F.lit("* "), x)), "\n")).otherwise(F.col("composition"))
    sources = F.transform("sources", lambda s: F.concat(F.lit("* "), F.concat_ws("｜", T.when_told(s["title"]), T.when_told(s["note"]))))
    parts = [
        F.concat(F.lit(FORMULA_LINE), "formula_name"), part("composition", bullets, NO_COMPOSITION), part("ratio", F.col("ratio")),
        part("usage", F.coalesce("decoction_method", "usage")), part("indications", F.col("indications")),
        part("explanation", T.truncate("explanation", EXPLAINED)), part("contraindications", F.col("contraindications")),
        part("sources", F.when(F.size("sources") > 0, F.array_join(sources, "\n")), NO_SOURCE),
    ]
    return F.concat(F.concat_ws("\n\n", *parts), F.lit("\n" + CARD_END))


def answer_text(question, blocks) -> Column:
    """The answer to a question out of the blocks of its cards, an array in order; without any it says so."""
    q = F.coalesce(T.col(question), F.lit(""))
    asks_dose = F.coalesce(reduce(lambda a, b: a | b, (F.contains(q, F.lit(w)) for w in DOSE_WORDS)), F.lit(False))
    head = F.concat(F.lit(ANSWER_HEAD + "\n" + ASKED_LINE), q, F.lit("\n\n"), F.when(asks_dose, DOSE_LIMIT + "\n\n").otherwise(""))
    there = F.coalesce(F.size(blocks) > 0, F.lit(False))
    return F.concat(head, F.when(there, F.array_join(blocks, "\n")).otherwise(NO_COMPOSITION + "\n" + NOTHING_MADE_UP))
