"""Curation of texts: labelled sections, herb properties, reminder removal, classifiers, cards and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.udfs import BACKUP_MARK, clean_lines, composition, ratio
from quernstone.functions.values import let

# The qualities, flavours, organs and toxicities that texts name, and the labels of their sections.
QUALITIES = ["大寒", "微寒", "寒", "凉", "平", "微温", "温", "热", "大热"]
FLAVOURS = ["酸", "苦", "甘", "辛", "咸", "淡", "涩"]
TOXICITIES = ["无毒", "小毒", "微毒", "有毒", "大毒"]
ORGANS = ["心包", "三焦", "大肠", "小肠", "膀胱", "心", "肝", "脾", "肺", "肾", "胃", "胆"]
NATURE, EFFECTS = "性味", "功效"
SECTION_LABELS = [NATURE, "本经原文", "产地", "主治", "仲景", "用量", "禁忌", "炮制", "别录", "甄权", "大明", "灵胎", "括要", "元素"]
# Words with which effects begin, marks that end a phrase and marks that part a list, what leads to channels
# and to a summary, and how far a phrase on nature or on flavour alone reaches.
EFFECT_WORDS = ["主治", "主", "治", "功能", "功效"]
STOPS, COMMAS = "。；;\n", " ，,、和与及"
CHANNEL_REACH, CHANNEL_ENDS = [("归", 24), ("入", 16)], "经脏腑"
FUNCTION_WORD, DASH = "功能", "——"
REACH = [("性", 42), ("味", 33)]  # with the word; 性 without 味 behind it reaches one less


def sections(content) -> Column:
    """A map of the sections 【label】 text, each up to the next label; of several with one label the first."""
    parts = F.transform(F.slice(F.split(T.col(content), "【"), F.lit(2), F.lit(1 << 20)), lambda p: F.split(p, "】", 2))

    def firsts(named: Column) -> Column:
        return let(F.transform(named, lambda p: p[0]), lambda labels: F.filter(named, lambda p, i: F.array_position(labels, p[0]) == i + 1))

    first = let(F.filter(parts, lambda p: F.size(p) == 2), firsts)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p[0], T.strip(p[1]))))


def section(content, label: str) -> Column:
    return let(F.try_element_at(sections(content), F.lit(label)), _some)


def phrases(c) -> Column:
    """The runs between full stops, semicolons and line ends."""
    return F.split(T.col(c), f"[{STOPS}]")


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _bare(c: Column, more: str = "") -> Column:
    """One space for any white space, and no list marks at the ends."""
    return F.btrim(F.array_join(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""), " "), F.lit(" ，,;；" + more))


def _before(c: Column, words: list[str]) -> Column:
    """The text before the first place of any of the words."""
    return reduce(lambda acc, w: F.substring_index(acc, w, 1), words, c)


def _about(c: Column) -> Column:
    """What a text says before it comes to effects."""
    return let(_bare(_before(c, EFFECT_WORDS), "。"), _some)


def _tails(told: Column, word: str, reach: int) -> Column:
    """Of each of the phrases with the word what stands from it on, where the phrase goes on behind it."""
    tails = F.transform(told, lambda p: F.when(F.contains(p, F.lit(word)), F.substring(p, F.instr(p, word), F.lit(reach))))
    return F.filter(tails, lambda t: t.isNotNull() & (F.length(t) > 1))


def nature_flavor(content) -> tuple[Column, Column]:
    """The phrase on nature and flavour, and where it was found: its section, else the first phrase that has 性, or else 味.
    The text is computed and cut into phrases once."""

    def nearest(tail: Column, word: str, reach: int) -> Column:
        short = (F.lit(word) == REACH[0][0]) & (F.substring(tail, 2, 1) != REACH[1][0])
        return _about(F.when(short, F.substring(tail, 1, reach - 1)).otherwise(tail))

    def in_text(told: Column) -> Column:
        return F.coalesce(*(let(F.get(_tails(told, word, reach), F.lit(0)), lambda t, w=word, r=reach: nearest(t, w, r)) for word, reach in REACH))

    def found(c: Column) -> Column:
        return let(_about(F.coalesce(section(c, NATURE), F.lit(""))), lambda told: F.struct(F.coalesce(told, let(phrases(c), in_text)).alias("phrase"), told.isNotNull().alias("labelled")))

    both = let(T.col(content), found)
    return both["phrase"], F.when(both["labelled"], "section").when(both["phrase"].isNotNull(), "text")


def channels(content) -> Column:
    """``X经`` of each organ named between 归 or 入 and the next 经, 脏 or 腑 within reach, or right behind 入; in a fixed order.
    The text is computed once, and so are the runs of it that may name one."""
    stops = f"[^{STOPS}]"

    def runs(c: Column) -> Column:
        told = [F.regexp_extract_all(c, F.lit(f"{word}({stops}{{1,{reach}}}?)[{CHANNEL_ENDS}]"), 1) for word, reach in CHANNEL_REACH]
        told.append(F.regexp_extract_all(c, F.lit(f"{CHANNEL_REACH[-1][0]}({'|'.join(ORGANS)})"), 1))
        return F.array_join(F.flatten(F.array(*told)), "，")

    named = let(let(T.col(content), runs), lambda found: F.filter(F.array(*map(F.lit, ORGANS)), lambda o: F.contains(found, o)))
    return F.array_join(F.transform(named, lambda o: F.concat(o, F.lit("经"))), "，")


def herb_properties(content) -> dict[str, Column]:
    """Columns nature_flavor with its source, four_qi, five_flavors, channel_tropism, toxicity, effects, summary; null if unknown."""
    phrase, source = nature_flavor(content)
    known = F.coalesce(phrase, F.lit(""))

    def terms(c, words):
        return let(F.array_join(T.terms_in_order(c, words), "，"), _some)

    def after(c, word):
        """What a text says behind a word, to the end of the phrase."""
        behind = let(c, lambda t: F.when(F.contains(t, F.lit(word)), F.split_part(t, F.lit(word), F.lit(2))))
        return let(_bare(F.get(phrases(behind), F.lit(0))), _some)

    return {
        "nature_flavor": phrase, "nature_from": source, "four_qi": terms(known, QUALITIES), "five_flavors": terms(known, FLAVOURS),
        "channel_tropism": let(channels(content), _some), "toxicity": F.coalesce(terms(known, TOXICITIES), terms(T.col(content), TOXICITIES)),
        "effects": F.coalesce(section(content, EFFECTS), after(F.coalesce(section(content, NATURE), known), FUNCTION_WORD)), "summary": after(T.col(content), DASH),
    }


def property_tags(tags, four_qi, five_flavors, channels, toxicity=None) -> Column:
    """The tags, and those that follow from the properties: X性, X味, 归X, and the toxicity as it is."""
    def each(c, before, after):
        return F.transform(T.split_terms(F.coalesce(T.col(c), F.lit(""))), lambda x: F.concat(F.lit(before), x, F.lit(after)))

    every = F.concat(each(tags, "", ""), each(four_qi, "", "性"), each(five_flavors, "", "味"), each(channels, "归", ""), each(F.lit("") if toxicity is None else toxicity, "", ""))
    return F.array_join(F.array_distinct(every), "，")


# Reminder phrases with what replaces them, and patterns of reminder sentences.
REMINDERS = [
    ("传统作用学习参考：", "传统作用："),
    ("传统主治范围学习参考：", "传统主治范围："),
    ("学习参考：", ""),
    ("传统针灸学习资料，不作为治疗建议。", ""),
    ("仅供专业学习参考，请勿自行操作。", ""),
    ("需结合专业辨证与定位，勿自行操作。", ""),
    ("不提供可照做的通用下针深度；具体深度须由合格专业人员判断。", ""),
    ("针刺深度、方向和角度没有可脱离个体情况的统一数字；须由合格针灸专业人员依据标准定位、体型胖瘦、局部解剖、禁忌与教材规范判断。本库不提供可照做的下针深度。", ""),
    ("仅供中医针灸知识学习与检索参考，不作为诊断、治疗或自行针刺操作依据；定位、配伍和操作须由合格专业人员执行。", ""),
]
# Words from which on a sentence is a reminder; the first only where the second follows it.
REMINDER_WORDS = [("仅供", "参考"), ("不作为", ""), ("请勿", ""), ("勿自行", "")]


def without_reminders(c) -> Column:
    """Text without reminder phrases. A finished sentence that comes to a reminder ends before it, without its stop; spaces
    before marks and all but the last of several stops go."""
    plain = reduce(lambda acc, r: F.replace(acc, F.lit(r[0]), F.lit(r[1])), REMINDERS, T.col(c))
    parts = F.split(plain, "。")

    def cut(sentence: Column, i: Column) -> Column:
        begins = [F.when(F.contains(F.substr(sentence, F.instr(sentence, w)), F.lit(then)), F.instr(sentence, w)) for w, then in REMINDER_WORDS]
        at = F.least(*(F.nullif(b, F.lit(0)) for b in begins), F.lit(1 << 30))
        last = i + 1 == F.size(parts)
        return F.when(last, sentence).when(at < 1 << 30, F.substring(sentence, F.lit(1), at - 1)).otherwise(F.concat(sentence, F.lit("。")))

    joined = F.translate(F.array_join(F.transform(parts, cut), ""), "　", " ")
    return T.strip(F.regexp_replace(joined, r"(?U) (?= )|\s+(?=[。；，、])|[。；](?=[。；])", ""))


# Characters of a running title printed downwards, and patterns of layout lines.
TITLE_CHARS = list("觀其脈證知犯何逆隨證治之")
LAYOUT_LINES = [
    "倪海厦注(?:《?(?:金匮|伤寒论|神农本草经)》?)?", "倪注(?:金匮|伤寒论|神农本草经)?", r"(?:勤求古訓|勤求古训)\s*(?:博采眾方|博采众方)?",
    "(?:博采眾方|博采众方)", "小桂枝[·.．、-]?群龙无首.*(?:校排)?", r"[\d.。．]+校排", "校排", r"【PDF页码\d+】",
]


def is_layout_line(c) -> Column:
    return T.col(c).rlike("^(?:" + "|".join(LAYOUT_LINES) + ")$") | T.col(c).isin(TITLE_CHARS)


def without_headers(c) -> Column:
    """Text without layout lines and the characters of a downward title."""
    lines = F.filter(F.split(T.col(c), "\n"), lambda x: ~is_layout_line(F.trim(x)))
    return F.array_join(lines, "\n")


# How a running title begins a line, what may follow it, marks, a quoted word, and heads of the sections of a text.
TITLES = ["觀其脈證知犯何逆隨證治之", "观其脉证知犯何逆随证治之", "脈證知犯何逆隨證治之"]
NUMBER_SIGNS = "一二三四五六七八九十百零〇\\p{Nd}"
MARKS = ",，。；;:："
QUOTED_WORD = ("「协热利」", "协热利")
ORIGINAL_HEAD, COMMENTARY_HEAD, BODY_HEAD = "【原文】", "【注解整理】", "【正文整理】"
LINE_ENDS = r"\r\n|[\n\x0b\f\r\x1c-\x1e\u0085\u2028\u2029]"


def _untitled(c: Column) -> Column:
    """The text without a running title and its number at the start."""
    return reduce(lambda acc, t: F.regexp_replace(acc, f"\\A{t}[{NUMBER_SIGNS}]*[:：,，。]*", ""), TITLES, c)


def commentary(c, original) -> Column:
    """A commentary out of a text of broken lines: layout gone, lines joined, the original passage taken out as it is and without
    its blanks, and a paragraph for each sentence. Title characters that stand alone on a line go, in a run or singly.
    A null original takes nothing out; a null text gives null."""
    def line(x: Column) -> Column:
        bare = F.replace(T.strip(x), F.lit(QUOTED_WORD[0]), F.lit(QUOTED_WORD[1]))
        return T.strip(F.regexp_replace(F.regexp_replace(bare, "[ 　]+", ""), f"([{MARKS}]){{2,}}", "$1"))

    lines = F.transform(F.split(T.col(c), LINE_ENDS), lambda x: _untitled(line(x)))
    whole = _untitled(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.isin(TITLE_CHARS)), ""))
    passage = F.coalesce(T.col(original), F.lit(""))
    rest = F.replace(F.replace(whole, passage, F.lit("")), T.compact(passage), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(rest, f"\\A[{NUMBER_SIGNS}]+[:：]", ""), f"[{MARKS}]{{2,}}", "。")
    sentences = F.transform(F.split(F.regexp_replace(rest, "([。；])", "$1\n"), LINE_ENDS), lambda x: F.btrim(x, F.lit(" ，,；;")))
    return T.strip(F.array_join(F.filter(sentences, lambda x: x != ""), "\n"))


def structured(original, told, rest) -> Column:
    """The original passage and the commentary under their heads; where there is no commentary the rest; empty if all are."""
    def part(head: str, c) -> Column:
        return F.when(F.coalesce(T.col(c), F.lit("")) != "", F.concat(F.lit(head + "\n"), T.col(c)))

    return F.concat_ws("\n\n", part(ORIGINAL_HEAD, original), F.coalesce(part(COMMENTARY_HEAD, told), part(BODY_HEAD, rest)))


def tidied(df: DataFrame, *, content="content", name="name", original="original", classic="classic") -> DataFrame:
    """The rows with their content cleaned of layout, and if it is still in fragments rewritten in sections; with columns
    ``tidied`` (the content changed) and ``review`` (it is still suspicious).

    Rows of classics, and others that hold layout lines or a backup copy, are looked at; of the rest, of those that come out
    whole and alike, and of those of which nothing would be left, the content stays. Null content stays null.
    """
    from quernstone.operators.profile import line_metrics

    def suspicious(c) -> Column:
        return let(c, lambda x: line_metrics(x)["suspicious"])

    wanted = F.coalesce(T.col(classic), F.lit(False)) | F.contains(content, F.lit(BACKUP_MARK)) | (line_metrics(content)["n_layout"] > 0)
    passage = T.strip(F.coalesce(T.col(original), F.lit("")))
    rows = df.withColumn("_clean", F.when(F.coalesce(wanted, F.lit(False)), clean_lines(T.col(content), T.col(name))))
    broken = F.coalesce(suspicious(F.col("_clean")), F.lit(False))
    rows = rows.withColumn("_new", F.when(broken, structured(passage, commentary("_clean", passage), T.strip("_clean"))).otherwise(F.col("_clean")))
    changed = F.coalesce((F.col("_new") != "") & (F.col("_new") != T.col(content)), F.lit(False))
    rows = rows.withColumn("tidied", changed).withColumn(content, F.when(F.col("tidied"), F.col("_new")).otherwise(T.col(content)))
    return rows.withColumn("review", F.col("tidied") & F.coalesce(suspicious(F.col(content)), F.lit(False))).drop("_clean", "_new")


# Tones of natures and elements of channels; the first rule that matches counts.
NATURE_RULES = [
    ("deep-cold", "大寒|极寒|至寒"), ("mild-cold", "微寒|小寒"), ("cold", "寒"), ("deep-hot", "大热|极热|至热"), ("mild-warm", "微热|小热"),
    ("hot", "大温|热"), ("mild-warm", "微温|小温"), ("warm", "温"), ("neutral", "平"),
]
ELEMENT_RULES = [
    ("wood", "足厥阴|肝经|肝|胆经|胆|LR|GB|木"), ("fire", "手少阴|心经|心|小肠经|小肠|心包|三焦|HT|SI|PC|SJ|TE|火"),
    ("earth", "足太阴|脾经|脾|胃经|胃|SP|ST|土"), ("metal", "手太阴|肺经|肺|大肠经|大肠|LU|LI|金"), ("water", "足少阴|肾经|肾|膀胱经|膀胱|KI|BL|水"),
]


def first_rule(c, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern the compacted text holds; null if none."""
    text = T.compact(F.coalesce(T.col(c), F.lit("")))
    return reduce(lambda acc, r: F.when(text.rlike(r[1]), r[0]).otherwise(acc), reversed(rules), F.lit(None).cast("string"))


def point_description(name, code, meridian) -> Column:
    """Template sentence of a point, its number taken from the code's digits."""
    number = F.regexp_extract(T.col(code), "[0-9]+", 0)
    return F.when(number != "", F.format_string("%s（%s）为%s第%s穴。", T.col(name), T.col(code), T.col(meridian), number)).otherwise(F.format_string("%s（%s）属%s。", T.col(name), T.col(code), T.col(meridian)))


def channel_description(name, code, category, polarity, limb, organ, paired) -> Column:
    """Struct of the template sentences of a channel: summary and content. Polarity and limb that are blank are told as not
    listed; without an organ, or a paired channel, their sentences are others or none."""
    def told(c) -> Column:
        return T.blank_to_null(c)

    summary = F.concat(T.col(name), F.lit("，"), T.col(category), F.lit("，联系脏腑："), F.coalesce(told(organ), F.lit("任督脉系统")), F.lit("。"))
    content = F.concat(
        T.col(name), F.lit("，国际代码 "), T.col(code), F.lit("，类别："), T.col(category), F.lit("。阴阳属性："), F.coalesce(told(polarity), F.lit("未单列")),
        F.lit("；手足属性："), F.coalesce(told(limb), F.lit("未单列")), F.lit("。"),
        F.coalesce(F.concat(F.lit("传统经络归属联系："), told(organ), F.lit("。")), F.lit("传统经络归属需结合任督脉理论学习。")),
        F.coalesce(F.concat(F.lit("表里经："), told(paired), F.lit("。")), F.lit("")),
    )
    return F.struct(summary.alias("summary"), content.alias("content"))


def formula_card(name, content, composition_text) -> Column:
    """Struct of a formula: composition, entries, ratio, whether the composition is missing, effects and indications."""
    told = F.coalesce(T.blank_to_null(composition_text), T.labelled_text(content, ["组成：", "组成:", "方药：", "药物组成："]))
    return F.struct(
        T.col(name).alias("name"), told.alias("composition"), composition(told).alias("entries"), ratio(told).alias("ratio"),
        told.isNull().alias("missing_composition"), T.labelled_text(content, ["功效：", "功效:"]).alias("effects"),
        T.labelled_text(content, ["主治：", "主治:"]).alias("indications"),
    )


def answer(card: Column) -> Column:
    """Markdown of a card, missing parts left out."""
    parts = [F.concat(F.lit("### "), card["name"])]
    for label, field in (("组成", "composition"), ("比例", "ratio"), ("功效", "effects"), ("主治", "indications")):
        parts.append(F.when(card[field].isNotNull(), F.concat(F.lit(f"- {label}："), card[field])))
    return F.concat_ws("\n", *parts)
