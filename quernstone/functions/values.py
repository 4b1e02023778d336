"""Numbers, dates, arrays and JSON objects as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import blank_to_null, col, split_list, strip


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it: large expressions don't grow by nesting."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def clamp(c, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(col(c), F.lit(high)))


def page_bounds(page: int | None, size: int | None) -> tuple[int, int, int]:
    """(page, size, offset): the page from 1, the size from 1 to 200, 50 by default."""
    page, size = max(page or 1, 1), min(max(size or 50, 1), 200)
    return page, size, (page - 1) * size


def lenient_long(c) -> Column:
    """Whole part of a number, or of a number in text; null otherwise."""
    s = strip(col(c).cast("string"))
    return F.coalesce(F.try_to_number(s, F.lit("999999999999999999")).cast("long"), s.try_cast("double").cast("long"))


def lenient_double(c) -> Column:
    return strip(col(c).cast("string")).try_cast("double")


# Chinese numerals.
NUMERALS = {"一": 1.0, "二": 2.0, "两": 2.0, "三": 3.0, "四": 4.0, "五": 5.0, "六": 6.0, "七": 7.0, "八": 8.0, "九": 9.0}


def chinese_number(c) -> Column:
    """Numbers below a hundred in Chinese numerals, with 半 for a half; anything else is null."""
    digits = F.create_map(*(F.lit(x) for p in NUMERALS.items() for x in p))
    s = strip(c)
    half = F.when(s.endswith("半"), 0.5).otherwise(0.0)
    bare = F.when(s.endswith("半"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    tens, ones = F.regexp_extract(bare, "^(.?)十(.?)$", 1), F.regexp_extract(bare, "^(.?)十(.?)$", 2)
    with_ten = F.when(tens == "", 1.0).otherwise(F.element_at(digits, tens)) * 10 + F.when(ones == "", 0.0).otherwise(F.element_at(digits, ones))
    whole = F.when(bare == "", F.when(half > 0, 0.0)).when(F.contains(bare, F.lit("十")), with_ten).otherwise(
        F.when(F.length(bare) == 1, F.element_at(digits, bare)).otherwise(bare.try_cast("double"))
    )
    return whole + half


def amount(c) -> Column:
    """A number without its fraction where there is none, else with one decimal."""
    return F.when(col(c) == F.floor(col(c)), F.floor(col(c)).cast("string")).otherwise(F.format_string("%.1f", col(c)))


def mapping_confidence(name, value, context, prior) -> Column:
    """(40 name + 35 value + 15 context + 10 prior) / 100, at most 1; each part from 0 to 1."""
    return F.least(F.lit(1.0), (40 * col(name) + 35 * col(value) + 15 * col(context) + 10 * col(prior)) / 100)


def list_text(array) -> Column:
    """Array to comma text: blanks out, then split again at list separators."""
    joined = F.array_join(F.filter(F.transform(col(array), lambda x: strip(x.cast("string"))), lambda x: x != ""), ",")
    return F.array_join(split_list(joined), ",")


def object_or_wrapped(c) -> Column:
    """A JSON object as variant; other text is wrapped as ``raw_detail``; null and blank give an empty object."""
    parsed = F.try_parse_json(col(c))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    wrapped = F.parse_json(F.to_json(F.struct(col(c).alias("raw_detail"), F.lit(True).alias("parse_error"))))
    return F.when(blank_to_null(c).isNull(), F.parse_json(F.lit("{}"))).when(is_object, parsed).otherwise(wrapped)


#: Fields that live on the item itself; all others belong to its detail.
CORE_FIELDS = ["type", "code", "name", "alias", "pinyin", "category", "summary", "content", "source_note", "tags", "data_status"]


def residual(record: Column, core=CORE_FIELDS) -> Column:
    """Of a map: the keys that are neither core fields nor private."""
    return F.map_filter(record, lambda k, v: ~k.isin(*core) & ~k.startswith("_"))


def overlay(main: Column, fallback: Column) -> Column:
    """Of two maps: all keys, the main one's values first."""
    extra = F.map_filter(fallback, lambda k, v: ~F.map_contains_key(main, k))
    return F.map_concat(main, extra)


def diff(old: Column, new: Column) -> Column:
    """Of two maps: array of (field, old_value, new_value) where they differ, fields sorted, null for missing."""
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    rows = F.transform(keys, lambda k: F.struct(k.alias("field"), F.element_at(old, k).alias("old_value"), F.element_at(new, k).alias("new_value")))
    return F.filter(rows, lambda r: ~r["old_value"].eqNullSafe(r["new_value"]))


def first_text(record: Column, *keys: str) -> Column:
    """Of a string map: the first value that isn't blank."""
    return F.coalesce(*(blank_to_null(F.try_element_at(record, F.lit(k))) for k in keys))


def json_text(c, *paths: str) -> Column:
    """The first JSON path with a value that isn't blank."""
    return F.coalesce(*(blank_to_null(F.get_json_object(col(c), p)) for p in paths))


def question_of(c) -> Column:
    return F.coalesce(json_text(c, "$.question", "$.prompt", "$.text"), col(c))
