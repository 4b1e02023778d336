"""Keyword search: weighted terms, full-text postings with BM25, fusion of both, snippets, grouping and paging.

Item tables have id, type, code, name, alias, pinyin, category, summary, content, source_note, tags, detail, data_status;
columns that a table lacks read as null.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions.udfs import flatten_json

ITEM_COLUMNS = ["type", "code", "name", "alias", "pinyin", "category", "summary", "content", "source_note", "tags", "detail", "data_status"]
#: Statuses that search sees.
SEARCHABLE = ["validated", "ready", "imported", "reviewed", "pending_review", "needs_check"]
#: Known terms with their weights.
KNOWN_TERMS = {
    "足三里": 110, "st36": 110, "zusanli": 110, "足阳明胃经": 100, "胃经": 100, "黄芪": 100, "黄耆": 100, "huangqi": 95,
    "补中益气汤": 100, "buzhongyiqitang": 95,
}
#: Weights of a term by where it comes from.
WEIGHTS = {"name": 100, "code": 95, "pinyin": 90, "category": 55, "source_note": 60, "alias": 85, "tags": 45, "detail": 35}


def item_table(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select("id", *(F.col(c).cast("string") if c in have else F.lit(None).cast("string").alias(c) for c in ITEM_COLUMNS))


def term_array() -> Column:
    """All terms of an item row: (term_type, term, weight), one for each type and normalized term, blanks out. ``flat`` is
    the detail as text."""

    def entry(kind, term, weight):
        return F.struct(F.lit(kind).alias("term_type"), term.alias("term"), F.lit(weight).alias("weight"))

    def single(kind):
        return F.array(entry(kind, T.normalize(F.coalesce(F.col(kind), F.lit(""))), WEIGHTS[kind]))

    def several(kind, value):
        value = F.coalesce(value, F.lit(""))
        parts = F.array_distinct(F.transform(F.split(value, "[,，;；|/、 ]"), T.normalize))
        whole = T.normalize(value)
        lone = F.filter(F.array(whole), lambda w: ~F.array_contains(parts, w))
        return F.concat(
            F.transform(parts, lambda p: entry(kind, p, WEIGHTS[kind])), F.transform(lone, lambda w: entry(kind, w, WEIGHTS[kind] - 5))
        )

    hay = T.normalize(F.concat_ws(" ", "name", "code", "alias", "pinyin", "category", "source_note", "tags", "detail"))
    known = F.filter(
        F.array(*(entry("normalized", F.lit(t), w) for t, w in KNOWN_TERMS.items())), lambda e: F.contains(hay, e["term"])
    )
    every = F.concat(
        *(single(k) for k in ("name", "code", "pinyin", "category", "source_note")),
        several("alias", F.col("alias")), several("tags", F.col("tags")), several("detail", F.col("flat")), known,
    )
    return F.filter(every, lambda e: e["term"] != "")


def build_terms(items: DataFrame, *, detail_is_json: bool = True) -> DataFrame:
    """(item_id, term_type, term, weight) of every item, without a shuffle."""
    flat = flatten_json("detail") if detail_is_json else F.col("detail")
    told = F.coalesce(*WEIGHTS).isNotNull()  # a row of nulls has no terms
    return item_table(items).where(told).withColumn("flat", flat).select(F.col("id").alias("item_id"), F.inline(term_array()))


def contains_ci(c, query: str) -> Column:
    """SQL LIKE '%query%' without regard to case; % and _ in the query are wildcards, as typed."""
    return T.col(c).ilike(f"%{query}%")


def term_scores(terms: DataFrame, query: str) -> DataFrame:
    """(item_id, score, matched_by): the best of weight + 120 exact / 70 prefix / 25 inside, and the sorted term types."""
    q = query.lower()
    bonus = F.when(F.col("term") == q, 120).when(F.col("term").ilike(f"{q}%"), 70).otherwise(25)
    hits = terms.where(contains_ci("term", q))
    return hits.groupBy("item_id").agg(
        F.max(F.col("weight") + bonus).alias("score"), F.array_join(F.array_sort(F.collect_set("term_type")), ",").alias("matched_by")
    )


def term_search(terms: DataFrame, listing: DataFrame, query: str, *, item_type: str | None = None, k: int = 100) -> DataFrame:
    """The best k searchable items of ``listing(item_id, type, data_status, ...)`` by term score, ties by id."""
    seen = listing.where(F.col("data_status").isin(SEARCHABLE))
    if item_type is not None:
        seen = seen.where(F.col("type") == item_type)
    return term_scores(terms, query).join(seen, "item_id").orderBy(F.desc("score"), "item_id").limit(k)


TOKEN = r"[^\p{L}\p{N}\p{M}]+"
K1, B = 1.2, 0.75


def tokens(c) -> Column:
    """Lower-cased runs of letters, digits and marks."""
    return F.filter(F.split(F.lower(F.coalesce(T.col(c), F.lit(""))), TOKEN), lambda t: t != "")


def bm25(docs: DataFrame, columns: list[str], query: str) -> DataFrame:
    """(id, bm25): documents with the query as a phrase - or, for one ASCII word, with words that begin with it.

    A column at a time is matched; length counts all columns. Smaller is better, as idf and frequency are negated.
    One pass gathers corpus size and mean length, a second scores the hits.
    """
    # words stand between single spaces, so hits are counted by one pattern and no array is built
    spaced = (lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), TOKEN, " "), F.lit(" ")))
    if not query_words(query):
        return docs.where(F.lit(False)).select("id", F.lit(0.0).alias("bm25"))
    phrase = " ".join(map(re.escape, query_words(query)))
    prefix = query.isascii() and query.isalnum()
    hit = F.lit(f" {phrase}" if prefix else f"(?= {phrase} )")
    counted = docs.select(
        "id",
        sum((F.regexp_count(spaced(c), hit) for c in columns), F.lit(0)).alias("f"),
        sum((F.regexp_count(spaced(c), F.lit("[^ ]+")) for c in columns), F.lit(0)).alias("dl"),
    )
    whole = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), F.count_if(F.col("f") > 0).alias("n_hit"))
    return counted.where("f > 0").join(F.broadcast(whole)).select("id", bm25_score().alias("bm25"))  # whole: one row


def with_annotations(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """Items whose content is followed by the texts of their annotations ``(item_id, id, source_title, source_note, content,
    tags)``, the parts of one by spaces, each on a line of its own, in the order of their ids."""
    told = F.concat_ws(" ", "source_title", "source_note", "content", "tags")
    # an item's annotations are few; they are collected by item alone
    per = annotations.groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("at"), told.alias("text")))).alias("_notes"))
    notes = F.array_join(F.transform("_notes", lambda n: n["text"]), "\n")
    both = items.join(per, "id", "left")
    return both.withColumn("content", F.when(F.col("_notes").isNull(), F.col("content")).otherwise(F.concat_ws("\n", "content", notes))).drop("_notes")


#: Places of a column's words in a text begin at its number times this.
COLUMN_SPAN = 1 << 32


def query_words(query: str) -> list[str]:
    """The words of a query by the rule of ``tokens``: lower-cased runs of letters, digits and marks."""
    return "".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in query.lower()).split()


def scored_postings(rows: Callable[[Column], DataFrame], totals: DataFrame, query: str) -> DataFrame:
    """``bm25`` from the postings that ``rows`` gives for a condition on the token, and a row of n_docs and avgdl. A query
    without words finds nothing."""
    words = query_words(query)
    if not words:
        return rows(F.lit(False)).select("id", F.lit(0.0).alias("bm25"))
    if query.isascii() and query.isalnum():
        hits = rows(F.startswith("token", F.lit(words[0]))).groupBy("id", "dl").agg(F.sum(F.size("places")).alias("f"))
    else:
        offsets = F.create_map(*(x for w in dict.fromkeys(words) for x in (F.lit(w), F.array(*(F.lit(i) for i, v in enumerate(words) if v == w)))))
        places = rows(F.col("token").isin(words)).select("id", "dl", F.explode("places").alias("place"), F.element_at(offsets, F.col("token")).alias("offsets"))
        starts = places.select("id", "dl", "place", F.explode("offsets").alias("offset")).select("id", "dl", (F.col("place") - F.col("offset")).alias("start")).groupBy("id", "dl", "start").count()
        hits = starts.where(F.col("count") == len(words)).groupBy("id", "dl").agg(F.count("*").alias("f"))
    hits = hits.select("id", "f", "dl")
    n_hit = hits.agg(F.count("*").alias("n_hit"))
    return hits.crossJoin(F.broadcast(totals.select("n_docs", "avgdl").crossJoin(n_hit))).select("id", bm25_score().alias("bm25"))  # two single rows


def bm25_score() -> Column:
    raw = F.log((F.col("n_docs") - F.col("n_hit") + 0.5) / (F.col("n_hit") + 0.5))
    f = F.col("f")
    return -F.when(raw > 0, raw).otherwise(1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def text_score(bm: Column) -> Column:
    """40 less the whole part of bm25, truncated toward zero."""
    return F.lit(40) - bm.cast("int")


def fuse(signals: list[tuple[str, DataFrame]], k: int) -> DataFrame:
    """Signals (name, (item_id, score, matched_by)) summed by item; names joined in order; the best k, ties by id."""
    hits = None
    for place, (_, df) in enumerate(signals):
        rows = df.select("item_id", F.col("score").cast("long").alias("score"), "matched_by", F.lit(place).alias("place"))
        hits = rows if hits is None else hits.unionByName(rows)
    said = F.transform(F.array_sort(F.collect_list(F.struct("place", "matched_by"))), lambda s: s["matched_by"])
    joined = F.aggregate(
        said, F.lit(""), lambda a, m: F.when(F.contains(a, m), a).when(a == "", m).otherwise(F.concat(a, F.lit(","), m))
    )
    return hits.groupBy("item_id").agg(F.sum("score").alias("score"), joined.alias("matched_by")).orderBy(F.desc("score"), "item_id").limit(k)


def snippet(c, query: str) -> Column:
    """Text around the first exact hit: from 29 characters before it to 90 after, cut to 140 with dots; null without hit."""
    at = F.instr(T.col(c), query)
    start = F.greatest(at - 29, F.lit(1))
    part = F.substring(T.col(c), start, at + F.lit(len(query)) + 90 - start)
    return F.when(at > 0, T.truncate(part, 140))


def snippet_or_start(query: str, content="content", summary="summary", detail="detail") -> Column:
    return F.coalesce(snippet(content, query), snippet(summary, query), snippet(detail, query), T.truncate(content, 120))


#: Groups by type, in the order in which they are shown.
GROUPS = {"herb": "中药", "formula": "方剂", "acupoint": "穴位", "meridian": "经络", "theory": "原典章节", "syndrome": "原典条文", "note": "注解资料"}
OTHER = "其他"


def group_name(kind, category=None) -> Column:
    """The group of a type; ``acupuncture`` is split by whether the category names a channel."""
    c = F.lit("") if category is None else F.coalesce(T.col(category), F.lit(""))
    split = F.when(F.contains(c, F.lit("经")), "经络").otherwise("穴位")
    return F.when(T.col(kind) == "acupuncture", split).otherwise(F.coalesce(T.lookup(kind, GROUPS), F.lit(OTHER)))


def group_order(name) -> Column:
    """Place of a group from 1; 99 for one that isn't known."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, [*GROUPS.values(), OTHER])), T.col(name)), F.lit(0)).cast("int"), F.lit(99))


#: What each filter of the search page allows, by type and by group.
FILTERS = {
    "中药": (["herb"], ["中药"]), "方剂": (["formula"], ["方剂"]), "穴位": (["acupoint"], ["穴位"]), "经络": (["meridian"], ["经络"]),
    "针灸": (["acupuncture", "acupoint", "meridian"], ["穴位", "经络"]), "原典": (["theory", "syndrome"], ["原典章节", "原典条文"]),
}


def allows(name: str, kind="type", group="group_name", has_annotations="has_annotations", matched_by="matched_by") -> Column:
    """Whether a result passes the named filter; an unknown or empty name lets all pass."""
    if name == "注解":
        return T.col(has_annotations) | F.contains(matched_by, F.lit("annotation"))
    if name not in FILTERS:
        return F.lit(True)
    kinds, groups = FILTERS[name]
    return T.col(kind).isin(kinds) | T.col(group).isin(groups)


def item_filter(*, item_type: str | None = None, status: str | None = None, favorite: bool | None = None, text: str | None = None, columns: list[str] | None = None) -> Column:
    """All given conditions; those that are None don't filter. Text may stand in any of the columns, in either case."""
    out = F.lit(True)
    for c, v in (("type", item_type), ("data_status", status), ("is_favorite", favorite)):
        out = out if v is None else out & (F.col(c) == v)
    if text:
        any_hit = F.lit(False)
        for c in columns or ["name", "code", "alias", "pinyin", "category", "summary", "content", "source_note", "tags", "detail"]:
            any_hit = any_hit | F.coalesce(contains_ci(c, text), F.lit(False))
        out = out & any_hit
    return out


def probe(terms: DataFrame, listing: DataFrame, queries: list[str]) -> DataFrame:
    """(query, item_id, score): the first hit of each query, all queries in one pass over the terms."""
    q = F.explode(F.array(*map(F.lit, queries)))
    asked = terms.withColumn("query", q).withColumn("needle", T.normalize("query"))
    hits = asked.where(F.contains("term", F.col("needle")))
    bonus = F.when(F.col("term") == F.col("needle"), 120).when(F.startswith("term", F.col("needle")), 70).otherwise(25)
    scored = hits.groupBy("query", "item_id").agg(F.max(F.col("weight") + bonus).alias("score"))
    seen = scored.join(listing.where(F.col("data_status").isin(SEARCHABLE)).select("item_id"), "item_id")
    best = F.min_by("item_id", F.struct(-F.col("score"), F.col("item_id"))).alias("item_id")
    return seen.groupBy("query").agg(best, F.max("score").alias("score"))


def annotation_hits(annotations: DataFrame, columns: list[str], query: str, limit: int = 200) -> DataFrame:
    """Ids of the items with a matching annotation, the smallest ``limit``."""
    any_hit = None
    for c in columns:
        hit = F.coalesce(contains_ci(c, query), F.lit(False))
        any_hit = hit if any_hit is None else any_hit | hit
    return annotations.where(any_hit).select("item_id").distinct().orderBy("item_id").limit(limit)


def best_annotation(annotations: DataFrame, query: str, text: str = "content") -> DataFrame:
    """(item_id, n_annotations, annotation): one that holds the query before others, then the latest, then the largest id."""
    hit = F.contains(F.col(text), F.lit(query))
    per = Window.partitionBy("item_id")
    order = per.orderBy(F.desc(hit.cast("int")), F.desc("created_at"), F.desc("id"))
    ranked = annotations.withColumn("n_annotations", F.count("*").over(per)).withColumn("rn", F.row_number().over(order))
    return ranked.where("rn = 1").select("item_id", "n_annotations", F.col(text).alias("annotation"))


def enhanced(basic: DataFrame, items: DataFrame, annotations: DataFrame, query: str, *, annotation_score: int = 65) -> DataFrame:
    """``basic`` hits (item_id, score, matched_by) and annotation-only hits, with snippets and groups, best first."""
    noted = annotation_hits(annotations, ["content"], query).join(basic, "item_id", "left_anti")
    hits = basic.select("item_id", "score", "matched_by").unionByName(
        noted.select("item_id", F.lit(annotation_score).cast("long").alias("score"), F.lit("annotation").alias("matched_by"))
    )
    full = hits.join(items, hits.item_id == items.id).join(best_annotation(annotations, query), "item_id", "left")
    named = group_name("type", "category")
    return full.select(
        "item_id", "score", "matched_by", "name", named.alias("group_name"),
        F.coalesce("n_annotations", F.lit(0)).alias("n_annotations"),
        snippet_or_start(query).alias("snippet"), snippet("annotation", query).alias("annotation_snippet"),
    ).orderBy(F.desc("score"), "name", "item_id")


def page(df: DataFrame, order: list, number: int | None, size: int | None) -> DataFrame:
    from quernstone.functions.values import page_bounds

    _, size, offset = page_bounds(number, size)
    return df.orderBy(*order).offset(offset).limit(size)


def candidate_limit(number: int, size: int) -> int:
    return min(number * size + 50, 500)


def reindex(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """The index with the rows of changed and removed items replaced by those of ``changed``."""
    gone = changed.select(key).distinct() if removed is None else changed.select(key).unionByName(removed.select(key)).distinct()
    return index.join(gone, key, "left_anti").unionByName(changed)


def idf_closed_form(n_docs: int, n_hit: int) -> float:
    raw = math.log((n_docs - n_hit + 0.5) / (n_hit + 0.5))
    return raw if raw > 0 else 1e-6
