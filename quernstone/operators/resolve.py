"""Entity resolution: fingerprints, duplicate candidates by blocking keys, merge strategies.

Candidates are emitted as links to a representative: within a block of equal keys all rows are duplicates of each
other, so the smallest id and each other row say everything; a block of n rows gives n - 1 rows, never n squared.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators.store import materialized

#: Scores of the rules.
SCORES = {"type_code_exact": 1.0, "type_name_exact": 0.98, "fingerprint_match": 0.95, "name_alias_match": 0.90, "pinyin_category_suspect": 0.78}


def keyed(items: DataFrame) -> DataFrame:
    """Items with code_norm, name_norm, pinyin_norm, alias_norm, category_norm and fingerprint; blank keys are null."""

    def key(c: Column) -> Column:
        return F.nullif(c, F.lit(""))  # told once, where a condition would normalize twice

    keys = items.withColumns({
        "code_norm": key(T.code_key("code")),
        "name_norm": key(T.normalize("name")),
        "pinyin_norm": key(T.pinyin_key("pinyin")),
        "alias_norm": T.alias_key("alias"),
        "category_norm": key(T.normalize("category")),
    })
    by_code = F.concat_ws("|", F.col("type"), F.lit("code"), F.col("code_norm"))
    parts = ("name", "name_norm"), ("pinyin", "pinyin_norm"), ("category", "category_norm")
    by_name = F.concat_ws("|", F.col("type"), *(x for label, c in parts for x in (F.lit(label), F.coalesce(F.col(c), F.lit("")))))
    return keys.withColumn("fingerprint", F.when(F.col("code_norm").isNotNull(), by_code).otherwise(by_name))


def import_fingerprint(*columns) -> Column:
    """``type|code|name|source_note`` in lower case, missing parts empty."""
    return F.lower(F.concat_ws("|", *(F.coalesce(T.strip(c), F.lit("")) for c in columns)))


def star(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(item_id, duplicate_id, match_type, score): the least id of each block with each other id of it."""
    whole = rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    whole = whole.select("id", F.sha2(F.concat_ws("\x1f", *(F.col(k).cast("string") for k in keys)), 256).alias("key"))
    whole = materialized(whole.distinct())  # keys are digests: texts are read and normalized once
    least = whole.groupBy("key").agg(F.min("id").alias("item_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return whole.join(least, "key").where("id != item_id").select(
        "item_id", F.col("id").alias("duplicate_id"), F.lit(rule).alias("match_type"), F.lit(SCORES[rule]).alias("score")
    )


def alias_links(rows: DataFrame) -> DataFrame:
    """Links by an alias that is another item's name, within a type: each alias holder to the least item of that name,
    and each item of that name to the least alias holder - one star over both sides of the token."""
    rule = "name_alias_match"
    named = rows.where("name_norm is not null").select("type", F.col("name_norm").alias("token"), "id", F.lit(True).alias("is_name"))
    tokens = F.explode(F.filter(F.split("alias_norm", r"\|"), lambda t: t != ""))
    aliased = rows.select("type", tokens.alias("token"), "id", F.lit(False).alias("is_name"))
    sides = (
        named.unionByName(aliased).groupBy("type", "token")
        .agg(F.min(F.when(F.col("is_name"), F.col("id"))).alias("first_name"), F.min(F.when(~F.col("is_name"), F.col("id"))).alias("first_alias"))
        .where("first_name is not null and first_alias is not null")
    )
    both = named.unionByName(aliased).join(sides, ["type", "token"])
    other = F.when(F.col("is_name"), F.col("first_alias")).otherwise(F.col("first_name"))
    pairs = both.select(F.least("id", other).alias("item_id"), F.greatest("id", other).alias("duplicate_id")).where("item_id != duplicate_id")
    return pairs.distinct().select("item_id", "duplicate_id", F.lit(rule).alias("match_type"), F.lit(SCORES[rule]).alias("score"))


def candidates(items: DataFrame) -> DataFrame:
    """All five rules over ``items(id, type, code, name, alias, pinyin, category)``."""
    rows = materialized(keyed(items).select("id", "type", *KEYS))  # one pass over the items' texts
    return reduce(DataFrame.unionByName, [
        star(rows, ["type", "code_norm"], "type_code_exact"),
        star(rows, ["type", "name_norm"], "type_name_exact"),
        star(rows, ["type", "pinyin_norm", "category_norm"], "pinyin_category_suspect"),
        star(rows, ["fingerprint"], "fingerprint_match"),
        alias_links(rows),
    ])


KEYS = ["code_norm", "name_norm", "pinyin_norm", "alias_norm", "category_norm", "fingerprint"]
#: A bit for each rule.
BITS = {rule: 1 << k for k, rule in enumerate(SCORES)}


def _keys(rows: DataFrame) -> DataFrame:
    """(id, fingerprint_key, name_key, pinyin_key, coded) of keyed rows, and the keys of their aliases: digests of 16 bytes, told apart by
    kind. A code's fingerprint holds type and code alone and in one way, so it is the key of the rule of both, too."""
    def key(kind, *parts):
        whole = reduce(lambda a, b: a & b, (p.isNotNull() for p in parts))
        return F.when(whole, F.substring(F.unhex(F.sha2(F.concat_ws("\x1f", F.lit(kind), *parts), 256)), 1, 16))

    names = F.filter(F.split(F.coalesce("alias_norm", F.lit("")), r"\|"), lambda t: t != "")
    return rows.select(
        "id", key("fingerprint", F.col("fingerprint")).alias("fingerprint_key"), (F.col("type").isNotNull() & F.col("code_norm").isNotNull()).alias("coded"),
        key("name", F.col("type"), F.col("name_norm")).alias("name_key"),
        key("pinyin", F.col("type"), F.col("pinyin_norm"), F.col("category_norm")).alias("pinyin_key"),
        F.transform(F.array_distinct(names), lambda t: key("name", F.col("type"), t)).alias("alias_keys"),
    )


def _row_keys(imported: DataFrame) -> DataFrame:
    """(id, key, rules) of each import row: its keys, each once, with the bits of the rules under which it has them. Neither
    written nor dealt: it is computed anew by each step that reads it."""
    def entry(key, *rules):
        return F.struct(F.col(key).alias("key"), F.lit(sum(BITS[r] for r in rules)).alias("rules"))

    coded = F.struct(F.col("fingerprint_key").alias("key"), F.when(F.col("coded"), BITS["fingerprint_match"] | BITS["type_code_exact"]).otherwise(BITS["fingerprint_match"]).alias("rules"))
    told = F.array(coded, entry("name_key", "type_name_exact", "name_alias_match"), entry("pinyin_key", "pinyin_category_suspect"))
    return _keys(keyed(imported)).select("id", F.inline(told)).where("key is not null")


def _item_keys(items: DataFrame) -> DataFrame:
    """(id, key, rule) of each item under each rule, told by its bit; an alias rule meets an item's aliases with a row's name."""
    def entry(key, rule):
        return F.struct(key.alias("key"), F.lit(BITS[rule]).alias("rule"))

    told = F.concat(
        F.array(
            entry(F.col("fingerprint_key"), "fingerprint_match"), entry(F.when(F.col("coded"), F.col("fingerprint_key")), "type_code_exact"),
            entry(F.col("name_key"), "type_name_exact"), entry(F.col("pinyin_key"), "pinyin_category_suspect"),
        ),
        F.transform("alias_keys", lambda k: entry(k, "name_alias_match")),
    )
    return _keys(keyed(items)).select("id", F.inline(told)).where("key is not null")


#: Rows of one key that a task may be dealt; at most so many keys of more are told, by a sketch that tracks so many.
HOT_ROWS, HOT_KEYS, TRACKED = 100_000, 10_000, 1 << 16


def _hot(new: DataFrame) -> DataFrame:
    """(hot): hashes of the keys that more than HOT_ROWS rows share, by a sketch of all rows. It decides no row, only how a key's
    rows meet their class."""
    told = new.agg(F.expr(f"approx_top_k(xxhash64(key), {HOT_KEYS}, {TRACKED})")).first()[0]
    return new.sparkSession.createDataFrame(pa.table({"hot": pa.array([r["item"] for r in told or () if r["count"] > HOT_ROWS], pa.int64())}))


def row_candidates(imported: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, members): for each import row and rule the class of existing items that match, with its size, and the
    classes' items. Every match is a link joined with the members of its class; a class of many items under a key of many
    rows is told by its rows and items, not by its pairs.

    links: row_id, class_id (the least item), match_type, score, n_items, key; members: key, match_type, item_id.
    """
    new, old = _row_keys(imported), _item_keys(items)
    classes = old.groupBy("rule", "key").agg(F.min("id").alias("class_id"), F.count("*").alias("n_items"))
    rules = F.create_map(*(F.lit(x) for rule, bit in BITS.items() for x in (bit, rule)))
    scores = F.create_map(*(F.lit(x) for rule, bit in BITS.items() for x in (bit, SCORES[rule])))
    # the rows of a key that many rows share stay where they are, and meet their class by a broadcast: such keys are few. Of others
    # neither side is broadcast: items are taken to be as few bytes as their file, their keys are more
    hot = F.broadcast(_hot(new))
    is_hot = F.xxhash64("key") == F.col("hot")

    def met(rows, classes):
        return rows.alias("r").join(classes.alias("c"), (F.col("r.key") == F.col("c.key")) & (F.col("rules").bitwiseAND(F.col("rule")) != 0)).select("r.*", "rule", "class_id", "n_items")

    links = met(new.join(hot, is_hot, "left_anti").hint("merge"), classes).unionByName(met(new, F.broadcast(classes.join(hot, is_hot, "left_semi")))).select(
        F.col("id").alias("row_id"), "class_id", F.element_at(rules, F.col("rule")).alias("match_type"), F.element_at(scores, F.col("rule")).alias("score"), "n_items", "key"
    )
    asked = new.groupBy("key").agg(F.bit_or("rules").alias("rules"))
    held = old.alias("o").join(asked.alias("a"), (F.col("o.key") == F.col("a.key")) & (F.col("rules").bitwiseAND(F.col("rule")) != 0), "left_semi")
    return links, held.select("key", F.element_at(rules, F.col("rule")).alias("match_type"), F.col("id").alias("item_id"))


def candidate_pairs(links: DataFrame, members: DataFrame, row_ids: DataFrame) -> DataFrame:
    """(row_id, item_id, match_type, score) of a few rows, such as a page of them: each item once for each rule."""
    some = links.join(row_ids.select("row_id"), "row_id", "left_semi")
    return some.join(members, ["key", "match_type"]).select("row_id", "item_id", "match_type", "score").distinct()


def candidate_list(candidates: DataFrame, items: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates ``(item_id, duplicate_id, row_id, ...)`` with the names of both items and of the import row, where there are such."""
    def named(df, key, alias):
        return df.select(F.col("id").alias(key), F.col("name").alias(alias))

    out = candidates.join(named(items, "item_id", "item_name"), "item_id", "left").join(named(items, "duplicate_id", "duplicate_name"), "duplicate_id", "left")
    return out.join(named(rows, "row_id", "row_name"), "row_id", "left")


def least_id(refs: DataFrame, items: DataFrame, item_type: str) -> DataFrame:
    """(ref_id, item_id): the least id of the items of a type with the name that each ref has; null without one."""
    first = items.where(F.col("type") == item_type).groupBy("name").agg(F.min("id").alias("item_id"))
    return refs.join(first, "name", "left").select("ref_id", "item_id")


def new_pending(found: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that aren't pending yet; null keys equal null keys."""
    same = reduce(lambda a, b: a & b, (F.col(f"f.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys))
    return found.alias("f").join(pending.alias("p"), same, "left_anti").dropDuplicates(keys)


def merged(strategy: str, target: dict[str, Column], source: dict[str, Column]) -> dict[str, Column]:
    """Columns of the kept item after a merge.

    overwrite: the source's values where it has any; fill_empty: the source's where the target is blank, the name
    untouched; merge_tags: tags and aliases united; keep_existing and save_as_new: the target's.
    """
    if strategy == "overwrite":
        return {c: F.coalesce(source[c], target[c]) for c in target}
    if strategy == "fill_empty":
        return {c: target[c] if c == "name" else F.coalesce(T.blank_to_null(target[c]), source[c], target[c]) for c in target}
    if strategy == "merge_tags":
        return {c: T.merge_tags(target[c], source[c]) if c in ("tags", "alias") else target[c] for c in target}
    if strategy in ("keep_existing", "save_as_new"):
        return dict(target)
    raise ValueError(f"unknown merge strategy {strategy!r}")


def resolve_reference(refs: DataFrame, items: DataFrame, *, match_type: bool = False) -> DataFrame:
    """(ref_id, item_id): where a reference gives an item_id, that item or none; else the largest id among the items of its
    code or its name (within the type, if asked). A key's largest id is found first, so that each reference meets one row a
    key."""
    given = refs.where("item_id is not null").select("ref_id", "item_id")
    found = given.join(items.select(F.col("id").alias("item_id")).distinct(), "item_id").select("ref_id", "item_id")
    named = refs.where("item_id is null")
    for kind in ("code", "name"):
        keys = [kind, "type"] if match_type else [kind]
        last = items.where(F.col(kind).isNotNull()).groupBy(*keys).agg(F.max("id").alias("found"))
        hit = named.where(F.col(kind).isNotNull()).select("ref_id", *keys).join(last, keys).select("ref_id", F.col("found").alias("item_id"))
        found = found.unionByName(hit)
    return found.groupBy("ref_id").agg(F.max("item_id").alias("item_id"))
