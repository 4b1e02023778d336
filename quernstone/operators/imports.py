"""Import pipeline over schemaless rows: detection, mapping, normalization, validation, staging, plan, execution.

A row is a map of strings, ``record``; nested values are JSON text (see ``sources.records``). Unknown keys are kept until
they go to the item's detail. The headers of a file are few and come to the driver; its rows don't.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import values as V
from quernstone.operators.store import materialized

# Header aliases of each target field.
ALIASES = {
    "name": ["名称", "name", "标题", "条目名", "药名", "方名", "穴名"],
    "code": ["编号", "code", "穴号", "经络编号", "编码"],
    "category": ["分类", "类别", "category", "所属经络", "经络"],
    "summary": ["摘要", "summary", "简介"],
    "content": ["原文", "正文", "content", "条文", "original_text"],
    "source_note": ["出处", "来源", "source", "source_note", "source_url"],
    "tags": ["标签", "tags", "关键词", "keywords"],
    "type": ["类型", "type", "知识类型"],
    "nature_flavor": ["性味"], "four_qi": ["四气", "寒热温凉", "寒热属性"], "five_flavors": ["五味"], "meridians": ["归经"],
    "channel_tropism": ["归脏腑", "归经脏腑", "入经"], "toxicity": ["毒性"], "origin": ["产地", "来源产地", "药材来源"],
    "effects": ["功效"], "indications": ["主治"], "contraindications": ["禁忌"], "processing": ["炮制"],
    "classic_applications": ["仲景", "经方应用", "经典应用"], "composition": ["组成", "方药", "药物组成"], "usage": ["用法"],
    "explanation": ["方解"], "body_region": ["部位"], "standard_location": ["定位"], "locating_method": ["取穴"], "precautions": ["注意事项"],
}
ALIAS_TARGET = {T.header_key_text(a): target for target, names in ALIASES.items() for a in names}
# Fields that a type's headers may map to, beside the core ones.
CORE = ["type", "code", "name", "category", "summary", "content", "source_note", "tags"]
TYPE_FIELDS = {
    "herb": ["nature_flavor", "four_qi", "five_flavors", "meridians", "channel_tropism", "toxicity", "origin", "effects", "indications", "contraindications", "processing", "classic_applications"],
    "formula": ["composition", "usage", "effects", "indications", "explanation"],
    "acupoint": ["meridian_name", "body_region", "standard_location", "locating_method", "precautions"],
}
# Fields that are typical of a type (full prior), and core fields with most of it.
TYPICAL = {
    "herb": {f for f in TYPE_FIELDS["herb"] if f != "contraindications"},
    "formula": {"composition", "usage", "explanation", "indications"},
    "acupoint": {"standard_location", "locating_method", "body_region"},
}
USUAL = {"name", "type", "content", "source_note", "tags"}
LABELS = {"中药": "herb", "方剂": "formula", "穴位": "acupoint"}


def detect_type(file_name: str, headers: list[str], source_format: str = "json") -> tuple[str, float]:
    """(detected type, confidence) from the file's name and headers; of equal confidences the later rule wins."""
    name, have = file_name.lower(), {T.header_key_text(h) for h in headers}

    def every(*fields):
        return have.issuperset(fields)

    def some(*fields):
        return not have.isdisjoint(fields)

    core = ("type", "code", "name", "category", "summary", "content", "sourcenote", "tags", "detail", "datastatus")
    # The rules in order, (type, confidence, whether it holds); of a type's rules the first that holds counts.
    rules = [
        ("knowledge_items_v1", 0.98, "knowledge_items_import" in name or "knowledgeitems" in name),
        ("knowledge_items_v1", 0.94, every("type", "name") and some("content", "sourcenote", "detail")),
        ("knowledge_items_v1", 0.86, sum(c in have for c in core) >= 5),
        ("classic_passages_v1", 0.98, "classic_passages" in name),
        ("classic_passages_v1", 0.95, every("worktitle", "originaltext", "sectiontitle") or every("classicid", "pagetitle", "originaltext")),
        ("classic_passages_v1", 0.85, every("classicname", "originaltext")),
        ("annotation_items_v1", 0.99, "annotation_items_import" in name),
        ("annotation_items_v1", 0.95, every("canonicalkey", "content") and some("annotationtype", "targettype", "sourcenote")),
        ("search_terms_v1", 0.98, "search_terms" in name),
        ("search_terms_v1", 0.94, every("term", "termtype", "weight") or every("itemname", "term")),
        ("standard_terms_v1", 0.94, every("termtype", "standardname", "aliases")),
        ("relation_suggestions_v1", 0.92, any(every(*p, "relationtype") for p in (("sourcename", "targetname"), ("sourcecode", "targetcode"), ("sourceitemid", "targetitemid"))) or every("sourcetype", "targettype")),
    ]
    firsts: dict[str, float] = {}
    for kind, confidence, holds in rules:
        if holds:
            firsts.setdefault(kind, confidence)
    if firsts:
        best = max(firsts.values())
        return [(k, c) for k, c in firsts.items() if c == best][-1]
    return {"csv": ("generic_csv", 0.5), "xlsx": ("generic_csv", 0.5), "json": ("generic_json", 0.45), "zip": ("generic_json", 0.4)}.get(source_format, ("unknown", 0.0))


def headers(rows: DataFrame, sample: int | None = None) -> list[str]:
    """Keys of all rows, or of the first ``sample`` ones, sorted."""
    some = rows if sample is None else rows.orderBy("row_index").limit(sample)
    return sorted(r[0] for r in some.select(F.explode(F.map_keys("record")).alias("k")).distinct().collect())


def _similarity(a: str, b: str) -> float:
    return 2 * sum(ch in b for ch in a) / (len(a) + len(b)) if a or b else 0.0


def _matches(target: str, v: Column) -> Column:
    """Whether a value looks like the field's."""
    if target == "type":
        return v.isin("中药", "方剂", "经络", "穴位", "证型", "病症", "herb", "formula", "meridian", "acupoint", "syndrome", "disease")
    if target == "code":
        return v.rlike("[0-9]") & (F.octet_length(v) <= 40)
    if target == "tags":
        return v.rlike("[,，;；、|]")
    if target == "content":
        return F.length(v) >= 20
    if target == "summary":
        return F.length(v) <= 120
    if target == "source_note":
        return v.rlike("《|http|经|论")
    return v != ""


# Neighbours that speak for a field.
CONTEXT = {
    "name": {"type", "content", "summary", "原文"}, "content": {"name", "sourcenote", "originaltext"},
    "source_note": {"content", "originaltext", "worktitle"}, "tags": {"name", "type", "content"},
}


def score_mapping(rows: DataFrame, target_type: str, sample: int = 20) -> list[dict]:
    """For each header of the first ``sample`` rows, which stand for a file's: source, target (or None), confidence and
    decision (auto from .85, confirm from .55, else ignore). Scores decide what is mapped without asking; which keys a
    row has is decided row by row, in ``apply_mapping``.

    Of 100 points, 40 go to the name, 35 to how many of the first values look right, 15 to the neighbours, 10 to the
    type. All value shares of the sample are counted in one job.
    """
    kind = LABELS.get(target_type, target_type)
    fields = CORE + TYPE_FIELDS.get(kind, [])
    names = headers(rows, sample)
    keys = {T.header_key_text(h) for h in names}
    chosen = {}
    for h in names:
        key = T.header_key_text(h)
        if key in ALIAS_TARGET:
            chosen[h] = (ALIAS_TARGET[key], 40.0)
            continue
        scored = [(_similarity(key, T.header_key_text(f"detail.{f}" if f not in CORE else f)), i, f) for i, f in enumerate(fields)]
        best = max(scored)  # of equal ones the last
        chosen[h] = (best[2], best[0] * 40) if best[0] * 40 >= 18 else (None, 0.0)
    first = rows.orderBy("row_index").limit(sample)
    told = [h for h in names if chosen[h][0]]
    shares = {}
    if told:
        values = {h: T.blank_to_null(F.try_element_at("record", F.lit(h))) for h in told}
        row = first.agg(*(F.avg(_matches(chosen[h][0], values[h]).cast("double")).alias(f"s{i}") for i, h in enumerate(told))).first()
        shares = {h: row[i] or 0.0 for i, h in enumerate(told)}
    out = []
    for h in names:
        target, name_score = chosen[h]
        confidence = 0.0
        if target:
            context = 15.0 * bool(keys & CONTEXT.get(target, {"type", "name", "category"}))
            prior = 10 * (1.0 if target in TYPICAL.get(kind, ()) else 0.8 if target in USUAL else 0.4)
            confidence = min((name_score + 35 * shares[h] + context + prior) / 100, 1.0)
        decision = "auto" if confidence >= 0.85 else "confirm" if confidence >= 0.55 else "ignore"
        out.append({"source": h, "target": target, "confidence": confidence, "decision": decision})
    return out


# The fields that the mapping service tries, in its order.
TARGET_FIELDS = (
    "type code name alias pinyin category summary content source_note tags nature_flavor four_qi five_flavors meridians channel_tropism toxicity origin "
    "effects indications dosage contraindications compatibility processing classic_applications notes source_text composition usage explanation "
    "modifications meridian_code yin_yang hand_foot organ_relation paired_meridian pathway_text main_indications acupoint_code body_region "
    "body_subregion side_type standard_location locating_method bone_cun anatomy functions needling_summary moxibustion_summary massage_summary "
    "precautions risk_level symptoms tongue pulse pathogenesis treatment_principle common_syndromes care_advice medical_warning detail"
).split()
NEAR_FIELD = 0.6


def auto_mapping(headers: DataFrame) -> DataFrame:
    """(header, field) of the distinct ``headers(header)`` that have a field: by alias, else the field of the largest Jaro
    similarity above ``NEAR_FIELD``, of equal ones the first. This is the mapping service's rule; ``score_mapping`` is the
    engine's, which scores by values, too, and of equal fields takes the last."""
    from quernstone.functions.udfs import jaro

    keyed = headers.select("header").distinct().withColumn("key", T.header_key("header"))
    keyed = keyed.withColumn("field", F.regexp_replace(T.lookup("key", ALIAS_TARGET), "^detail[.]", ""))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.lit(T.header_key_text(f)).alias("key"), F.lit(-i).alias("place")) for i, f in enumerate(TARGET_FIELDS))))
    tried = keyed.where("field is null").select("header", "key", each.alias("f")).withColumn("score", jaro("key", "f.key")).where(F.col("score") > NEAR_FIELD)
    best = tried.groupBy("header").agg(F.max_by("f.name", F.struct("score", "f.place")).alias("field"))
    return keyed.where("field is not null").select("header", "field").unionByName(best)


def to_targets(record: Column, active: dict[str, str], keep: bool = False) -> Column:
    """A map with target fields as keys: each key goes where ``active`` says, else by its alias; of a field's sources the
    first in sorted order wins. Keys without a target go, or stay as they are (``keep``)."""
    def target(key: Column) -> Column:
        told = T.lookup(T.header_key(key), ALIAS_TARGET)
        told = F.coalesce(T.lookup(key, active), told) if active else told
        return F.regexp_replace(F.coalesce(told, key) if keep else told, "^detail[.]", "")

    def firsts(there: Column) -> Column:
        return V.let(F.transform(there, lambda e: e["key"]), lambda names: F.filter(there, lambda e, i: F.array_position(names, e["key"]) == i + 1))

    pairs = F.transform(F.array_sort(F.map_entries(record)), lambda e: F.struct(target(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(V.let(F.filter(pairs, lambda e: e["key"].isNotNull() & e["value"].isNotNull()), firsts))


def apply_mapping(rows: DataFrame, target_type: str, scored: list[dict], explicit: dict[str, str] | None = None) -> DataFrame:
    """Records with target fields as keys; an explicit mapping replaces the automatic one, and every key of every row that
    is outside it goes by its alias, whether or not the scored rows had it."""
    active = explicit if explicit is not None else {s["source"]: s["target"] for s in scored if s["decision"] == "auto"}
    return rows.withColumn("record", with_defaults(V.overlay(to_targets(F.col("record"), active), F.create_map(F.lit("type"), F.lit(target_type)))))


#: Fields that say where a record stands, and those of them that go into its source note.
CONTEXT_FIELDS = ["classic_id", "page_title", "section_title", "source_url", "work_title"]
NOTED_FIELDS = ["source_url", "classic_id", "page_title", "section_title"]
#: Fields of a detail that are kept together, as an object's text, in its notes.
KEPT_FIELDS = sorted([*CONTEXT_FIELDS, "volume", "annotation"])


def lift_detail(record: Column) -> Column:
    """The record with the keys of its detail object lifted beside its own, by alias where they have one; what the record
    has already stays. The context fields that it then has are appended to the source note."""
    return V.let(record, _lift_detail)


def _lift_detail(record: Column) -> Column:
    detail = F.try_element_at(record, F.lit("detail"))
    own = F.map_filter(record, lambda k, v: (k != "detail") & v.isNotNull())

    def with_lifted(own: Column, parsed: Column) -> Column:
        told = V.let(to_targets(parsed, {}, keep=True), lambda fields: V.let(kept_notes(detail), lambda notes: V.overlay(fields, notes)))
        return F.when(parsed.isNull(), own).otherwise(V.let(told, lambda told: V.overlay(own, told)))

    def noted(whole: Column) -> Column:
        note = T.source_note(F.try_element_at(whole, F.lit("source_note")), *(F.try_element_at(whole, F.lit(f)) for f in NOTED_FIELDS))
        return V.let(V.let(note, T.blank_to_null), lambda note: put(whole, {"source_note": note}))

    return V.let(V.let(own, lambda own: V.let(F.from_json(detail, "map<string,string>"), lambda parsed: with_lifted(own, parsed))), noted)


def kept_notes(detail: Column) -> Column:
    """A map with ``notes``, the object's text of those fields of a JSON detail that say where it stands, by their header keys,
    with their values as they are; an empty map where there is none."""
    keyed = F.transform(F.map_entries(F.from_json(detail, "map<string,variant>")), lambda e: F.struct(T.header_key(e["key"]).alias("key"), e["value"].alias("value")))
    return V.let(V.let(keyed, _kept_text), lambda kept: F.when(kept != "", F.create_map(F.lit("notes"), F.concat(F.lit("{"), kept, F.lit("}")))).otherwise(F.create_map().cast("map<string,string>")))


def _kept_text(entries: Column) -> Column:
    def field(name: str) -> Column:
        found = F.get(F.filter(entries, lambda e: e["key"] == T.header_key_text(name)), F.lit(0))["value"]
        return V.let(found, lambda v: F.when(~F.is_variant_null(v), F.to_json(v)).otherwise(F.when(v.isNotNull(), "null")))

    return F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), field(name)) for name in KEPT_FIELDS))


def preview(rows: DataFrame, file_name: str, source_format: str, target_type: str) -> dict:
    """What a file holds: headers (of all rows), detected type with confidence, field mapping and the first 100 rows."""
    names = headers(rows)
    kind, confidence = detect_type(file_name, names, source_format)
    return {"headers": names, "import_type": kind, "confidence": confidence, "mapping": score_mapping(rows, target_type), "rows": rows.orderBy("row_index").limit(100)}


def save_template(store, template_id: int, mapping: dict[str, str]) -> None:
    """An explicit mapping under an id, in place of the one saved before."""
    spark = store.spark
    store.upsert("mapping_templates", spark.createDataFrame([(template_id, mapping)], "id long, mapping map<string,string>"), ["id"])


def template(store, template_id: int) -> dict[str, str] | None:
    row = store.read("mapping_templates").where(F.col("id") == template_id).first() if store.exists("mapping_templates") else None
    return row and dict(row["mapping"])


def get(record: Column, *names: str) -> Column:
    return V.first_text(record, *names)


def put(record: Column, values: dict[str, Column]) -> Column:
    """The record with values set; null ones are left as they were."""
    made = F.map_from_entries(F.array(*(F.struct(F.lit(k), v) for k, v in values.items())))
    return V.let(F.map_filter(made, lambda k, v: v.isNotNull()), lambda new: F.map_concat(new, F.map_filter(record, lambda k, _: ~F.map_contains_key(new, k))))


#: Statuses that an import may set.
IMPORT_STATUSES = ["pending_review", "reviewed", "needs_check", "imported", "validated", "ready"]


def with_detail_keys(detail: Column, values: Column) -> Column:
    """A JSON object's text with the keys of a struct, which take the place of equal ones; other text is wrapped as
    ``raw_detail`` first."""
    parsed = F.try_parse_json(detail)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    wrapped = F.struct(detail.alias("raw_detail"), F.lit(True).alias("parse_error"))
    text = F.when(T.blank_to_null(detail).isNull(), F.lit("{}")).when(is_object, detail).otherwise(F.to_json(wrapped))
    variants = "map<string,variant>"
    old, new = F.parse_json(text).cast(variants), F.parse_json(F.to_json(values)).cast(variants)
    return F.to_json(V.let(new, lambda fresh: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)))


def with_defaults(record: Column) -> Column:
    """Folded type, tags, summary and status where they are missing; a type that was folded is told in the detail."""
    return V.let(record, _with_defaults)


def _with_defaults(record: Column) -> Column:
    kind = F.coalesce(get(record, "type"), F.lit("note"))
    folded = T.item_type(kind)
    tags = F.array_join(F.filter(F.array(get(record, "name"), get(record, "category"), folded), lambda x: x.isNotNull()), ",")
    status = get(record, "data_status")
    detail = F.coalesce(F.try_element_at(record, F.lit("detail")), F.lit("{}"))
    warning = F.struct(F.format_string("原 type '%s' 不在允许集合中，已按 %s 导入。", kind, folded).alias("import_warning"), kind.alias("original_type"))
    return put(record, {
        "type": folded,
        "alias": F.coalesce(F.try_element_at(record, F.lit("alias")), F.lit("[]")),
        "pinyin": F.coalesce(F.try_element_at(record, F.lit("pinyin")), F.lit("")),
        "detail": F.when(folded != kind, with_detail_keys(detail, warning)).otherwise(detail),
        "summary": F.coalesce(get(record, "summary"), T.summary_of(get(record, "content"))),
        "tags": F.coalesce(get(record, "tags"), tags),
        "data_status": F.when(status.isin(IMPORT_STATUSES), status).otherwise("pending_review"),
    })


def adapt_passage(record: Column) -> Column:
    """A classic passage as an item record."""
    return V.let(record, _adapt_passage)


def _adapt_passage(record: Column) -> Column:
    work = F.coalesce(get(record, "work_title", "classic_name", "classic_title"), F.lit("原典"))
    section = F.coalesce(get(record, "section_title", "section", "title", "page_title"), F.lit("未命名条文"))
    original = F.coalesce(get(record, "original_text", "content", "正文", "原文"), F.lit(""))
    where = F.array_join(F.filter(F.array(work, get(record, "page_title", "volume"), section), lambda x: x.isNotNull()), " / ")
    return with_defaults(put(V.residual(record, ["tags"]), {
        "type": F.lit("syndrome"), "name": F.concat(work, F.lit(" - "), section), "category": F.concat(F.lit("原典 / "), work),
        "summary": T.summary_of(original), "content": original, "source_note": F.coalesce(get(record, "source_note", "source", "出处", "来源"), where),
        "data_status": F.lit("validated"), "tags": F.concat_ws(",", F.lit("原典"), work, section), "detail": F.to_json(record),
    }))


def adapt_annotation(record: Column) -> Column:
    """An annotation as a record for the item that its canonical key names."""
    return V.let(record, _adapt_annotation)


def _adapt_annotation(record: Column) -> Column:
    kind, name = T.canonical_key(F.coalesce(get(record, "canonical_key", "canonicalKey"), F.lit("")))
    return with_defaults(put(record, {
        "type": kind, "name": name, "content": get(record, "content", "annotation", "annotation_text"),
        "source_title": get(record, "source_title", "title"), "source_note": get(record, "source_note", "source", "page_ref"),
        "category": F.coalesce(get(record, "category"), F.lit("人纪注解")), "data_status": F.lit("imported"), "detail": F.to_json(record),
    }))


def adapt_term(record: Column) -> Column:
    """A search-term record with default type and weight."""
    return put(record, {"term": get(record, "term", "keyword", "关键词", "搜索词"), "term_type": F.coalesce(get(record, "term_type", "termType", "词类型"), F.lit("imported")), "weight": F.coalesce(get(record, "weight", "score", "权重"), F.lit("80"))})


def adapt_suggestion(record: Column) -> Column:
    return put(record, {"relation_type": F.coalesce(get(record, "relation_type", "relationType", "关系类型"), F.lit("related_to")), "confidence": F.coalesce(get(record, "confidence", "置信度"), F.lit("0.8"))})


ADAPTERS = {"knowledge_items_v1": with_defaults, "classic_passages_v1": adapt_passage, "annotation_items_v1": adapt_annotation, "search_terms_v1": adapt_term, "standard_terms_v1": lambda r: r, "relation_suggestions_v1": adapt_suggestion}


def normalize_record(record: Column) -> Column:
    """Half-width, trimmed values; upper-case codes; split lists; folded categories; blanks out."""
    return V.let(record, _normalize_record)


def _normalize_record(record: Column) -> Column:
    wide = F.map_from_entries(F.transform(F.map_entries(record), lambda e: F.struct(e["key"], T.strip(T.half_width(e["value"])))))
    lists = {f: T.split_join(F.try_element_at(wide, F.lit(f))) for f in ("tags", "alias", "meridians")}
    code = F.upper(F.coalesce(get(wide, "code"), get(wide, "acupoint_code")))
    out = put(wide, {**lists, "code": code, "category": T.category(get(wide, "category"))})
    return F.map_filter(out, lambda k, v: v != "")


def standardize(tokens: DataFrame, terms: DataFrame, term_type: str, *, strict: bool = False) -> DataFrame:
    """(token, standard_name): tokens(token) by the vocabulary ``terms(term_type, standard_name, aliases, code)``.

    By default a token meets a name or code exactly or an alias without regard to ASCII case; ``strict`` knows exact
    names and comma-parted aliases only. Of several names the least wins; unknown tokens keep their spelling.
    """
    own = terms.where(F.col("term_type") == term_type)
    alias = F.explode(T.split_terms(F.coalesce("aliases", F.lit("")))) if not strict else F.explode(F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), T.strip))
    exact = own.select("standard_name", F.explode(F.array("standard_name") if strict else F.array("standard_name", "code")).alias("key"))
    other = own.select("standard_name", alias.alias("key")).where("key != ''")
    fold = (lambda c: c) if strict else (lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    keys = exact.where("key is not null").select("standard_name", F.concat(F.lit("="), "key").alias("key")).unionByName(other.select("standard_name", F.concat(F.lit("~"), fold(F.col("key"))).alias("key")))
    names = keys.groupBy("key").agg(F.min("standard_name").alias("standard_name"))
    t = tokens.select("token", F.posexplode(F.array(F.concat(F.lit("="), "token"), F.concat(F.lit("~"), fold(F.col("token"))))).alias("p", "key"))
    best = t.join(names, "key", "left").groupBy("token").agg(F.min_by("standard_name", F.when(F.col("standard_name").isNotNull(), F.col("p"))).alias("s"))
    return best.select("token", F.coalesce("s", "token").alias("standard_name"))


#: Types that validation accepts.
KNOWLEDGE_TYPES = ["herb", "formula", "meridian", "acupoint", "syndrome", "disease", "中药", "方剂", "经络", "穴位", "证型", "病症", "acupuncture", "theory", "note"]
ISSUE = "struct<severity:string,issue_code:string,field_name:string,message:string>"


def issue(holds: Column, severity: str, code: str, field: str, message: str) -> Column:
    made = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("issue_code"), F.lit(field).alias("field_name"), F.lit(message).alias("message"))
    return F.when(F.coalesce(holds, F.lit(False)), made)


def row_issues(kind: Column, name: Column, code: Column, extra: list[Column] | None = None) -> Column:
    """Issues of a row, in the order of the rules."""
    rules = [
        issue(T.blank_to_null(kind).isNull(), "error", "required", "type", "type is required"),
        issue(T.blank_to_null(name).isNull(), "error", "required", "name", "name is required"),
        issue(~T.strip(kind).isin(KNOWLEDGE_TYPES) & (T.strip(kind) != ""), "error", "invalid_enum", "type", "type is not allowed"),
        issue(~T.valid_code(T.strip(code)) & (T.strip(code) != ""), "error", "invalid_code_format", "code", "code is malformed"),
        *(extra or []),
    ]
    return F.filter(F.array(*rules), lambda i: i.isNotNull())


def status_of(issues: Column) -> Column:
    return F.when(F.exists(issues, lambda i: i["severity"] == "error"), "error").when(F.size(issues) > 0, "warning").otherwise("valid")


def messages(issues: Column, severity: str) -> Column:
    told = F.transform(F.filter(issues, lambda i: i["severity"] == severity), lambda i: i["message"])
    return F.when(F.size(told) > 0, F.array_join(told, "; "))


def rule_issues(rules: list[dict], value_of) -> list[Column]:
    """Declarative rules (field_name, rule_type required | pattern | enum, rule_params, severity, message) as issues."""
    out = []
    for r in rules:
        v, p = T.blank_to_null(value_of(r["field_name"])), r.get("rule_params") or {}
        holds = {"required": lambda: v.isNull(), "pattern": lambda: ~v.rlike(p["pattern"]), "enum": lambda: ~v.isin(p["allowed_values"])}[r["rule_type"]]()
        out.append(issue(holds, r["severity"], r["rule_type"], r["field_name"], r["message"]))
    return out


def validated(rows: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """Rows with issues, status and messages computed anew from their normalized record; issues of joins are gone."""
    n = F.col("normalized")
    told = rows.withColumn("issues", row_issues(*(F.try_element_at(n, F.lit(f)) for f in ("type", "name", "code")), extra))
    return _with_status(told)


def _with_status(rows: DataFrame) -> DataFrame:
    i = F.col("issues")
    return rows.withColumns({"status": status_of(i), "error_message": messages(i, "error"), "warning_message": messages(i, "warning")})


def stage(rows: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """Rows with normalized record, issues, status and messages; the normalized rows are written once, as staging is."""
    return validated(materialized(rows.withColumn("normalized", normalize_record(F.col("record")))), extra)


def _add_issue(staged: DataFrame, made: Column) -> DataFrame:
    return _with_status(staged.withColumn("issues", F.concat("issues", F.filter(F.array(made), lambda i: i.isNotNull()))))


def check_references(staged: DataFrame, names: DataFrame) -> DataFrame:
    """Staged rows, those of acupoints with a warning where their ``meridians`` is none of ``names(name)``, as a whole."""
    n = F.col("normalized")
    known = names.select(T.strip("name").alias("_known")).where("_known is not null").distinct()
    told = staged.withColumn("_asked", F.when(F.try_element_at(n, F.lit("type")).isin("穴位", "acupoint"), get(n, "meridians")))
    met = told.join(known, F.col("_asked") == F.col("_known"), "left")
    lost = F.col("_asked").isNotNull() & F.col("_known").isNull()
    return _add_issue(met, issue(lost, "warning", "reference_not_found", "meridians", "meridian is not among the items")).drop("_asked", "_known")


def check_existing(staged: DataFrame, items: DataFrame) -> DataFrame:
    """Staged rows, with a warning where ``items(id, type, code, name)`` has one of the same type and code, else of the same
    type and name; of several the least id is named. Codes are compared without spaces and hyphens, names without spaces."""
    def key(c, drop, fold):
        return F.nullif(fold(F.regexp_replace(T.blank_to_null(c), drop, "")), F.lit(""))

    n = F.col("normalized")
    sides = {"code": ("[ -]", F.upper), "name": (" ", F.lower)}
    met = staged.withColumn("_type", get(n, "type"))
    for field, (drop, fold) in sides.items():
        first = items.select("type", key(field, drop, fold).alias("k"), "id", "name").where("type is not null and k is not null")
        first = first.groupBy(F.col("type").alias("_type"), F.col("k").alias(f"_{field}")).agg(F.min(F.struct("id", "name")).alias(f"_by_{field}"))
        met = met.withColumn(f"_{field}", key(F.try_element_at(n, F.lit(field)), drop, fold)).join(first, ["_type", f"_{field}"], "left")
    hit = F.coalesce("_by_code", "_by_name")
    made = F.struct(
        F.lit("warning").alias("severity"), F.lit("possible_existing_duplicate").alias("issue_code"),
        F.when(F.col("_by_code").isNotNull(), "code").otherwise("name").alias("field_name"),
        F.format_string("item #%s has the same type and key: %s", hit["id"].cast("string"), hit["name"]).alias("message"),
    )
    return _add_issue(met, F.when(hit.isNotNull(), made)).drop("_type", "_code", "_name", "_by_code", "_by_name")


def staging_page(staged: DataFrame, status: str | None, number: int | None, size: int | None) -> DataFrame:
    """A page of staged rows in row order, of one status or all."""
    _, size, offset = V.page_bounds(number, size)
    rows = staged if status is None else staged.where(F.col("status") == status)
    return rows.orderBy("row_index").offset(offset).limit(size)


def clean_step(staged: DataFrame, step: str, **options) -> tuple[DataFrame, DataFrame]:
    """One clean step over normalized records: the rows after it, validated anew, and its change log (row_index, field,
    old_value, new_value).

    Steps: normalize_all, standardize_all, standardize_meridian (all three the full normalization), trim, half_width,
    uppercase_code, split_tags, set_category (value).
    """
    n = F.col("normalized")

    def each(fn):
        return F.map_from_entries(F.transform(F.map_entries(n), lambda e: F.struct(e["key"], fn(e["value"]))))

    steps = {
        "normalize_all": lambda: normalize_record(n), "standardize_all": lambda: normalize_record(n), "standardize_meridian": lambda: normalize_record(n),
        "trim": lambda: each(T.strip), "half_width": lambda: each(T.half_width),
        "uppercase_code": lambda: put(n, {"code": F.upper(get(n, "code"))}),
        "split_tags": lambda: put(n, {"tags": T.split_join(F.try_element_at(n, F.lit("tags")))}),
        "set_category": lambda: put(n, {"category": F.lit(options.get("value"))}),
    }
    if step not in steps:
        raise ValueError(f"unknown clean step {step!r}")
    after = staged.withColumn("new", steps[step]())
    log = after.select("row_index", F.inline(V.diff(n, F.col("new"))))
    return validated(after.withColumn("normalized", F.col("new")).drop("new")), log


def undo_step(staged: DataFrame, log: DataFrame) -> DataFrame:
    """Rows with the old values of a step's log, validated anew; fields that the step added go."""
    old = log.groupBy("row_index").agg(F.map_from_entries(F.collect_list(F.struct("field", "old_value"))).alias("old"))
    back = staged.join(old, "row_index", "left")
    restored = F.map_filter(V.overlay(F.col("old"), F.col("normalized")), lambda k, v: v.isNotNull())
    return validated(back.withColumn("normalized", F.when(F.col("old").isNull(), F.col("normalized")).otherwise(restored)).drop("old"))


def edited(staged: DataFrame, row_index: int, field: str, value: str) -> DataFrame:
    """Staged rows with one field of one row set, validated anew."""
    row = F.col("row_index") == row_index
    return validated(staged.withColumn("normalized", F.when(row, put(F.col("normalized"), {field: F.lit(value)})).otherwise(F.col("normalized"))))


def new_items(staged: DataFrame, items: DataFrame, batch_id: int) -> DataFrame:
    """An item for each staged row without errors, ids after the largest, in row order, with its row_index and record."""
    top = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = numbered(staged.where("status != 'error'"), "row_index").crossJoin(F.broadcast(top))  # top: one row
    n = F.col("normalized")
    fields = [F.try_element_at(n, F.lit(f)).alias(f) for f in ITEM_FIELDS]
    return rows.select((F.col("top") + F.col("number")).alias("id"), *fields, F.to_json(V.residual(n)).alias("detail"), F.lit(batch_id).alias("import_batch_id"), "row_index", "normalized")


def confirmed(staged: DataFrame, items: DataFrame, batch_id: int) -> DataFrame:
    """The items with a new one for each staged row without errors, ids after the largest, in row order."""
    return items.unionByName(new_items(staged, items, batch_id).drop("row_index", "normalized"), allowMissingColumns=True)


#: Type and weight of the terms that a package's rows bring, and the largest weight of its own terms.
PACKAGE_TERM, PACKAGE_WEIGHT, PACKAGE_MOST = "imported_package", 80, 200
PACKAGE_TERMS = "array<struct<term:string,term_type:string,weight:string>>"


def package_terms(made: DataFrame) -> DataFrame:
    """(item_id, term, term_type, weight) that the rows of ``new_items`` bring: those attached to a row, their type led by
    ``package_``, and the parts of name, code, category and tags. One for each normalized term and type, the first weight."""
    def entry(term, kind, weight, place):
        return F.struct(T.normalize(term).alias("term"), kind.alias("term_type"), weight.alias("weight"), F.lit(place).alias("place"))

    n = F.col("normalized")
    own = F.from_json(F.try_element_at(n, F.lit("_package_search_terms")), PACKAGE_TERMS)
    weight = (lambda t: V.clamp(F.coalesce(V.lenient_long(t["weight"]), F.lit(PACKAGE_WEIGHT)), 1, PACKAGE_MOST).cast("int"))
    told = F.transform(F.coalesce(own, F.array().cast(PACKAGE_TERMS)), lambda t: entry(t["term"], F.concat(F.lit("package_"), F.coalesce(T.blank_to_null(t["term_type"]), F.lit(PACKAGE_TERM))), weight(t), 0))
    parts = F.flatten(F.array(*(T.split_terms(F.coalesce(get(n, f), F.lit(""))) for f in ("name", "code", "category", "tags"))))
    rest = F.transform(parts, lambda x: entry(x, F.lit(PACKAGE_TERM), F.lit(PACKAGE_WEIGHT), 1))
    each = made.select(F.col("id").alias("item_id"), F.inline(F.concat(told, rest))).where("term != ''")
    return each.groupBy("item_id", "term", "term_type").agg(F.min_by("weight", F.struct("place", F.col("weight"))).alias("weight"))


def confirm(staged: DataFrame, items: DataFrame, terms: DataFrame, fingerprints: DataFrame, batch_id: int) -> dict[str, DataFrame]:
    """A confirmed import: ``items``, ``terms`` and ``fingerprints(item_id, fingerprint)`` with those of the new items, the
    staged ``rows`` (imported ones with their item_id), and a ``report`` of one row."""
    from quernstone.operators.resolve import keyed

    made = materialized(new_items(staged, items, batch_id))
    rows = staged.join(made.select("row_index", F.col("id").alias("item_id")), "row_index", "left")
    rows = rows.withColumn("status", F.when(F.col("item_id").isNotNull(), "imported").otherwise(F.col("status")))
    marks = keyed(made).select(F.col("id").alias("item_id"), "fingerprint")
    report = rows.agg(F.count("*").alias("n_rows"), F.count("item_id").alias("n_imported"), F.count_if(F.col("status") == "error").alias("n_skipped"))
    return {
        "items": items.unionByName(made.drop("row_index", "normalized"), allowMissingColumns=True), "terms": terms.unionByName(package_terms(made), allowMissingColumns=True),
        "fingerprints": fingerprints.unionByName(marks), "rows": rows, "report": report,
    }


def rolled_back_batch(items: DataFrame, batch_id: int) -> DataFrame:
    """Items without those that the batch created; rows that it only met stay."""
    return items.where(~F.col("import_batch_id").eqNullSafe(F.lit(batch_id)))


def undo_confirm(state: dict[str, DataFrame], batch_id: int) -> dict[str, DataFrame]:
    """A confirmed state without the batch's items, their terms and fingerprints; its rows are marked rolled back."""
    gone = state["items"].where(F.col("import_batch_id").eqNullSafe(F.lit(batch_id))).select(F.col("id").alias("item_id"))
    rows = state["rows"].withColumn("status", F.when(F.col("item_id").isNotNull(), "rolled_back").otherwise(F.col("status"))).withColumn("item_id", F.lit(None).cast("long"))
    return {
        "items": rolled_back_batch(state["items"], batch_id), "terms": state["terms"].join(gone, "item_id", "left_anti"),
        "fingerprints": state["fingerprints"].join(gone, "item_id", "left_anti"), "rows": rows,
    }


def apply_standard_terms(staged: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms(term_type, standard_name, aliases, code, notes)`` after the staged rows: a name that is there takes the rows'
    values where they have any, the last row's first; others are added. Rows with errors don't count."""
    n = F.col("normalized")
    keys, fields = ["term_type", "standard_name"], ["aliases", "code", "notes"]
    rows = staged.where("status != 'error'").select("row_index", *(get(n, f).alias(f) for f in (*keys, *fields))).where("term_type is not null and standard_name is not null")
    new = rows.groupBy(*keys).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("row_index"))).alias(f"new_{f}") for f in fields))
    both = terms.join(new, keys, "full")
    return both.select(*keys, *(F.coalesce(f"new_{f}", f).alias(f) for f in fields))


def _resolved(rows: DataFrame, items: DataFrame, prefix: str, alias: str) -> DataFrame:
    """Rows with the item that ``<prefix>id``, code, name and type name."""
    from quernstone.operators.resolve import resolve_reference

    names = {f: f"{prefix}{f}" for f in ("code", "name", "type")}
    ids = f"{prefix}id" if prefix == "item_" else f"{prefix}item_id"
    n = F.col("normalized")
    refs = rows.select(F.col("row_index").alias("ref_id"), V.lenient_long(get(n, ids)).alias("item_id"), *(get(n, c).alias(f) for f, c in names.items()))
    kind = F.col("type")
    typed, free = refs.where(kind.isNotNull()), refs.where(kind.isNull())
    found = resolve_reference(typed, items, match_type=True).unionByName(resolve_reference(free, items))
    return rows.join(found.select(F.col("ref_id").alias("row_index"), F.col("item_id").alias(alias)), "row_index", "left")


def _told(rows: DataFrame, error: Column) -> DataFrame:
    """Maintenance rows with their outcome; those that had errors before keep them."""
    bad = F.coalesce(F.col("error_message"), error)
    return rows.withColumn("error_message", bad).withColumn("status", F.when(bad.isNotNull(), "error").otherwise("imported"))


def apply_search_terms(staged: DataFrame, terms: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms after the staged rows, rows with their outcome): a term is added to the item that its row names, unless the
    item has it in that type; its weight is kept within 1 and 500, 80 by default."""
    n = F.col("normalized")
    met = _resolved(staged, items, "item_", "_item").withColumn("_term", T.normalize(get(n, "term")))
    error = F.when(F.col("_item").isNull(), "item not found").when(F.coalesce("_term", F.lit("")) == "", "term is required")
    told = _told(met, error)
    weight = V.clamp(F.coalesce(V.lenient_long(get(n, "weight")), F.lit(80)), 1, 500).cast("int")
    kind = F.coalesce(get(n, "term_type"), F.lit("imported"))
    each = told.where("status = 'imported'").select("row_index", F.col("_item").alias("item_id"), F.col("_term").alias("term"), kind.alias("term_type"), weight.alias("weight"))
    keys = ["item_id", "term", "term_type"]
    first = each.groupBy(*keys).agg(F.min_by("weight", "row_index").alias("weight"))
    return terms.unionByName(first.join(terms.select(keys).distinct(), keys, "left_anti"), allowMissingColumns=True), told.drop("_item", "_term")


def apply_suggestions(staged: DataFrame, suggestions: DataFrame, relations: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suggestions after the staged rows, rows with their outcome): a pending edge between the items that a row names,
    unless it is pending or a relation already; confidence within 0 and 1, .8 by default."""
    n = F.col("normalized")
    met = _resolved(_resolved(staged, items, "source_", "source_id"), items, "target_", "target_id")
    error = F.when(F.col("source_id").isNull(), "source item not found").when(F.col("target_id").isNull(), "target item not found").when(F.col("source_id") == F.col("target_id"), "source and target are one item")
    told = _told(met, error)
    edge = ["source_id", "target_id", "relation_type"]
    confidence = V.clamp(F.coalesce(V.lenient_double(get(n, "confidence")), F.lit(0.8)), 0.0, 1.0)
    each = told.where("status = 'imported'").select("row_index", "source_id", "target_id", F.coalesce(get(n, "relation_type"), F.lit("related_to")).alias("relation_type"), confidence.alias("confidence"))
    first = each.groupBy(*edge).agg(F.min_by("confidence", "row_index").alias("confidence")).withColumn("status", F.lit("pending"))
    known = suggestions.where("status = 'pending'").select(edge).unionByName(relations.select(edge)).distinct()
    return suggestions.unionByName(first.join(known, edge, "left_anti"), allowMissingColumns=True), told.drop("source_id", "target_id")


def save_grid(rows: DataFrame, item_type: str, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with the grid's good rows, errors): ``rows(row_index, type, name, ...)`` of another type or without a name are
    errors (row_index, field_name, message), all others new items in row order."""
    wrong, unnamed = ~F.col("type").eqNullSafe(F.lit(item_type)), T.blank_to_null("name").isNull()
    error = F.when(wrong, F.struct(F.lit("item_type").alias("field_name"), F.lit("row is of another type").alias("message"))).when(
        unnamed, F.struct(F.lit("name").alias("field_name"), F.lit("name is required").alias("message"))
    )
    told = rows.withColumn("_error", error)
    top = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    good = numbered(told.where("_error is null"), "row_index").crossJoin(F.broadcast(top))  # top: one row
    made = good.select((F.col("top") + F.col("number")).alias("id"), *(c for c in rows.columns if c != "row_index"))
    return items.unionByName(made, allowMissingColumns=True), told.where("_error is not null").select("row_index", "_error.field_name", "_error.message")


# Fields that rows of the maintenance types need, alternatives together.
MAINTENANCE = {
    "standard_terms_v1": [["term_type"], ["standard_name"]],
    "search_terms_v1": [["term"], ["item_id", "item_code", "item_name"]],
    "relation_suggestions_v1": [["relation_type"], ["source_item_id", "source_code", "source_name"], ["target_item_id", "target_code", "target_name"]],
}


def maintenance_issues(record: Column, kind: str) -> Column:
    rules = [issue(get(record, *names).isNull(), "error", "required", names[0], f"{' or '.join(names)} is required") for names in MAINTENANCE.get(kind, [])]
    return F.filter(F.array(*rules), lambda i: i.isNotNull()) if rules else F.array().cast(f"array<{ISSUE}>")


def infer_intent(explicit: str | None, profile: str | None, detected_type: str, package_name: str | None = None) -> str:
    """The import's intent: as told, else by profile, package name and detected type."""
    if explicit is not None:
        return explicit
    if profile == "classics_curated_v1":
        return "classic_text"
    if profile == "pdf_herb_notes_private_v1" or "ni_notes" in (package_name or ""):
        return "annotation_enrichment"
    return "search_terms" if detected_type == "search_terms_v1" else "primary_seed"


def plan_action(name, content, existing_id, similar, same_source, intent, mergeable, policy) -> Column:
    """Struct (action, confidence) of an import row by the decision table; conditions are tried from the top."""
    similar, same_source, mergeable = (F.coalesce(c, F.lit(False)) for c in (similar, same_source, mergeable))
    table = [
        (T.blank_to_null(name).isNull(), "reject_invalid", 0.0),
        (T.blank_to_null(content).isNull(), "reject_invalid", 0.0),
        (existing_id.isNull(), "create_new", 0.92),
        ((intent == "annotation_enrichment") & similar, "skip_duplicate", 0.95),
        (intent == "annotation_enrichment", "attach_annotation", 0.90),
        ((intent == "classic_text") & (similar | same_source), "skip_duplicate", 0.95),
        (intent == "classic_text", "create_new", 0.90),
        (intent == "search_terms", "skip_duplicate", 0.80),
        (similar, "skip_duplicate", 0.95),
        (mergeable & (policy != "ask_on_conflict"), "merge_empty_fields", 0.82),
    ]
    out = F.struct(F.lit("needs_review").alias("action"), F.lit(0.55).alias("confidence"))
    for holds, action, confidence in reversed(table):
        out = F.when(holds, F.struct(F.lit(action).alias("action"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def default_policy(intent: str) -> str:
    return {"annotation_enrichment": "attach_annotation", "classic_text": "skip_existing", "search_terms": "skip_existing"}.get(intent, "auto")


ITEM_FIELDS = ["type", "code", "name", "alias", "pinyin", "category", "summary", "content", "source_note", "tags", "data_status"]


BROADCAST_CHARS = 10_000_000  # of the existing items that a plan sends to all tasks


def plan(drafts: DataFrame, items: DataFrame, intent: str, policy: str | None = None) -> DataFrame:
    """Drafts ``(row_index, type, name, content, source_note, ...)`` with existing_id, action and confidence.

    The existing item is one of equal type, name and source note, else of equal type and name, the least id.
    """
    near = items.groupBy("type", "name").agg(F.min("id").alias("by_name"))
    exact = items.groupBy("type", "name", "source_note").agg(F.min("id").alias("by_source"))
    found = drafts.join(exact, ["type", "name", "source_note"], "left").join(near, ["type", "name"], "left").withColumn("existing_id", F.coalesce("by_source", "by_name"))
    found = materialized(found.drop("by_source", "by_name"), "found")
    old = items.select(F.col("id").alias("existing_id"), F.col("content").alias("old_content"), F.col("source_note").alias("old_source"))
    asked = found.where("existing_id is not null").select("existing_id").distinct()
    old = materialized(old.join(asked, "existing_id", "left_semi"), "old")
    chars = old.agg(F.coalesce(F.sum(F.coalesce(F.length("old_content"), F.lit(0)) + F.coalesce(F.length("old_source"), F.lit(0)) + 100), F.lit(0))).first()[0]
    # many drafts may ask after one item: where the items asked after are few, none is shuffled by them
    both = found.join(F.broadcast(old) if chars <= BROADCAST_CHARS else old, "existing_id", "left")
    similar = T.content_similar("content", "old_content")
    same = T.blank_to_null("source_note") == T.blank_to_null("old_source")
    mergeable = T.blank_to_null("old_content").isNull() | T.blank_to_null("content").isNull() | (T.strip("content") == T.strip("old_content"))
    decided = V.let(similar, lambda s: plan_action(F.col("name"), F.col("content"), F.col("existing_id"), s, same, F.lit(intent), mergeable, F.lit(policy or default_policy(intent))))
    return both.withColumn("decided", decided).select(*drafts.columns, "existing_id", "decided.action", "decided.confidence")


def execute(planned: DataFrame, items: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items after the plan, annotations made, change log). New ids follow the largest one in row order.

    New rows are numbered within ranges of row_index whose sizes are summed first. The plan is computed once, and so are
    the new rows.
    """
    planned = materialized(planned, "planned")
    top = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = numbered(planned.where("action = 'create_new'"), "row_index").crossJoin(F.broadcast(top))  # top: one row
    made = new.select((F.col("top") + F.col("number")).alias("id"), *(F.col(c) for c in ITEM_FIELDS if c in planned.columns), "row_index")
    made = materialized(made, "made")
    fill = planned.where("action = 'merge_empty_fields'").groupBy(F.col("existing_id").alias("id")).agg(F.min_by(F.struct(*(c for c in ITEM_FIELDS if c in planned.columns)), "row_index").alias("new"))
    fields = [c for c in ITEM_FIELDS if c in planned.columns and c in items.columns and c not in ("type", "name")]
    after = items.join(fill, "id", "left").withColumns({c: F.coalesce(T.blank_to_null(c), F.col(f"new.{c}"), F.col(c)) for c in fields}).drop("new")
    notes = planned.where("action = 'attach_annotation'").select(F.col("existing_id").alias("item_id"), F.col("name").alias("source_title"), "source_note", "content", F.to_json(F.struct(*planned.columns)).alias("detail_json"), "row_index")
    log = made.select(F.lit(run_id).alias("run_id"), "row_index", F.lit("create_new").alias("action"), F.col("id").alias("entity_id"), F.lit("delete_created").alias("rollback_action"))
    log = log.unionByName(fill.select(F.lit(run_id).alias("run_id"), F.lit(None).cast("long").alias("row_index"), F.lit("merge_empty_fields").alias("action"), F.col("id").alias("entity_id"), F.lit("restore_fields").alias("rollback_action")))
    return after.unionByName(made.drop("row_index"), allowMissingColumns=True), notes, log


def rollback(before: DataFrame, after: DataFrame, log: DataFrame, now: DataFrame) -> DataFrame:
    """``now`` with a run undone: items it created go, merged ones get their old row, unless changed since the run."""
    cols = before.columns
    touched = log.select(F.col("entity_id").alias("id"), "rollback_action").distinct()
    same = reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"a.{c}")) for c in cols))
    unchanged = now.alias("n").join(after.select(cols).alias("a"), same, "left_semi").select("id")
    undo = touched.join(unchanged, "id")
    kept = now.join(undo.select("id"), "id", "left_anti")
    return kept.unionByName(before.join(undo.where("rollback_action = 'restore_fields'").select("id"), "id", "left_semi"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Rows with ``number`` from 1 by a numeric column, over two levels: ranges between quantiles, then within each.

    The bounds are fixed numbers in the plan, so the ranges' sizes and their rows agree however often they are computed.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile(order, [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: F.col(order) >= b)) if bounds else F.lit(0)
    dealt = rows.withColumn("_p", part)
    sizes = dealt.groupBy("_p").count().withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return dealt.join(F.broadcast(sizes), "_p").withColumn("number", F.col("_base") + within).drop("_p", "_base")  # sizes: a row a range
