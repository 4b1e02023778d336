"""Many questions at once, pages at depth, commentary out of broken lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators import answers, curate, search
from quernstone.operators import store as st
from quernstone.operators.pages import Key, OrderedList
from quernstone.plans.carriers import table, text_index
from quernstone.plans.registry import query
from quernstone.plans.search_queries import ITEMS_SQL, document_items

TOKENS_SQL = r"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda t: t <> '')"


@query(r"""
WITH tok AS (SELECT doc_id, """ + TOKENS_SQL.format(c="text") + r""" AS toks FROM documents), b AS (SELECT item_id, """ + TOKENS_SQL.format(c="text") + r""" AS toks FROM benchmark),
whole AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tok),
pairs AS (SELECT doc_id, toks[i] AS a, toks[i + 1] AS b, count(*) AS f FROM (SELECT doc_id, toks, unnest(range(1, len(toks))) AS i FROM tok) GROUP BY 1, 2, 3),
words AS (SELECT doc_id, w, count(*) AS f FROM (SELECT doc_id, unnest(toks) AS w FROM tok) GROUP BY 1, 2),
hits AS (SELECT 2 * item_id AS query_id, doc_id, f FROM b JOIN pairs ON a = b.toks[1] AND pairs.b = b.toks[2]
  UNION ALL SELECT 2 * item_id + 1, doc_id, sum(f) FROM b JOIN words ON starts_with(w, b.toks[3]) WHERE regexp_full_match(b.toks[3], '[a-z0-9]+') GROUP BY 1, 2),
k AS (SELECT query_id, count(*) AS k FROM hits GROUP BY 1),
s AS (SELECT query_id, doc_id, round(-(CASE WHEN ln((n - k + 0.5) / (k + 0.5)) > 0 THEN ln((n - k + 0.5) / (k + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks) / avgdl)), 9) AS bm25
  FROM hits JOIN k USING (query_id) JOIN tok USING (doc_id), whole)
SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, doc_id) AS place FROM s) WHERE place <= 20
""")
def many_searches(spark, sf_dir):
    """BM25 for two queries of each benchmark item: its first two words as a phrase, its third as a beginning."""
    words = table(spark, sf_dir, "benchmark").select("item_id", search.tokens("text").alias("w"))
    phrase = words.where(F.size("w") > 1).select((2 * F.col("item_id")).alias("query_id"), F.concat(F.get("w", F.lit(0)), F.lit(" "), F.get("w", F.lit(1))).alias("query"))
    start = F.get("w", F.lit(2))
    begin = words.where(start.rlike("^[a-z0-9]+$")).select((2 * F.col("item_id") + 1).alias("query_id"), start.alias("query"))
    found = text_index(spark, sf_dir).bm25_of(phrase.unionByName(begin), 20)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


#: Two words of a benchmark item, of four letters and more, asked as one question.
ASKED_SQL = "asked AS (SELECT item_id AS question_id, list_distinct([w[1], w[2]]) AS terms, w[1] AS t1, w[2] AS t2 FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM benchmark) WHERE len(w) > 1)"


def asked(spark, sf_dir):
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)
    words = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).where(F.size("w") > 1)
    question = F.concat(F.lit("请问"), F.get("w", F.lit(0)), F.lit("，"), F.get("w", F.lit(1)), F.lit("怎么治？"))
    return words.select(F.col("item_id").alias("question_id"), question.alias("question"))


@query("WITH " + ITEMS_SQL + ", " + ASKED_SQL + """,
h AS (SELECT question_id, id, type, CASE WHEN contains(lower(content), t1) THEN 0 ELSE 1 END AS seq FROM asked JOIN items ON (contains(lower(content), t1) OR contains(lower(content), t2)) AND type <> 'acupoint')
SELECT question_id, id, seq::INT AS seq, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY type = 'formula' DESC, seq, id) AS place FROM h) WHERE place <= 24
""")
def many_contexts(spark, sf_dir):
    """The context of a question for each benchmark item, all in one plan."""
    return answers.context_items_of(document_items(spark, sf_dir), asked(spark, sf_dir))


@query("WITH " + ITEMS_SQL + ", " + ASKED_SQL + """,
t AS (SELECT question_id, unnest(terms) AS term FROM asked),
s AS (SELECT question_id, id, 90 AS score FROM t JOIN items ON type = 'formula' AND contains(lower(content), term)
  UNION ALL SELECT question_id, i.id, 90 FROM t JOIN conversations c ON contains(lower(c.text), term) JOIN items i ON i.id = c.conv_id AND i.type = 'formula'
  UNION ALL SELECT question_id, id, 200 FROM asked JOIN items ON id = question_id AND type = 'formula')
SELECT question_id, id AS item_id, sum(score)::BIGINT AS score FROM s GROUP BY 1, 2
""")
def many_candidates(spark, sf_dir):
    """Formula candidates of a question for each benchmark item, with a related item, all in one plan."""
    notes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("text").alias("content"))
    return answers.formula_scores_of(document_items(spark, sf_dir), notes, asked(spark, sf_dir).withColumn("related_id", F.col("question_id")))


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS rn FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, (rn // 50 + 1)::INT AS page FROM o WHERE rn // 50 + 1 IN (1, 4, 5, 7)
""")
def deep_pages(spark, sf_dir):
    """Pages of the finished orders, latest first, from the runs that hold them; the fifth by the last row of the fourth."""
    pages = OrderedList(st.Store(spark, st.shared_folder(spark, "pages")), "orders", [Key("o_orderdate", True), Key("o_orderkey", True)], ["o_orderstatus"])
    pages.build(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), range_rows=2_000)
    fourth = pages.page(4, 50, o_orderstatus="F")
    last = fourth.orderBy("o_orderdate", "o_orderkey").first().asDict()
    told = {1: pages.page(1, 50, o_orderstatus="F"), 4: fourth, 5: pages.after(last, 50, o_orderstatus="F"), 7: pages.page(7, 50, o_orderstatus="F")}
    out = [df.select("o_orderkey", F.lit(n).alias("page")) for n, df in told.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS first FROM documents),
l AS (SELECT doc_id, first, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(replace(x, ' ', ''), '([,，。；;:：]){2,}', '\1', 'g')) AS lines FROM d),
j AS (SELECT doc_id, first, array_to_string(lines, '') AS whole FROM l),
r AS (SELECT doc_id, replace(replace(whole, first, ''), regexp_replace(first, '\s+', '', 'g'), '') AS rest FROM j),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(rest, '^[0-9]+[:：]', ''), '[,，。；;:：]{2,}', '。', 'g'), '([。；])', '\1' || chr(10), 'g') AS cut FROM r)
SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(cut, chr(10)), lambda x: trim(x, ' ，,；;')), lambda x: x <> ''), chr(10))) AS told FROM c
""")
def commentaries(spark, sf_dir):
    """Commentaries out of the documents' lines, a running title planted downwards and in line, the first line their original."""
    d = table(spark, sf_dir, "documents")
    title = curate.TITLES[0]
    planted = F.concat(F.lit("\n".join(title) + f"\n{title}十二：\n"), F.col("text"))
    return d.select("doc_id", F.md5(curate.commentary(planted, F.get(F.split("text", "\n"), F.lit(0)))).alias("told"))


@query(r"""
SELECT p_partkey, p_name || '，' || p_type || '，联系脏腑：' || coalesce(nullif(o, ''), '任督脉系统') || '。' AS summary,
  p_name || '，国际代码 ' || p_brand || '，类别：' || p_type || '。阴阳属性：' || coalesce(nullif(o, ''), '未单列') || '；手足属性：' || p_brand || '。' ||
  CASE WHEN o <> '' THEN '传统经络归属联系：' || o || '。表里经：' || o || '。' ELSE '传统经络归属需结合任督脉理论学习。' END AS content
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS o FROM part)
""")
def channel_descriptions(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("o", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")))
    return p.select("p_partkey", curate.channel_description("p_name", "p_brand", "p_type", "o", "p_brand", "o", "o").alias("d")).select("p_partkey", "d.*")


@query(r"""
WITH f AS (SELECT doc_id, source, lang FROM documents WHERE lang = 'en'),
n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations),
a AS (SELECT conv_id, list(CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END ORDER BY place) FILTER (place <= 4) AS snippets,
  list(role ORDER BY place) AS roles FROM n WHERE place <= 8 GROUP BY 1),
s AS (SELECT doc_id, source, coalesce(snippets, []) AS snippets, list_concat([lang], list_filter(coalesce(roles, []), lambda x, i: list_position(roles, x) = i)) AS titles FROM f LEFT JOIN a ON conv_id = doc_id)
SELECT doc_id AS item_id, '桂枝，' || source AS composition, md5(array_to_string(snippets, '|')) AS snippets,
  '方剂：' || source || chr(10) || chr(10) || '本地资料原方组成：' || chr(10) || '* 桂枝' || chr(10) || '* ' || source || chr(10) || chr(10) || '原文煎服法：' || chr(10) || '水煮' || chr(10) || chr(10)
  || '资料依据：' || chr(10) || array_to_string(list_transform(titles, lambda t: '* ' || t), chr(10)) || chr(10) || '---' AS block FROM s
""")
def formula_cards(spark, sf_dir):
    """Cards with snippets and sources out of the conversations, and their blocks in an answer."""
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents")
    items = d.select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "formula").alias("type"), F.col("source").alias("name"), F.col("lang").alias("category"), none.alias("summary"),
        F.concat(F.lit("组成：桂枝，"), "source", F.lit("。煎法 水煮\n"), "text").alias("content"), none.alias("source_note"), none.alias("source_package"), none.alias("detail"),
    )
    notes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), F.col("role").alias("source_title"), none.alias("source_note"), F.col("text").alias("content"))
    cards = answers.formula_cards(items, notes)
    return cards.select("item_id", "composition", F.md5(F.array_join("annotation_snippets", "|")).alias("snippets"), answers.card_text().alias("block"))


@query(r"""
SELECT event_id, '{' || array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN '"annotation":"' || event_type || '"' END, '"classic_id":' || user_id, CASE WHEN event_id % 3 = 0 THEN '"volume":["a",1]' END], lambda x: x IS NOT NULL), ',') || '}' AS notes FROM events
""")
def composed_notes(spark, sf_dir):
    """Fields of the detail that say where it stands, kept with their values in the notes."""
    from quernstone.operators import imports

    e = table(spark, sf_dir, "events")
    detail = F.to_json(F.struct(F.col("user_id").alias("Classic-ID"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("annotation")))
    rows = e.select("event_id", detail.alias("d"))
    rows = rows.withColumn("d", F.when(F.col("event_id") % 3 == 0, F.concat(F.substr("d", F.lit(1), F.length("d") - 1), F.lit(',"volume":["a",1]}'))).otherwise(F.col("d")))
    record = F.create_map(F.lit("name"), F.lit("n"), F.lit("detail"), F.col("d"))
    return rows.select("event_id", F.try_element_at(imports.lift_detail(record), F.lit("notes")).alias("notes"))


@query(r"""
SELECT (SELECT count(*) FROM part)::BIGINT AS n_rows, (SELECT count(*) FROM part WHERE p_size > 10)::BIGINT AS n_inserted, (SELECT count(*) FROM part WHERE p_size <= 10)::BIGINT AS n_left_out,
  (SELECT list(t || ':' || n ORDER BY t) FROM (SELECT CASE WHEN p_type = 'PROMO' THEN 'unknown' ELSE p_type END AS t, count(*) AS n FROM part GROUP BY 1)) AS types,
  (SELECT count(*) FROM part WHERE p_size % 7 > 0) * 1.0 / (SELECT count(*) FROM part) AS source_coverage
""")
def import_report(spark, sf_dir):
    """The report of a staged import: quality, types, and what it changed."""
    from quernstone.operators import imports, profile, resolve
    from quernstone.plans.evidence_queries import record_of

    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_type") != "PROMO", F.col("p_type"))
    record = record_of(type=kind, name=F.col("p_name"), source_note=F.when(F.col("p_size") % 7 > 0, F.col("p_brand")))
    staged = imports.stage(p.select(F.col("p_partkey").alias("row_index"), record.alias("record")))
    mark = resolve.import_fingerprint(*(F.try_element_at("record", F.lit(k)) for k in ("type", "code", "name", "source_note")))
    report = profile.import_report(staged, mark, p.where("p_size > 10").select("p_partkey"))
    types = F.transform("types", lambda t: F.concat(t["type"], F.lit(":"), t["n"]))
    return report.select("n_rows", "n_inserted", "n_left_out", types.alias("types"), "source_coverage")
