"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.functions import udfs
from quernstone.functions import values as V
from quernstone.operators import curate, profile
from quernstone.plans.registry import query, table

LABELS = ["性味", "归经", "功效", "禁忌"]


@query(r"""
SELECT doc_id, md5(regexp_replace(lower(text), '\s+', '', 'g')) AS normalized, md5(translate(text, 'ＡＢ，', 'AB,')) AS half,
       md5(array_to_string(list_filter(list_transform(string_split_regex(text, '[,;|]'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> ''), ',')) AS joined,
       CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '...' ELSE text END AS shortened, substring(text, 1, 80) AS summary
FROM documents
""")
def normalize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.normalize("text")).alias("normalized"), F.md5(T.half_width("text")).alias("half"), F.md5(T.split_join("text")).alias("joined"), T.truncate("text", 60).alias("shortened"), T.summary_of("text").alias("summary"))


@query(r"""
WITH p AS (SELECT p_partkey, ' ' || lower(p_brand) || '-' || p_partkey AS raw, CASE WHEN p_partkey % 2 = 0 THEN 'ST' || p_size ELSE lower(p_type) || p_size END AS code, p_name FROM part)
SELECT p_partkey, upper(regexp_replace(lower(raw), '[^0-9a-z]', '', 'g')) AS code_key, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS pinyin_key,
       regexp_matches(code, '^[A-Z][A-Z0-9_-]*$') AS valid, regexp_matches(code, '^[A-Z]{2}[0-9]+$') AS valid_point FROM p
""")
def code_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit(" "), F.lower("p_brand"), F.lit("-"), "p_partkey")
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ST"), "p_size")).otherwise(F.concat(F.lower("p_type"), "p_size"))
    return p.select("p_partkey", T.code_key(raw).alias("code_key"), T.pinyin_key("p_name").alias("pinyin_key"), T.valid_code(code).alias("valid"), T.valid_acupoint_code(code).alias("valid_point"))


@query(r"""
WITH t AS (SELECT p_partkey, p_name || '; ' || p_brand || ',' || upper(p_name) AS a, nullif(p_type, 'PROMO') || '|' || lower(p_brand) AS b, p_name FROM part),
u AS (SELECT *, list_filter(list_transform(string_split_regex(a, '[,;|/]'), lambda x: trim(x)), lambda x: x <> '') AS pa, coalesce(list_filter(string_split_regex(b, '[,;|/]'), lambda x: x <> ''), []) AS pb FROM t),
v AS (SELECT p_partkey, list_concat(pa, pb) AS both_, a, p_name FROM u),
w AS (SELECT p_partkey, list_filter(both_, lambda x, i: list_position(list_transform(both_, lambda y: regexp_replace(lower(y), '\s', '', 'g')), regexp_replace(lower(x), '\s', '', 'g')) = i) AS firsts, a, p_name FROM v)
SELECT p_partkey, array_to_string(firsts, '，') AS tags,
       '|' || array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(a), '[,;|/ ]'), lambda x: x <> ''))), '|') || '|' AS aliases,
       contains('|' || array_to_string(list_distinct(list_filter(string_split_regex(lower(a), '[,;|/ ]'), lambda x: x <> '')), '|') || '|', '|' || replace(lower(p_name), ' ', '') || '|') AS has_name FROM w
""")
def tag_union(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = F.concat("p_name", F.lit("; "), "p_brand", F.lit(","), F.upper("p_name"))
    b = F.concat(F.expr("nullif(p_type, 'PROMO')"), F.lit("|"), F.lower("p_brand"))
    return p.select("p_partkey", T.merge_tags(a, b).alias("tags"), T.alias_key(a).alias("aliases"), T.alias_contains(a, F.col("p_name")).alias("has_name"))


@query(r"""
WITH c AS (SELECT doc_id, text, strpos(text, 'the') AS at_ FROM documents)
SELECT doc_id, CASE WHEN at_ = 0 THEN CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END
  ELSE CASE WHEN length(s) > 140 THEN substring(s, 1, 140) || '...' ELSE s END END AS snippet, md5(replace(text, 'the', '<mark>the</mark>')) AS marked
FROM (SELECT *, substring(text, greatest(at_ - 29, 1), at_ + 3 + 90 - greatest(at_ - 29, 1)) AS s FROM c)
""")
def snippets(spark, sf_dir):
    from quernstone.operators.search import snippet_or_start

    d = table(spark, sf_dir, "documents").withColumns({"summary": F.lit(None).cast("string"), "detail": F.lit(None).cast("string")})
    return d.select("doc_id", snippet_or_start("the", "text").alias("snippet"), F.md5(T.highlight("text", "the")).alias("marked"))


@query(r"""
SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' ')) AS text_md5,
       length(regexp_replace(html, '<[^>]*>?', '', 'g'))::BIGINT AS n_chars FROM pages
""")
def html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(T.unescape(T.strip_tags("html"))).alias("text_md5"), F.length(F.regexp_replace("html", "<[^>]*>?", "")).cast("long").alias("n_chars"))


@query(r"""
WITH u AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]+)</a>', 1) AS us FROM pages)
SELECT page_id, list_filter(us, lambda x, i: list_position(us, x) = i)[1:8] AS urls FROM u
""")
def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.transform(udfs.links("html"), lambda x: x["url"]).alias("urls"))


@query(r"""
SELECT page_id, url_encode(url) AS encoded, url_decode(url_encode(url)) = url AS back FROM pages
""")
def percent_codes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    e = T.percent_encode("url")
    return p.select("page_id", e.alias("encoded"), (T.percent_decode(e) == F.col("url")).alias("back"))


@query(r"""
WITH d AS (SELECT doc_id, source, lang, '【性味】味甘性温。【归经】归' || source || '。【功效】' || text || '【禁忌】无' AS t FROM documents)
SELECT doc_id, nullif(trim(regexp_extract(t, '【性味】([^【]*)', 1)), '') AS nature, md5(nullif(regexp_replace(regexp_replace(regexp_extract(t, '【功效】([^【]*)', 1), '^\s+', ''), '\s+$', ''), '')) AS effects,
       ['甘', '温'] AS terms, CASE WHEN lang = 'en' THEN 'Acupuncture' WHEN lang = 'de' THEN 'MedicineOrFormula' ELSE 'General' END AS intent,
       source || ' / ' || lang AS note FROM d
""")
def labelled_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.concat(F.lit("【性味】味甘性温。【归经】归"), "source", F.lit("。【功效】"), "text", F.lit("【禁忌】无"))
    nature = T.labelled_section(t, "性味", LABELS)
    question = F.when(F.col("lang") == "en", "足三里穴在哪").when(F.col("lang") == "de", "桂枝汤方组成").otherwise("什么")
    return d.select("doc_id", nature.alias("nature"), F.md5(T.labelled_section(t, "功效", LABELS)).alias("effects"), T.terms_in_order(nature, ["甘", "温", "寒"]).alias("terms"), T.intent(question).alias("intent"), T.source_note(F.col("source"), F.col("lang"), F.col("source"), F.lit(" ")).alias("note"))


@query()
def similarity(spark, sf_dir):
    """String similarities of all customer segments and part types met in the tables with nation names."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    both = c.join(n, c.c_nationkey == n.n_nationkey)
    a, b = F.lower("c_mktsegment"), F.lower("n_name")
    return both.select("c_mktsegment", "n_name", "n", F.round(T.overlap_similarity(a, b), 6).alias("overlap"), F.round(udfs.jaro(a, b), 6).alias("jaro"), F.round(udfs.jaro_winkler(a, b), 6).alias("jaro_winkler"))


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
m AS (SELECT doc_id, len(lines) AS n, len(list_filter(lines, lambda x: length(x) <= 3)) AS s, len(list_filter(range(1, len(lines)), lambda i: length(lines[i]) <= 6 AND (lines[i] = lines[i + 1] OR starts_with(regexp_replace(lines[i + 1], '\s+', '', 'g'), regexp_replace(lines[i], '\s+', '', 'g'))))) AS r FROM l)
SELECT doc_id, n::INT AS n_lines, s::INT AS n_short, round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 3)::DOUBLE AS short_ratio, 0::INT AS n_header, r::INT AS n_repeated, 0::INT AS n_layout, n >= 18 AND s / greatest(n, 1) >= 0.28 AS suspicious, r >= 2 AS noisy FROM m
""")
def line_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *(c.alias(k) for k, c in profile.line_metrics("text").items()))


@query()
def clean_lines(spark, sf_dir):
    """Documents without layout noise and repeated lines."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(udfs.clean_lines("text", F.col("source"))).alias("cleaned_md5"))


@query(r"""
SELECT doc_id, md5(text) AS kept FROM documents
""")
def header_removal(spark, sf_dir):
    """Layout lines put among the text's lines, and taken out again."""
    d = table(spark, sf_dir, "documents")
    noisy = F.concat(F.lit("校排\n觀\n"), F.replace("text", F.lit("\n"), F.lit("\n倪注金匮\n")), F.lit("\n【PDF页码12】"))
    return d.select("doc_id", F.md5(curate.without_headers(noisy)).alias("kept"))


@query(r"""
SELECT doc_id, '味甘性温' AS nature_flavor, 'section' AS nature_from, '温' AS four_qi, '甘' AS five_flavors, '脾经，肺经' AS channel_tropism, CASE WHEN doc_id % 2 = 0 THEN '小毒' END AS toxicity, source AS effects FROM documents
""")
def herb_properties(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    note = F.when(F.col("doc_id") % 2 == 0, "此药小毒。").otherwise("解毒。")
    t = F.concat(F.lit("【性味】 味甘性温，主补气。【主治】归肺脾经。"), note, F.lit("【功效】"), "source")
    p = curate.herb_properties(t)
    return d.select("doc_id", *(p[k].alias(k) for k in ("nature_flavor", "nature_from", "four_qi", "five_flavors", "channel_tropism", "toxicity", "effects")))


@query(r"""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '脾经' WHEN 1 THEN '肝经，肺经' WHEN 2 THEN '心包经，心经' WHEN 3 THEN '胃经' END AS channels,
  CASE doc_id % 2 WHEN 0 THEN '性' || repeat('长', 40) ELSE '性味' || repeat('长', 40) END AS nature FROM documents
""")
def herb_channels(spark, sf_dir):
    """Channels far behind the word that leads to them, and how far a phrase on nature reaches, within whole documents."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    told = F.when(k == 0, "此药归于足太阴之脾经").when(k == 1, "入手太阴与足厥阴肺肝二经").when(k == 2, "归手厥阴心包之脏").when(k == 3, "入胃").otherwise("归属不明。入口即化")
    nature = F.concat(F.when(F.col("doc_id") % 2 == 0, "性").otherwise("性味"), F.repeat(F.lit("长"), F.lit(50)))
    t = F.concat(F.lit("\n"), nature, F.lit("\n"), told, F.lit("\n"), F.translate("text", "归入性味", ""))
    p = curate.herb_properties(t)
    return d.select("doc_id", p["channel_tropism"].alias("channels"), p["nature_flavor"].alias("nature"))


@query(r"""
WITH q AS (SELECT c_custkey, (CASE c_nationkey % 5 WHEN 0 THEN '肝，胆' WHEN 1 THEN '心' WHEN 2 THEN '脾' WHEN 3 THEN '肺' ELSE NULL END) AS ch,
  CASE WHEN c_acctbal > 5000 THEN '微温' WHEN c_acctbal > 0 THEN '寒' ELSE '' END AS q, c_mktsegment AS seg FROM customer)
SELECT c_custkey, CASE WHEN ch IS NULL THEN NULL WHEN ch LIKE '%肝%' THEN 'wood' WHEN ch LIKE '%心%' THEN 'fire' WHEN ch LIKE '%脾%' THEN 'earth' ELSE 'metal' END AS element,
  CASE q WHEN '微温' THEN 'mild-warm' WHEN '寒' THEN 'cold' END AS nature,
  seg || CASE WHEN q <> '' THEN '，' || q || '性' ELSE '' END || CASE WHEN ch IS NULL THEN '' WHEN ch = '肝，胆' THEN '，归肝，归胆' ELSE '，归' || ch END AS tags FROM q
""")
def nature_rules(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_nationkey") % 5
    ch = F.when(k == 0, "肝，胆").when(k == 1, "心").when(k == 2, "脾").when(k == 3, "肺")
    q = F.when(F.col("c_acctbal") > 5000, "微温").when(F.col("c_acctbal") > 0, "寒").otherwise("")
    return c.select("c_custkey", curate.first_rule(ch, curate.ELEMENT_RULES).alias("element"), curate.first_rule(q, curate.NATURE_RULES).alias("nature"), curate.property_tags(F.col("c_mktsegment"), q, F.lit(""), ch).alias("tags"))


@query(r"""
WITH f AS (SELECT o_orderkey, o_orderkey % 3 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN '桂枝 : 芍药 = 3 : 2.5；大枣十二枚另计。' WHEN 1 THEN NULL ELSE '麻黄 : 杏仁 = 11 : 20' END AS ratio,
       CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::INT AS n_entries FROM f
""")
def formula_ratio(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "桂枝三两 芍药二半两 大枣十二枚").when(k == 1, "甘草一两").otherwise("麻黄十一两，杏仁二十两")
    return o.select("o_orderkey", udfs.ratio(text).alias("ratio"), F.size(udfs.composition(text)).alias("n_entries"))


@query(r"""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN '半' WHEN 1 THEN '十' WHEN 2 THEN '十二' WHEN 3 THEN '三十' WHEN 4 THEN '二半' WHEN 5 THEN '三百' ELSE '七' END AS t, l_quantity, l_extendedprice FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE t WHEN '半' THEN 0.5 WHEN '十' THEN 10 WHEN '十二' THEN 12 WHEN '三十' THEN 30 WHEN '二半' THEN 2.5 WHEN '三百' THEN NULL ELSE 7 END::DOUBLE AS n,
       trunc(l_extendedprice)::BIGINT AS whole, greatest(1, least(l_quantity, 20))::DOUBLE AS clamped FROM v
""")
def numbers(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber") % 7
    t = F.element_at(F.array(*map(F.lit, ["半", "十", "十二", "三十", "二半", "三百", "七"])), (k + 1).cast("int"))
    return r.select("l_orderkey", "l_linenumber", V.chinese_number(t).alias("n"), V.lenient_long(F.format_string("  %.2f ", "l_extendedprice")).alias("whole"), V.clamp("l_quantity", 1.0, 20.0).alias("clamped"))


@query(r"""
SELECT doc_id, md5(regexp_replace(text, 'the[。；;，,]?', '', 'g')) AS gone FROM documents
""")
def literal_removal(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.regexp_replace("text", "the[。；;，,]?", "")).alias("gone"))


@query()
def formula_names(spark, sf_dir):
    """Formula-like names in texts, by the fold over their characters, and the texts' hashes."""
    d = table(spark, sf_dir, "documents")
    t = F.concat("text", F.lit("用桂枝汤、麻黄汤和小青龙汤。桂枝汤"))
    return d.select("doc_id", udfs.formula_names(t).alias("names"), udfs.fnv("text").alias("fnv"))
