"""Joins over the relation graph, entity resolution and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import relations, resolve
from quernstone.plans.registry import query, table

EDGES_SQL = "edges AS (SELECT DISTINCT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS relation_type FROM lineitem)"


def edges(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem")
    return r.select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relation_type")).distinct()


@query("WITH " + EDGES_SQL + """
SELECT item_id, relation_type, count(*)::BIGINT AS n FROM (SELECT source_id AS item_id, relation_type FROM edges UNION ALL SELECT target_id, relation_type FROM edges) GROUP BY 1, 2
""")
def degree_cache(spark, sf_dir):
    return relations.degrees(edges(spark, sf_dir))


@query("WITH " + EDGES_SQL + """, d AS (SELECT item_id, count(*) AS n FROM (SELECT source_id AS item_id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1)
SELECT p_partkey, p_name, coalesce(n, 0)::BIGINT AS relation_count FROM part LEFT JOIN d ON item_id = p_partkey
""")
def listing_degrees(spark, sf_dir):
    total = relations.degrees(edges(spark, sf_dir)).groupBy("item_id").agg(F.sum("n").alias("relation_count"))
    p = table(spark, sf_dir, "part")
    return p.join(total, p.p_partkey == total.item_id, "left").select("p_partkey", "p_name", F.coalesce("relation_count", F.lit(0)).alias("relation_count"))


@query("WITH " + EDGES_SQL + """
SELECT target_id AS id, relation_type, 'outgoing' AS direction, s_name FROM edges JOIN supplier ON s_suppkey = target_id WHERE source_id = 17
UNION ALL SELECT source_id, relation_type, 'incoming', s_name FROM edges JOIN supplier ON s_suppkey = source_id WHERE target_id = 17 AND source_id <> 17
""")
def neighbourhood(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return relations.neighbours(edges(spark, sf_dir), s, 17)


@query("""
SELECT o_orderkey, c.c_name AS customer, n.n_name AS nation, r.r_name AS region, coalesce(c.c_mktsegment, n.n_name, 'none') AS label
FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey AND c.c_acctbal > 0 LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
""")
def role_playing_left(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.select("o_orderkey", F.col("c_name").alias("customer"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("c_mktsegment", "n_name", F.lit("none")).alias("label"))


@query("""
WITH k AS (SELECT doc_id, lang, regexp_replace(lower(text), '\\s+', '', 'g') AS norm FROM documents),
g AS (SELECT lang, norm, min(doc_id) AS item_id FROM k WHERE norm <> '' GROUP BY 1, 2 HAVING count(*) > 1)
SELECT DISTINCT g.item_id, k.doc_id AS duplicate_id, 'type_name_exact' AS match_type, 0.98::DOUBLE AS score FROM k JOIN g USING (lang, norm) WHERE k.doc_id <> g.item_id
""")
def dup_exact_pairs(spark, sf_dir):
    """Documents of equal normalized text and language, each linked to the first of its group."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), T.normalize("text").alias("name_norm")).withColumn("name_norm", F.when(F.col("name_norm") != "", F.md5("name_norm")))
    return resolve.star(rows, ["type", "name_norm"], "type_name_exact")


@query("""
WITH i AS (SELECT p_partkey AS id, p_type AS type, replace(lower(p_name), ' ', '') AS name, string_split(lower(CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) || split_part(p_name, ' ', 1) || ';' || replace(p_name, ' ', '') ELSE p_brand END), ';') AS al FROM part),
t AS (SELECT type, name AS token, id, true AS is_name FROM i UNION ALL SELECT DISTINCT type, unnest(al), id, false FROM i),
s AS (SELECT type, token, min(id) FILTER (is_name) AS fn, min(id) FILTER (NOT is_name) AS fa FROM t GROUP BY 1, 2 HAVING fn IS NOT NULL AND fa IS NOT NULL)
SELECT DISTINCT least(id, CASE WHEN is_name THEN fa ELSE fn END) AS item_id, greatest(id, CASE WHEN is_name THEN fa ELSE fn END) AS duplicate_id, 'name_alias_match' AS match_type, 0.9::DOUBLE AS score
FROM t JOIN s USING (type, token) WHERE id <> CASE WHEN is_name THEN fa ELSE fn END
""")
def dup_alias_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    alias = F.when(F.col("p_partkey") % 3 == 0, F.concat(words[1], words[0], F.lit(";"), F.replace("p_name", F.lit(" "), F.lit("")))).otherwise(F.col("p_brand"))
    none = F.lit(None).cast("string")
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), alias.alias("alias"), none.alias("code"), none.alias("pinyin"), none.alias("category"))
    return resolve.alias_links(resolve.keyed(items))


@query("SELECT md5(text) AS text_md5, lang, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    from quernstone.operators.profile import repeated

    d = table(spark, sf_dir, "documents")
    return repeated(d.select(F.md5("text").alias("text_md5"), "lang"), ["text_md5", "lang"])


@query("""
WITH i AS (SELECT p_partkey AS id, p_type AS type, replace(lower(p_name), ' ', '') AS name, 'P' || p_partkey AS code FROM part),
r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_linenumber % 2 = 0 THEN 'ECONOMY' ELSE 'SMALL' END AS type, 'P' || l_partkey AS code, 'redbolt' AS name FROM lineitem)
SELECT row_id, min(id) AS item_id, 'type_code_exact' AS match_type, 1.0::DOUBLE AS score FROM r JOIN i USING (type, code) GROUP BY 1
UNION ALL SELECT row_id, min(id), 'type_name_exact', 0.98 FROM r JOIN (SELECT type, name, min(id) AS id FROM i GROUP BY 1, 2) USING (type, name) GROUP BY 1
UNION ALL SELECT row_id, min(id), 'fingerprint_match', 0.95 FROM r JOIN i USING (type, code) GROUP BY 1
""")
def row_item_candidates(spark, sf_dir):
    p, r = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")
    rest = [none.alias("alias"), none.alias("pinyin"), none.alias("category")]
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.concat(F.lit("P"), "p_partkey").alias("code"), F.col("p_name").alias("name"), *rest)
    rows = r.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "ECONOMY").otherwise("SMALL").alias("type"), F.concat(F.lit("p-"), "l_partkey").alias("code"), F.lit("Red Bolt").alias("name"), *rest)
    # a type, name or code may be met by the fixture rows of one line more than once
    links, _ = resolve.row_candidates(rows, items)
    return links.groupBy("row_id", "match_type", "score").agg(F.min("class_id").alias("item_id")).select("row_id", "item_id", "match_type", "score")


MERGE_SQL = "t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ' ' WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS tags, c_name AS name FROM customer), s AS (SELECT o_custkey, max(o_orderpriority) AS tags, 'Order ' || max(o_orderkey) AS name FROM orders GROUP BY 1)"


def merge_carriers(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = F.col("c_custkey") % 4
    t = c.select("c_custkey", F.when(k == 0, " ").when(k == 1, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("t_tags"), F.col("c_name").alias("t_name"))
    s = o.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("s_tags"), F.concat(F.lit("Order "), F.max("o_orderkey")).alias("s_name"))
    both = t.join(s, t.c_custkey == s.o_custkey)
    return both, {"tags": F.col("t_tags"), "name": F.col("t_name")}, {"tags": F.col("s_tags"), "name": F.col("s_name")}


@query("WITH " + MERGE_SQL + " SELECT c_custkey, coalesce(nullif(trim(t.tags), ''), s.tags, t.tags) AS tags, t.name FROM t JOIN s ON c_custkey = o_custkey")
def merge_fill_empty(spark, sf_dir):
    both, t, s = merge_carriers(spark, sf_dir)
    return both.select("c_custkey", *(c.alias(k) for k, c in resolve.merged("fill_empty", t, s).items()))


@query("WITH " + MERGE_SQL + " SELECT c_custkey, coalesce(s.tags, t.tags) AS tags, coalesce(s.name, t.name) AS name FROM t JOIN s ON c_custkey = o_custkey")
def merge_overwrite(spark, sf_dir):
    both, t, s = merge_carriers(spark, sf_dir)
    return both.select("c_custkey", *(c.alias(k) for k, c in resolve.merged("overwrite", t, s).items()))


@query("WITH " + MERGE_SQL + " SELECT c_custkey, CASE WHEN coalesce(trim(t.tags), '') = '' THEN s.tags ELSE t.tags || '，' || s.tags END AS tags, t.name FROM t JOIN s ON c_custkey = o_custkey")
def merge_tags(spark, sf_dir):
    both, t, s = merge_carriers(spark, sf_dir)
    return both.select("c_custkey", *(c.alias(k) for k, c in resolve.merged("merge_tags", t, s).items()))


@query("""
SELECT d.doc_id AS source_id, b.item_id AS target_id FROM documents d JOIN benchmark b
ON contains(regexp_replace(lower(d.text), '\\s+', '', 'g'), regexp_replace(lower(b.text), '\\s+', '', 'g'))
""")
def mention_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target_id"), T.normalize("text").alias("needle")).where("needle != ''")
    return relations.mentions(d, b)


@query("""
WITH n AS (SELECT DISTINCT doc_id AS target_id, regexp_replace(lower(substring(text, 1 + doc_id % 40, 3 + doc_id % 30)), '\\s+', '', 'g') AS needle FROM documents WHERE doc_id % 3 = 0)
SELECT d.doc_id AS source_id, n.target_id FROM documents d JOIN n ON needle <> '' AND contains(regexp_replace(lower(d.text), '\\s+', '', 'g'), needle)
""")
def mentions_by_grams(spark, sf_dir):
    """Mentions of as many needles as texts, by their rarest grams: needles stay on the executors."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    part = F.substring("text", 1 + F.col("id") % 40, 3 + F.col("id") % 30)
    wanted = d.where("id % 3 = 0").select(F.col("id").alias("target_id"), T.normalize(part).alias("needle")).where("needle != ''")
    return relations.mentions(d, wanted, needle_bytes=0)


@query("""
WITH items AS (SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'disease' WHEN 'SMALL' THEN 'formula' ELSE 'herb' END AS type, split_part(p_name, ' ', 1) || p_size AS name, p_name || split_part(p_name, ' ', 1) || ((p_size * 7) % 50 + 1) AS txt FROM part)
SELECT s.id AS source_id, t.id AS target_id, CASE s.type WHEN 'formula' THEN 'contains_herb' ELSE 'mentions_formula' END AS relation_type, CASE s.type WHEN 'formula' THEN 0.86 ELSE 0.72 END::DOUBLE AS confidence
FROM items s JOIN items t ON contains(replace(lower(s.txt), ' ', ''), lower(t.name)) AND s.id <> t.id AND ((s.type = 'formula' AND t.type = 'herb') OR (s.type = 'disease' AND t.type = 'formula'))
""")
def relation_suggestions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", "disease").when(F.col("p_type") == "SMALL", "formula").otherwise("herb")
    first = F.split("p_name", " ")[0]
    none = F.lit(None).cast("string")
    items = p.select(
        F.col("p_partkey").alias("id"), kind.alias("type"), none.alias("code"), F.concat(first, "p_size").alias("name"), none.alias("alias"), none.alias("category"),
        F.concat("p_name", first, ((F.col("p_size") * 7) % 50 + 1)).alias("text"), F.lit(None).cast("long").alias("meridian_id"),
    )
    return relations.suggest(items)


@query("""
WITH f AS (SELECT DISTINCT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS relation_type FROM lineitem WHERE l_linenumber <= 3),
p AS (SELECT DISTINCT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS relation_type FROM lineitem WHERE l_linenumber = 4),
a AS (SELECT DISTINCT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS relation_type FROM lineitem WHERE l_linenumber >= 5)
SELECT * FROM f EXCEPT SELECT * FROM p EXCEPT SELECT * FROM a
""")
def relation_dedup(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem")
    e = r.select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relation_type"), "l_linenumber")
    return relations.new_suggestions(e.where("l_linenumber <= 3").drop("l_linenumber"), e.where("l_linenumber = 4"), e.where("l_linenumber >= 5"))


@query("""
WITH r AS (SELECT c_custkey AS ref_id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS item_id, CASE WHEN c_custkey % 3 = 1 THEN 'N' || c_nationkey END AS code, CASE WHEN c_custkey % 3 = 2 THEN 'NATION_' || c_nationkey END AS name FROM customer),
i AS (SELECT n_nationkey AS id, 'N' || n_nationkey AS code, n_name AS name FROM nation),
h AS (SELECT ref_id, i.id, 0 AS p FROM r JOIN i ON r.item_id = i.id UNION ALL SELECT ref_id, i.id, 1 FROM r JOIN i ON r.code = i.code UNION ALL SELECT ref_id, i.id, 1 FROM r JOIN i ON r.name = i.name)
SELECT ref_id, id AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY p, id DESC) AS rn FROM h) WHERE rn = 1
""")
def resolve_lookup(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey") % 3
    refs = c.select(F.col("c_custkey").alias("ref_id"), F.when(k == 0, F.col("c_nationkey")).alias("item_id"), F.when(k == 1, F.concat(F.lit("N"), "c_nationkey")).alias("code"), F.when(k == 2, F.concat(F.lit("NATION_"), "c_nationkey")).alias("name"))
    items = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return resolve.resolve_reference(refs, items)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'n' || c_nationkey || 'x' END AS standard_name FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def standard_terms(spark, sf_dir):
    from quernstone.operators.imports import standardize

    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    token = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("NAT"), "c_nationkey")).otherwise(F.concat(F.lit("n"), "c_nationkey", F.lit("x")))
    terms = n.select(F.lit("nation").alias("term_type"), F.col("n_name").alias("standard_name"), F.concat(F.lit("nat"), "n_nationkey", F.lit("，Land "), "n_nationkey").alias("aliases"), F.lit(None).cast("string").alias("code"))
    rows = c.select("c_custkey", token.alias("token"))
    return rows.join(standardize(rows.select("token").distinct(), terms, "nation"), "token").select("c_custkey", "standard_name")
