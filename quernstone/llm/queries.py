"""The registered queries of the ``llm`` operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quernstone.llm import backoff, cotrain, curriculum, flatgraph, hilbert, notices, postings, secrets, simhash, surrogates, variants, wavelet, whitening
from quernstone.llm.common import shared_folder, table
from quernstone.llm.wavelet import vocabulary

#: The key of the registered query where the session sets none. It is no secret; ``pseudonymize`` itself has no default.
REGISTERED_KEY = "public key of the registered query"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, written as wavelet shards and read back."""
    return wavelet.token_output(table(spark, sf_dir, "documents"), vocabulary(), shared_folder(spark, "wavelet"))


@query
def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark contamination of every document."""
    found = postings.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL["op9_decontamination"] = r"""
WITH words AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: ws[i:i + 12])) AS win FROM items WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM words, sizes WHERE len(ws) >= n),
hits AS (SELECT rid, i, n, item_id FROM (SELECT rid, i, n, ws[i:i + n - 1] AS win FROM places) JOIN windows USING (win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""


@query
def op9_exact_and_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches of the benchmark in every document: the columns of ``op9_decontamination``, which its
    SQL fixes, and the items near."""
    found = postings.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=postings.SLOP)
    return found.drop("hits")


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return notices.scan_notices(table(spark, sf_dir, "documents")).drop("spans")


@query
def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in the mix and its training position."""
    mixed = curriculum.in_order(curriculum.plan(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op2_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document, by models co-trained on ``labels``."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return cotrain.classify(documents, labels, targets=("quality", "toxic"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline, stage after stage."""
    return corpus_pipeline.run(spark, sf_dir)


@query
def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others of every twentieth vector."""
    return hilbert.nearest(table(spark, sf_dir, "embeddings"))


@query
def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff score of every document against the rest of the corpus."""
    return backoff.score(table(spark, sf_dir, "documents"))


@query
def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, under the session's key where it has one."""
    key = spark.conf.get("quernstone.surrogate.key", REGISTERED_KEY)
    return surrogates.pseudonymize(table(spark, sf_dir, "documents"), key.encode())


@query
def op11_characteristic_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight first whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


@query
def op12_flat_graph_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of at least 0.9."""
    return flatgraph.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words, form and root."""
    return variants.group_variants(table(spark, sf_dir, "documents"))


# crc32 is told byte by byte over a table made by its rule; words are near by the wildcard patterns of one letter
ORACLE_SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(0, 256))::BIGINT AS i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS told, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY 1, 2),
bytes AS (SELECT run, c, flatten(list_transform(list_transform(range(1, length(told) + 1), lambda i: unicode(told[i])::BIGINT), lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 | (u >> 6), 128 | (u & 63)] END)) AS bs FROM counted),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, word[1:i - 1] AS head, word[i + 1:] AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.head || a.tail = b.word),
ranked AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near),
formed AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND r = 1),
way AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT y.word, y.next, f.form FROM way y JOIN formed f ON f.word = y.next)
SELECT f.word, n, n_near, form, form_n, root FROM formed f JOIN way y ON y.word = f.word AND y.next IS NULL
"""
