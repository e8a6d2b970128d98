"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import debruijn, decontaminate, divergence, html_text, jaccard_join, langid, lexical, packing, pii, quality, secrets, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The public tokenizer of the packing contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(_table(spark, sf_dir, "pages"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(_table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(_table(spark, sf_dir, "documents"))


def op10_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.report(_table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii, "op2_secrets": op2_secrets, "op3_decontaminate": op3_decontaminate, "op4_langid": op4_langid, "op5_toxicity": op5_toxicity, "op6_packing": op6_packing, "op7_html_text": op7_html_text, "op8_topk": op8_topk, "op9_jaccard_join": op9_jaccard_join, "op10_debruijn": op10_debruijn, "op11_quality": op11_quality, "op12_lexical": op12_lexical, "op13_divergence": op13_divergence}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TOKEN = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_decontaminate": f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
doc AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WORD}'), []) AS w FROM documents),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, size WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, p, x.n, item FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS words FROM place) x JOIN win ON win.n = x.n AND win.words = x.words),
word AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op9_jaccard_join": f"""
WITH RECURSIVE word AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_TOKEN}'), []) AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM word),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
""",
    "op10_debruijn": f"""
WITH word AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_TOKEN}'), []) AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM word WHERE len(w) >= 13)),
first AS (SELECT s, min(doc_id) AS source FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM win JOIN first USING (s) WHERE source < doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM word),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM word LEFT JOIN kept USING (doc_id)
""",
    "op12_lexical": f"""
WITH word AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS t FROM documents),
size AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM word GROUP BY r),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS t FROM benchmark),
post AS (SELECT r, t, count(*) AS tf FROM word WHERE t IN (SELECT t FROM item) GROUP BY r, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, total GROUP BY t, n_docs),
part AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS x FROM post JOIN size USING (r) JOIN weight USING (t), total),
score AS (SELECT item_id, r, CAST(sum(x) AS BIGINT) AS score FROM item JOIN part USING (t) GROUP BY item_id, r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score JOIN size USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op13_divergence": f"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(regexp_extract_all({_LOWER}, '{_LETTERS}'), []) AS w FROM documents),
word AS (SELECT r, lang, source, unnest(w) AS t FROM doc),
kept AS (SELECT lang, t, count(*) AS total FROM word GROUP BY lang, t HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
cnt AS (SELECT lang, source, t, count(*) AS c FROM word SEMI JOIN kept USING (lang, t) GROUP BY ALL),
tot AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL),
p AS (
  SELECT grp.lang, grp.source, kept.t, coalesce(c, 0) AS c, 1 + (1000000000 * CAST(coalesce(c, 0) + 5 AS HUGEINT)) // (coalesce(tot.n, 0) + 5 * v) AS p,
    1 + (1000000000 * CAST(total + 5 AS HUGEINT)) // (v.n + 5 * v) AS q
  FROM grp JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source AND cnt.t = kept.t
    LEFT JOIN tot ON tot.lang = grp.lang AND tot.source = grp.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT lang, source, 'term' AS part, t AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
}
