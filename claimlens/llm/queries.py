"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, decontam, embed_dedup, jaccard, langid, licenses, packing, passages, phrases, pieces, quality, suffix, urls


def vocabulary(name: str, spark: SparkSession | None = None) -> str:
    """Path of a tokenizer's file: in the folder that ``spark.claimlens.tokenizers`` names, which all machines must have, or
    else where an installed package of public tokenizers has it."""
    folder = spark.conf.get("spark.claimlens.tokenizers", None) if spark else None
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def default_model(spark: SparkSession | None = None) -> str:
    """The public SentencePiece model."""
    return vocabulary("piece_bpe_32k.model", spark)


def default_tokenizer(spark: SparkSession | None = None) -> str:
    """The public tokenizer with word ends."""
    return vocabulary("word_bpe_49k.json", spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    prototypes = langid.language_prototypes(docs.where(~held_out()).select("text", "lang"))
    found = langid.predict_language(docs, prototypes)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(~held_out())
    found = quality.quality_scores(docs, labels)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup_passages(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to, as digests."""
    coded = pieces.encode(read(spark, sf_dir, "documents"), default_model(spark), decoded=True)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), default_tokenizer(spark))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.lloyd(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_embedding_dedup, op3_license_scan, op4_url_filter, op5_jaccard_join, op6_quality, op7_substring_dedup, op8_decontaminate, op9_sentencepiece, op10_suffix_dedup, op11_best_fit_packing, op12_phrase_mining, op13_centroid_clustering)}

ORACLES = {"op3_license_scan": licenses.oracle(), "op13_centroid_clustering": clusters.oracle(), "op12_phrase_mining": phrases.ORACLE}

ORACLES["op2_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach(node, low) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node
), comp AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c ON c.node = v.vec_id
"""

ORACLES["op5_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS tok FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM o WHERE 100 * c >= 75 * (na + nb - c)),
reach(node, low) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node
), comp AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN comp c ON c.node = s.doc_id
"""

ORACLES["op7_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM dup),
lists AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string([w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(js, k)], ' '), '') END) AS kept_sha256
FROM w LEFT JOIN lists l ON l.doc_id = w.doc_id
"""

_WORDS8 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES["op8_decontaminate"] = f"""
WITH b AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
win AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS x
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM items))
), hit AS (SELECT doc_id, i, win.k, item_id FROM win JOIN items ON items.k = win.k AND items.x = win.x),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

ORACLES["op10_suffix_dedup"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), win AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1
), runs AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS new FROM dup
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM runs) GROUP BY doc_id, k
), parts AS (
  SELECT s.doc_id, a, b, substr(x, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS kept FROM spans s JOIN d ON d.doc_id = s.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY a)
), cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY a) AS kept, max(b) AS tail FROM parts GROUP BY doc_id
)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN x ELSE kept || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""


def _url_sql(rounds: int = 10, damping: float = 0.85, threshold: float = 0.075) -> str:
    """The rules and both walks, each round a step of its own."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: lower.format(f"coalesce(regexp_extract({u}, '^(?s).*?://([^/?#]*)', 1), '')")
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    steps = ""
    for i in range(rounds):
        steps += f""", r{i + 1} AS (SELECT s.host, {1 - damping!r}::DOUBLE * s.trusted + {damping}::DOUBLE * coalesce(t.x, 0) AS trust, {1 - damping!r}::DOUBLE * s.blocked + {damping}::DOUBLE * coalesce(b.x, 0) AS distrust FROM seeds s
  LEFT JOIN (SELECT dst, sum(trust / n_out) AS x FROM links JOIN r{i} ON host = src GROUP BY dst) t ON t.dst = s.host LEFT JOIN (SELECT src, sum(distrust / n_in) AS x FROM links JOIN r{i} ON host = dst GROUP BY src) b ON b.src = s.host)"""
    return f"""
WITH rules(v, h, p) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS k, page_id, html, {host("url")} AS host, coalesce(regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT k, h || p AS rule, v FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(h || p) DESC) = 1),
j AS (SELECT u.k, page_id, host, path, rule, v FROM u LEFT JOIN fit ON fit.k = u.k),
raw AS (SELECT DISTINCT host AS src, unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1)) AS target FROM u),
pairs AS (SELECT DISTINCT src, {host("CASE WHEN starts_with(target, '//') THEN 'http:' || target ELSE target END")} AS dst FROM raw),
links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n_out, count(*) OVER (PARTITION BY dst) AS n_in FROM pairs WHERE src <> '' AND dst <> '' AND src <> dst),
own AS (SELECT host, avg(coalesce((v = 'allow')::INT, 0)) AS trusted, avg(coalesce((v = 'block')::INT, 0)) AS blocked FROM j WHERE host <> '' GROUP BY host),
seeds AS (SELECT * FROM own UNION ALL SELECT DISTINCT dst, 0.0, 0.0 FROM links WHERE dst NOT IN (SELECT host FROM own)),
r0 AS (SELECT host, trusted AS trust, blocked AS distrust FROM seeds){steps}
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN round(distrust, 12) >= {threshold} AND round(distrust, 12) > round(trust, 12) THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN r{rounds} r ON r.host = j.host
"""


ORACLES["op4_url_filter"] = _url_sql()
