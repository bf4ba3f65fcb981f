"""The operators over their whole tables, with their reference SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cleanframe.sources import read_table
from cleanframe.sources.tables import shared_folder

from . import decontaminate, langid, lexical, licenses, merkle, minhash, mixing, packing, pii, secret_scan, sharding, tokens, vectors
from .spans import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    """Register a function of (spark, table, folder)."""

    def register(build):
        QUERIES[name] = lambda spark, folder: build(spark, read_table(spark, f"{folder}/{table}.parquet"), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_sampled_splitters")
def op1(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    out = sharding.shard(docs.select("doc_id", "text"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op2_license_sentences")
def op2(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    found = licenses.find_licenses(docs.select("doc_id", "text"))
    lists = ("sentence_ids", "licenses", "unmatched")
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in lists])


@query("op3_markov_secrets")
def op3(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(docs.select("doc_id", "text")))


@query("op4_spliced_tokens")
def op4(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return tokens.count_tokens(docs)


@query("op5_latent_leaks")
def op5(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    benchmark = read_table(spark, f"{folder}/benchmark.parquet")
    found = decontaminate.leaks(docs, benchmark)
    return found.select("doc_id", "item_id", *[F.round(c, 4).alias(c) for c in ("similarity", "subsequence", "answer")])


OP6_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
t AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles
  FROM w),
s AS MATERIALIZED (SELECT *, md5(array_to_string(list_sort(shingles), chr(10))) AS k FROM t),
c AS MATERIALIZED (SELECT min(doc_id) AS node, k, any_value(shingles) AS shingles FROM s WHERE len(shingles) > 0 GROUP BY k),
e AS MATERIALIZED (SELECT node, len(shingles) AS n, unnest(shingles) AS x FROM c),
p AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS MATERIALIZED (
  SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT c.node, s.doc_id FROM s JOIN c USING (k) UNION SELECT s.doc_id, c.node FROM s JOIN c USING (k)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, m.component_id, m.component_id = s.doc_id AS kept
FROM s JOIN m USING (doc_id)
"""


@query("op6_fast_sketch", sql=OP6_SQL)
def op6(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return minhash.near_duplicates(docs)


OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.reach),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.reach) AS component_id, min(r.reach) = r.vec_id AS kept
FROM r LEFT JOIN n USING (vec_id) GROUP BY r.vec_id
"""


@query("op7_projection_forest", table="embeddings", sql=OP7_SQL)
def op7(spark: SparkSession, vecs: DataFrame, folder: str) -> DataFrame:
    return vectors.near_vectors(vecs)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws(':', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source),
v AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5
      - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0)
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (SELECT source, source_size, least(max(level) OVER () * weight, source_size * 2.0::DOUBLE) AS target FROM v),
l AS (SELECT greatest(4096, 16 * count(*)) AS least, sum(target) AS total FROM t),
w AS (SELECT total, greatest(1, floor(total / (least * 8)))::BIGINT AS block_words FROM l),
m AS (SELECT total, block_words, greatest(1, round(total / (block_words * 8)))::BIGINT AS blocks FROM w),
q AS (
  SELECT source, row_number() OVER (ORDER BY target / total / (2 * k + 1) DESC, source NULLS LAST) AS rank, blocks
  FROM t, m, range(0, (SELECT max(blocks) FROM m)) AS seats(k) WHERE target > 0 AND k <= target / total * blocks + 100),
a AS (SELECT source, count(*) AS quota FROM q WHERE rank <= blocks GROUP BY source),
b AS (
  SELECT t.*, coalesce(a.quota, 0) AS quota, m.block_words
  FROM t CROSS JOIN m LEFT JOIN a ON a.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT d.*, b.* EXCLUDE (source), least(quota * 8 * block_words, source_size * 2) AS words,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS rounds FROM x)
SELECT doc_id, size, source_size, target, quota::BIGINT AS quota, block_words,
  (rounds * size + greatest(0, least(start + size, words - rounds * source_size) - start))::BIGINT AS taken
FROM y
"""


@query("op8_sainte_lague", sql=OP8_SQL)
def op8(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "quota", "block_words", "taken")


@query("op9_scored_pii")
def op9(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    found = pii.find_pii(docs.select("doc_id", "text"))
    counted = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[counted(kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), 2).alias("top_score"),
    )


@query("op10_nearest_centroid")
def op10(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    told = docs.withColumn("held_out", langid.held_out("doc_id"))
    return langid.identify(told, langid.train(docs), ["doc_id", "held_out"])


@query("op11_bit_packing")
def op11(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    packing.write_packed(docs.select("doc_id", "text"), path)
    return packing.read_packed(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS crc
  FROM documents),
f AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
  FROM d),
t AS MATERIALIZED (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS told,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM f),
r(s, l, i, h, n) AS (
  SELECT s, 0, i, leaf, n FROM t UNION ALL
  SELECT s, l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM r WHERE n > 1 GROUP BY s, l, i // 16),
b AS MATERIALIZED (SELECT * FROM r),
u(l, i, h, n) AS (
  SELECT 0, s, h, count(*) OVER () FROM b WHERE n = 1 UNION ALL
  SELECT l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY l, i // 16),
a AS MATERIALIZED (
  SELECT s, l, i, h, n FROM b WHERE n > 1 UNION ALL SELECT NULL, l, i, h, n FROM u WHERE n > 1),
p(doc_id, s, part, l, i, n) AS (
  SELECT doc_id, s, 0, 0, i, n FROM t UNION ALL
  SELECT doc_id, s, CASE WHEN n = 1 THEN 1 ELSE part END, CASE WHEN n = 1 THEN 0 ELSE l + 1 END, CASE WHEN n = 1 THEN s ELSE i // 16 END,
    CASE WHEN n = 1 THEN (SELECT max(s) + 1 FROM t) ELSE (n + 15) // 16 END
  FROM p WHERE n > 1 OR part = 0),
w AS (
  SELECT p.doc_id, sha256(coalesce(string_agg(a.h, '' ORDER BY p.part, p.l, a.i), '')) AS proof_sha256
  FROM p LEFT JOIN a ON a.s IS NOT DISTINCT FROM CASE WHEN p.part = 0 THEN p.s END AND a.l = p.l AND a.i // 16 = p.i // 16 AND a.i <> p.i AND p.n > 1
  GROUP BY p.doc_id),
g(doc_id, s, l, i, h, n) AS (
  SELECT doc_id, s, 0, i, told, n FROM t UNION ALL
  SELECT g.doc_id, g.s, g.l + 1, g.i // 16, sha256(string_agg(CASE WHEN a.i = g.i THEN g.h ELSE a.h END, '' ORDER BY a.i)), (any_value(g.n) + 15) // 16
  FROM g JOIN a ON a.s = g.s AND a.l = g.l AND a.i // 16 = g.i // 16 WHERE g.n > 1 GROUP BY g.doc_id, g.s, g.l, g.i),
k(doc_id, l, i, h, n) AS (
  SELECT doc_id, 0, s, h, (SELECT max(s) + 1 FROM t) FROM g WHERE n = 1 UNION ALL
  SELECT k.doc_id, k.l + 1, k.i // 16, sha256(string_agg(CASE WHEN a.i = k.i THEN k.h ELSE a.h END, '' ORDER BY a.i)), (any_value(k.n) + 15) // 16
  FROM k JOIN a ON a.s IS NULL AND a.l = k.l AND a.i // 16 = k.i // 16 WHERE k.n > 1 GROUP BY k.doc_id, k.l, k.i)
SELECT t.doc_id, t.leaf, b.h AS subroot, u.h AS root, w.proof_sha256, k.h AS folded_root, k.h = u.h AS verified
FROM t JOIN b ON b.s = t.s AND b.n = 1 JOIN u ON u.n = 1 JOIN w USING (doc_id) JOIN k ON k.doc_id = t.doc_id AND k.n = 1
"""


@query("op12_postorder_log", sql=OP12_SQL)
def op12(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest(*head, lowered))
    manifest = merkle.build(docs, merkle.leaf_digest(*head, F.col("text")), shown=tampered)
    return merkle.prove(manifest).withColumnRenamed("id", "doc_id")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM d WHERE len(terms) > 0),
t AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d) AS x GROUP BY doc_id, n, term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, n_docs),
i AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) AS x),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // length)))) AS BIGINT) AS score
  FROM i JOIN t USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op13_automaton_scan", sql=OP13_SQL)
def op13(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return lexical.rank(docs, read_table(spark, f"{folder}/benchmark.parquet"))
