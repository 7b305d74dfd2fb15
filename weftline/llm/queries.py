"""The operators applied to the tables, as queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, langid, licenses, mixing, neardup, packing, pii, quality, sharding, vectors
from .store import table


def op1_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.lpt_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, table(spark, sf_dir, "labels"))
    stats = [F.col("_stats")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *stats, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op4_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op5_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.learn(docs))


def op6_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=4096)


def op7_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("th")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source is a repository, with directories of 1,280 and of 160 documents that follow one another."""
    docs = table(spark, sf_dir, "documents")
    of = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), of(64 * 20), of(8 * 20), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text").withColumnRenamed("file_id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lpt_shards, op2_pii_crf, op3_decision_list, op4_pruned_graph, op5_byte_gru, op6_swap_packing, op7_text_density, op8_chosen_path, op9_source_mix, op10_license_scan)
    return {f.__name__: f for f in own}


#: The mix in plain SQL: every word that a source, and a shard, can have is listed as a seat and ranked by its quotient.
_OP9 = r"""
WITH rows AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS draw FROM documents),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size FROM rows GROUP BY 1),
s1 AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY (skey[1] = 'n')::INT, skey) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level FROM s1
  WINDOW w AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN cap / weight > level THEN level END) OVER () AS level_all FROM s2),
s4 AS (SELECT skey, source_size, CASE WHEN level_all IS NULL THEN cap ELSE least(cap, level_all * weight) END AS target, total, greatest(ceil(total / 65536), 1)::BIGINT AS block FROM s3),
s AS (SELECT *, ceil(source_size::DOUBLE / block)::BIGINT AS held FROM s4),
won AS (SELECT skey, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, skey, k) AS rank, total FROM (SELECT *, unnest(range(3 * source_size)) AS k FROM s WHERE target > 0)),
quota AS (SELECT skey, count(*) AS source_quota FROM won WHERE rank <= total GROUP BY 1),
b AS (SELECT skey, source_size, block, coalesce(source_quota, 0) AS source_quota, b, b % 16 AS shard, least(block, source_size - b * block) AS length, ('0x' || substr(md5('mix-1:' || skey || ':' || b::VARCHAR), 1, 8))::BIGINT AS ord
  FROM (SELECT *, unnest(range(held)) AS b FROM s) LEFT JOIN quota USING (skey)),
q AS (SELECT skey, shard, source_quota, sum(length)::BIGINT AS n FROM b GROUP BY ALL),
won2 AS (SELECT skey, shard, source_quota, row_number() OVER (PARTITION BY skey ORDER BY n::DOUBLE / (2 * k + 1) DESC, shard, k) AS rank FROM (SELECT *, unnest(range(3 * n)) AS k FROM q)),
q2 AS (SELECT skey, shard, count(*) AS quota FROM won2 WHERE rank <= source_quota GROUP BY 1, 2),
t AS (SELECT b.*, coalesce(quota, 0) // n AS times, greatest(least(length, coalesce(quota, 0) % n - coalesce(sum(length) OVER (PARTITION BY skey, shard ORDER BY ord, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS part
  FROM b JOIN q USING (skey, shard) LEFT JOIN q2 USING (skey, shard)),
u AS (SELECT skey, b, times, part, coalesce(sum(times * length + part) OVER (PARTITION BY skey ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
d AS (SELECT doc_id, skey, size, sum(size) OVER (PARTITION BY skey ORDER BY draw % 256, draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM rows)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN z.before + z.times * (stop - z.b * block) + least(z.part, stop - z.b * block)
  - a.before - a.times * (stop - size - a.b * block) - least(a.part, stop - size - a.b * block) ELSE 0 END::BIGINT AS taken
FROM d JOIN s USING (skey) LEFT JOIN u a ON a.skey = d.skey AND a.b = (stop - size) // block LEFT JOIN u z ON z.skey = d.skey AND z.b = (stop - 1) // block
"""


#: Longest processing time first, a group a step: the group goes to the least loaded of eight shards, the lower one on a tie. Of the groups
#: of one size, the lower shards take those with the lower MD5. CRC-32 is reduced over the bytes with its table of 256 entries.
_OP1 = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
bytes AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
rows AS (
  SELECT doc_id, coalesce(md5(text), '') AS g, coalesce(strlen(text), 0)::BIGINT + 1 AS size,
    CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) END::BIGINT AS text_crc32 FROM bytes, crc),
groups AS (SELECT g, sum(size)::BIGINT AS bytes FROM rows GROUP BY 1),
queue AS (SELECT bytes, row_number() OVER (ORDER BY bytes DESC, g) AS i FROM groups),
steps AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS bytes, NULL::BIGINT AS shard, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT q.i, q.bytes, list_position(s.loads, list_min(s.loads)) - 1, list_transform(s.loads, lambda x, k: CASE WHEN k = list_position(s.loads, list_min(s.loads)) THEN x + q.bytes ELSE x END)
  FROM steps s JOIN queue q ON q.i = s.i + 1),
seats AS (SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS rank FROM steps WHERE i > 0),
ranked AS (SELECT g, bytes, row_number() OVER (PARTITION BY bytes ORDER BY g) AS rank FROM groups)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), g)), 1, 8))::BIGINT % 1024, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard
FROM rows JOIN ranked USING (g) JOIN seats USING (bytes, rank)
"""

#: Every two vectors of one length, and labels handed on along the links until no row is new.
_OP4 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, x FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
  WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS label FROM embeddings UNION SELECT l.v, r.label FROM reach r JOIN links l ON l.u = r.u WHERE r.label < l.v),
least AS (SELECT u, min(label) AS component_id FROM reach GROUP BY 1),
n AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.u = vec_id LEFT JOIN n ON n.u = vec_id
"""

#: The sets in full, pairs of distinct ones by the shingles that they share, and labels handed on along the links.
_OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words),
class AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets GROUP BY s),
shingles AS (SELECT c, n, unnest(s) AS x FROM class),
links AS (
  SELECT a.c AS u, b.c AS v FROM shingles a JOIN shingles b ON a.x = b.x AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT c AS u, c AS label FROM class UNION SELECT l.v, r.label FROM reach r JOIN links l ON l.u = r.u WHERE r.label < l.v),
least AS (SELECT u, min(label) AS component_id FROM reach GROUP BY 1),
out AS (SELECT doc_id, n::BIGINT AS n_shingles, (CASE WHEN n > 0 THEN component_id ELSE doc_id END)::BIGINT AS component_id FROM sets JOIN class USING (s) JOIN least ON least.u = c)
SELECT *, doc_id = component_id AS kept FROM out
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_lpt_shards": _OP1, "op4_pruned_graph": _OP4, "op8_chosen_path": _OP8, "op9_source_mix": _OP9}
