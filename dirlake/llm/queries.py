"""The queries op1 to op13 and `pipeline`, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from dirlake.llm import bagminhash, chat, embed_neardup, fingerprints, hard_negatives, langid, lattice_lm, mixing, packing, prefix_trie, quality_qda, quality_rules, url_rules
from dirlake.llm.common import documents


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_rules.judge(pages).select("own.page_id", "host", "path", "rule", "verdict")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), columns=["doc_id"]).select("own.doc_id", "q.*")


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_qda.classify(documents(spark, sf_dir), labels, columns=["doc_id"]).select("own.doc_id", "held_out", "score", "predicted")


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_neardup.near_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), columns=["doc_id"]).select("own.doc_id", "held_out", F.col("lang").alias("lang_pred"), "score")


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = e.select("vec_id", label.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("v"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ranked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fingerprints.with_next(documents(spark, sf_dir)).withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    d = fingerprints.fingerprints(d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "edited", F.col("sketch").alias("own"), "next_sketch"), "edited")
    own, other = F.col("own"), F.col("sketch")
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprints.printed(own).alias("fingerprint"), F.col("fingerprint").alias("edited_fingerprint"),
        fingerprints.resemblance(own, other).alias("near_edited"), fingerprints.resemblance(own, F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_shingles(own).alias("n_shingles"),
    )


OP1_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY n) AS turns FROM r GROUP BY conv_id),
same AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_logged, any_value(n_turns) AS n_turns FROM c GROUP BY turns),
kept AS (SELECT * FROM same s WHERE NOT EXISTS (SELECT 1 FROM same b WHERE b.n_turns > s.n_turns AND b.turns[1] = s.turns[1] AND list_slice(b.turns, 1, s.n_turns) = s.turns))
SELECT k.conv_id, CAST((n - 1) // 64 AS INTEGER) AS part, k.n_turns, k.n_logged,
    string_agg('<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || chr(10)
        || replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10), '' ORDER BY n) AS text
FROM kept k JOIN r ON k.conv_id = r.conv_id GROUP BY ALL
"""

#: The fixed rules of op2 and the words its method blocks.
OP2_SQL = """
WITH p AS (SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '://[^/?#]*([^#]*)', 1), '') AS rest FROM pages),
q AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN rest LIKE '%/%' AND regexp_matches(host, '(^|[^a-z0-9])(adult|pills|casino)([^a-z0-9]|$)') THEN 'block'
    WHEN regexp_matches(host || rest, '/(login|cart)([^a-zA-Z0-9_.%-]|$)') THEN 'block'
    WHEN regexp_matches(host || rest, '(^|[^a-zA-Z0-9])sessionid=') THEN 'block'
    WHEN regexp_matches(host || rest, '(^|[^a-zA-Z0-9])click([^a-zA-Z0-9](.|\\n)*)?[^a-zA-Z0-9]redirect=') THEN 'block'
    ELSE 'allow' END AS verdict FROM q
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, source, md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([1, 5, 2][place % 3 + 1] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
held AS (SELECT a.source, a.ratio, a.weight,
    (SELECT sum(source_size) FROM w) - coalesce((SELECT sum(b.cap) FROM r b WHERE b.ratio < a.ratio), 0) AS words,
    (SELECT sum(b.weight) FROM r b WHERE b.ratio >= a.ratio) AS weights FROM r a),
level AS (SELECT arg_min(words / weights, ratio) AS level FROM held WHERE words / weights <= ratio),
t AS (SELECT w.source, source_size, least(cap, level * weight) AS target FROM w, level),
q AS (SELECT d.*, t.source_size, t.target, row_number() OVER () AS row, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, unnest([0, 1, 2]) AS pass FROM q WHERE size > 0 AND target > 0),
packets AS (SELECT *, unnest(range(0, size, 1024)) AS lo, before + pass * source_size AS base FROM passes),
timed AS (SELECT *, least(size, lo + 1024) - lo AS words, CAST(base + least(size, lo + 1024) AS DOUBLE) / target AS finish FROM packets),
served AS (SELECT row, words, coalesce(sum(words) OVER (ORDER BY finish, key, row, pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM timed),
cut AS (SELECT row, sum(greatest(0, least(words, (SELECT round(sum(target)) FROM t) - earlier))) AS taken FROM served GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN cut ON q.row = cut.row
"""


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
s AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""

OP12_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT) % 6 AS h FROM c),
r AS (SELECT h.conv_id, t.n, 0 AS own, role, text FROM h JOIN t ON t.conv_id = h.base AND t.n <= h.h UNION ALL SELECT h.conv_id, t.n, 1, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.n > h.h),
p AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY own, n) FILTER (WHERE n IS NOT NULL), []) AS path FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY c.conv_id),
o AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM p),
v AS (SELECT list_slice(path, 1, depth) AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '') AS ends FROM o GROUP BY ALL),
k AS (SELECT v.*, (SELECT count(*) FROM v w WHERE w.depth = v.depth + 1 AND list_slice(w.prefix, 1, v.depth) = v.prefix) AS n_children FROM v),
s AS (SELECT a.prefix, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * coalesce(length(b.prefix[b.depth].text), 0)) AS saved_tokens
    FROM k a JOIN k b ON b.depth >= a.depth AND list_slice(b.prefix, 1, a.depth) = a.prefix GROUP BY a.prefix)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN s ON k.prefix = s.prefix LEFT JOIN v u ON u.depth = k.depth - 1 AND u.prefix = list_slice(k.prefix, 1, k.depth - 1)
"""

OP8_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(e, lambda v: v <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS other FROM e UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN least ON vec_id = node LEFT JOIN n ON a = vec_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_url_filters, op3_quality_rules, op4_bag_minhash, op5_mixing, op6_packing, op7_quality_classifier, op8_embedding_neardup, op9_language_id, op10_lattice_lm, op11_hard_negatives, op12_prefix_trie, op13_fingerprints, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op2_url_filters": OP2_SQL, "op5_mixing": OP5_SQL, "op8_embedding_neardup": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_prefix_trie": OP12_SQL}
