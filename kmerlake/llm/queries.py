"""One query for each operator of this subpackage, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversation_repair, divergence, line_dedup, lm_score, ngram_rules, packing, pattern_packing, quality_gam, simhash, suffix_dedup, token_count
from .common import table


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("lines_before").alias("n_lines"),
        F.col("lines_gone").alias("n_removed"),
        F.col("runs_gone").alias("n_runs"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP3_SQL = """
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
w AS (SELECT *, lead(line) OVER (PARTITION BY doc_id, text ORDER BY pos) AS nxt FROM l),
r AS (SELECT doc_id, text, pos, count(*) OVER (PARTITION BY line, nxt) AS n,
             row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, pos) AS copy
      FROM w WHERE nxt IS NOT NULL AND regexp_matches(concat(line, nxt), '[^\\x20\\x09-\\x0D]')),
g AS (SELECT doc_id, text, pos FROM r WHERE copy > 1 UNION SELECT doc_id, text, pos + 1 FROM r WHERE copy > 1),
m AS (SELECT l.*, g.pos IS NOT NULL AS gone, lag(g.pos) OVER (PARTITION BY l.doc_id, l.text ORDER BY l.pos) IS NOT NULL AS before
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.text = l.text AND g.pos = l.pos),
k AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_runs,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id, text)
SELECT documents.doc_id, n_lines, n_removed, n_runs, kept_sha256 FROM documents JOIN k ON k.doc_id = documents.doc_id AND k.text = coalesce(documents.text, '')
"""


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.tiktoken"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_multi_50k.tiktoken"), word_pattern())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))


def op9_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audit(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


#: The checksum is worked out from its table; d: signs of rows in order, with the number of rows of each conversation; b: from
#: the last row on, the best cost and edits from each grammar state (0 start, 1 system, 2 user, 3 assistant) to the end.
OP11_SQL = """
WITH RECURSIVE tb AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
h AS (SELECT *, xor(4294967295, list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) % 20 AS kind FROM o, tb),
dm AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS m, lag(left(role, 1)) OVER w AS before,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM dm WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
d AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM r),
g(q, x, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
n1 AS (SELECT q, z FROM g WHERE x <> 's'),
ins AS (SELECT q, q AS z, 0 AS cost, '' AS e FROM (SELECT DISTINCT q FROM g) UNION ALL SELECT q, z, 2, 'I' FROM n1 UNION ALL SELECT a.q, b.z, 4, 'II' FROM n1 a JOIN n1 b ON b.q = a.z),
arcs AS MATERIALIZED (SELECT q, z, cost + 3 AS cost, concat(e, 'D') AS e, 'D' AS x FROM ins UNION ALL SELECT i.q, n1.z, cost + 2, concat(e, 'R'), 'R' FROM ins i JOIN n1 ON n1.q = i.z UNION ALL SELECT i.q, g.z, cost, concat(e, 'K'), x FROM ins i JOIN g ON g.q = i.z),
b AS (SELECT DISTINCT conv_id, m + 1 AS i, q, {'c': c, 's': s} AS w FROM (SELECT DISTINCT conv_id, m FROM d), (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) v(q, c, s)
      UNION ALL SELECT d.conv_id, d.i, arcs.q, min({'c': b.w.c + arcs.cost + CASE WHEN fault = 'truncated' AND x <> 'D' THEN 1 ELSE 0 END, 's': concat(e, b.w.s)})
      FROM b JOIN d ON d.conv_id IS NOT DISTINCT FROM b.conv_id AND d.i = b.i - 1 JOIN arcs ON arcs.z = b.q AND (x = 'D' OR fault NOT IN ('blank', 'duplicate') AND (x = 'R' OR x = left(role, 1))) GROUP BY d.conv_id, d.i, arcs.q),
a AS MATERIALIZED (SELECT conv_id, w.c AS cost, w.s AS audit FROM b WHERE i = 1 AND q = 0),
e1 AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS j FROM a WHERE audit <> ''),
e2 AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM e1),
e3 AS (SELECT e2.*, role, text, row_number() OVER (PARTITION BY e2.conv_id ORDER BY j) AS p, first_value(e = 'K' AND left(role, 1) = 's') OVER (PARTITION BY e2.conv_id ORDER BY j) AS sys
       FROM e2 LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM e2.conv_id AND d.i = e2.i WHERE e <> 'D'),
rp AS (SELECT conv_id, string_agg(concat(CASE WHEN e = 'K' THEN role WHEN (p - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN e = 'I' THEN '' ELSE text END), chr(10) ORDER BY j) AS body FROM e3 GROUP BY conv_id),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
      count(*) FILTER (WHERE before IS NOT NULL AND concat(before, left(role, 1)) NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
CAST(coalesce(a.cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN rp ON rp.conv_id IS NOT DISTINCT FROM k.conv_id
"""


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json")).drop("ids")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS kinds, sum(lang_n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
e AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * kinds) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * kinds) AS BIGINT) AS q
      FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM e a JOIN e b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM s a JOIN s b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM e WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def queries() -> dict:
    ops = [
        op1_quality_gam, op2_ngram_rules, op3_line_dedup, op4_lm_score, op5_token_counts,
        op6_byte_bpe, op7_simhash, op8_packing, op9_ann_forest, op10_suffix_dedup,
        op11_conversation_repair, op12_pattern_packing, op13_divergence,
    ]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op11_conversation_repair": OP11_SQL, "op13_divergence": OP13_SQL}
