"""The registered queries of this package: (spark, sf_dir) -> DataFrame, and DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from meterwise.llm import (backoff_lm, crc_resampling, decision_list, knn_quality, language_id, line_dedup, ngram_join, pivotal_mix, preferences, prefix_trie, secret_scan,
                           suffix_arrays, warc)
from meterwise.llm.folds import held_out
from meterwise.llm.scratch import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = knn_quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()), "quality")
    return knn_quality.predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.taken(table(spark, sf_dir, "documents"))


def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = """
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len, array_to_string(list_slice(w, i, i + len - 1), ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 13) AS len, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM win),
spots AS (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM low, lens WHERE len(w) >= len),
hit AS (
  SELECT s.doc_id, s.i, s.len, win.item_id FROM (SELECT doc_id, i, len, array_to_string(list_slice(w, i, i + len - 1), ' ') AS g FROM spots) s
  JOIN win ON win.g = s.g AND win.len = s.len),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM (SELECT DISTINCT doc_id, i, len FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out()))
    return language_id.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_exact", "n_near", "whole", F.col("row.text").alias("text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest
"""


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = """
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
gram AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM low WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pairs JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM low UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT low.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM low LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(decision_list.statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("y"))
    rules = decision_list.learn(own.join(labels, "doc_id"))
    failed = decision_list.base_failed()
    return own.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & decision_list.verdict(rules)).alias("kept"), decision_list.number_of_first_rule(rules).alias("rule"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(preferences.turns(table(spark, sf_dir, "conversations")), "turns")
    alike = preferences.format_pairs(own, preferences.pairs(own))
    out = alike.withColumn("kind", F.lit("opening")).union(preferences.format_replies(own).withColumn("kind", F.lit("reply")))
    spans = lambda c: F.aggregate(c, F.lit(0), lambda acc, s: acc + s["end"] - s["start"]).cast("long")
    return out.select("kind", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected", spans("chosen_mask").alias("chosen_trained"), spans("rejected_mask").alias("rejected_trained"))


# The masks themselves are checked in the tests; here by the number of characters that train.
OP9_SQL = """
WITH t AS (
  SELECT conv_id, turn, m.role AS role, m.text AS text FROM (
    SELECT conv_id, turn, min({'role': replace(replace(coalesce(role, 'none'), '<', '< '), '|', ' | '), 'text': replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >')}) AS m
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)),
talk AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS l, list(turn ORDER BY turn) AS turns,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said FROM t GROUP BY conv_id),
best AS (SELECT l[1] AS opening, arg_min(conv_id, (-said, conv_id)) AS chosen_id FROM talk GROUP BY l[1]),
pair AS (
  SELECT b.chosen_id, r.conv_id AS rejected_id, c.l AS c, r.l AS r,
    coalesce(list_min([i FOR i IN range(1, greatest(len(c.l), len(r.l)) + 1) IF c.l[i] IS DISTINCT FROM r.l[i]]) - 1, len(c.l)) AS p
  FROM talk r JOIN best b ON b.opening = r.l[1] JOIN talk c ON c.conv_id = b.chosen_id
  WHERE r.conv_id <> b.chosen_id AND (c.l <> r.l OR c.turns <> r.turns)),
reply AS (SELECT conv_id, l, i[len(i)] AS last, i[len(i) - 1] AS stale FROM (SELECT conv_id, l, [i FOR i IN range(1, len(l) + 1) IF l[i].role = 'assistant'] AS i FROM talk) WHERE len(i) > 1),
cut AS (
  SELECT 'opening' AS kind, chosen_id, rejected_id, p, c[1:p] AS h, c[p + 1:] AS c, r[p + 1:] AS r FROM pair
  UNION ALL
  SELECT 'reply', conv_id, conv_id, last - 1, l[1:last - 1], [l[last]], [l[stale]] FROM reply WHERE l[last].text <> l[stale].text)
SELECT kind, chosen_id, rejected_id, CAST(p AS INTEGER) AS n_prompt_turns,
  coalesce(array_to_string([concat('<|', x.role, '|>', chr(10), x.text, '<|end|>', chr(10)) FOR x IN h], ''), '') AS prompt,
  coalesce(array_to_string([concat('<|', x.role, '|>', chr(10), x.text, '<|end|>', chr(10)) FOR x IN c], ''), '') AS chosen,
  coalesce(array_to_string([concat('<|', x.role, '|>', chr(10), x.text, '<|end|>', chr(10)) FOR x IN r], ''), '') AS rejected,
  CAST(coalesce(list_sum([length(x.text) + 8 FOR x IN c IF x.role = 'assistant']), 0) AS BIGINT) AS chosen_trained,
  CAST(coalesce(list_sum([length(x.text) + 8 FOR x IN r IF x.role = 'assistant']), 0) AS BIGINT) AS rejected_trained
FROM cut
"""


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents"), order=backoff_lm.ORDER)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def _spans_sql(kind: str, pattern: str, keep: str, value: str) -> str:
    """The matches of a pattern with their places: a text is its pieces and matches in turn."""
    return f"""
SELECT r, source, doc_id, '{kind}' AS kind, {value} AS value, upto - length(m) AS s, upto AS e FROM (
  SELECT r, source, doc_id, m, sum(length(p) + length(m)) OVER (PARTITION BY r ORDER BY i) AS upto FROM (
    SELECT r, source, doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(string_split_regex(text, '{pattern}')[:-2]) AS p,
      unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM d WHERE regexp_matches(text, '{pattern}')))
WHERE {keep}"""


_ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS ({_spans_sql('assign', _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 8", f"regexp_extract(m, '{_ASSIGN}', 2)")}
UNION ALL {_spans_sql('access', 'AKIA[A-Z0-9]+', 'length(m) >= 16', 'm')}
UNION ALL {_spans_sql('hex', '[0-9a-f]+', 'length(m) >= 32', 'm')}),
run AS ({_spans_sql('token', '[A-Za-z0-9_-]{8,}', "regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]')", 'm')}),
found AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM run WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = run.r AND base.s < run.e AND run.s < base.e)),
freq AS (
  SELECT trim(value, '.=') AS v, count(DISTINCT CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END) AS n_owners, bool_or(kind = 'assign') AS assigned
  FROM found GROUP BY 1),
told AS (
  SELECT found.*, n_owners <= 2 AS own FROM found JOIN freq ON v = trim(value, '.=')
  WHERE kind <> 'token' OR (n_owners <= 2 AND (assigned OR (length(value) >= 20 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    AND len(list_distinct(string_split(value, ''))) >= 12)))),
docs AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (kind <> 'token') AS base_spans,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans,
    count(*) FILTER (own) AS n_live, count(*) FILTER (NOT own AND kind <> 'token') AS n_examples
  FROM (SELECT *, list_position(['assign', 'access', 'hex', 'token'], kind) AS k FROM told) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM d LEFT JOIN docs USING (r)
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("fp")


# crc32 from its rule: the table by eight shifts of each byte, then one step per byte of the text.
_CRC_TABLE = """crc_step AS (
  SELECT n, n AS c, 0 AS k FROM range(256) t(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS crc_t FROM crc_step WHERE k = 8)"""


def _crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text, in a query joined to crc_table."""
    bytes_ = f"list_transform(range(1, strlen({text}) * 2, 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda a, b: xor(a >> 8, crc_t[(xor(a, b) & 255) + 1])), 4294967295)"


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
own AS (
  SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t.role, left(t.text, 32), ref) AS l FROM (
    SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
      sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS ref FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
ids AS (SELECT own.*, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own, crc_table),
built AS (SELECT i.conv_id AS c, list_concat(coalesce(b.l, [])[1:i.h], i.l[i.h + 1:]) AS l FROM ids i LEFT JOIN own b ON b.conv_id = i.conv_id - i.conv_id % 20),
pre AS (SELECT c, d, l[1:d] AS p, d = len(l) AS ends, l[d].text AS last FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM built)),
node AS (
  SELECT p, d AS depth, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ids, bool_and(ends) AS leaf,
    (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(last), ''), '[^\\x20\\x09-\\x0D]+')) AS saved FROM pre GROUP BY p, d),
sub AS (
  SELECT a.p, a.depth, sum(n.saved) AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves, count(*) FILTER (n.depth = a.depth + 1) AS n_children
  FROM node n, LATERAL (SELECT n.p[1:k] AS p, k AS depth FROM range(0, n.depth + 1) t(k)) a GROUP BY a.p, a.depth)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM node n JOIN sub s ON s.p = n.p LEFT JOIN node u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]
"""


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crc_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS13 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
low AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS13} AS w FROM documents),
goal AS (SELECT {_WORDS13} AS w FROM benchmark),
feat AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS f FROM low, range(1, 4) t(k)) GROUP BY r, f),
want AS (SELECT f, count(*) AS n FROM (SELECT unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS f FROM goal, range(1, 4) t(k)) GROUP BY f),
bucket AS (SELECT f, {_crc32_sql("f")} % 10000 AS b FROM (SELECT f FROM feat UNION SELECT f FROM want), crc_table),
s AS (SELECT b, sum(n) AS n FROM feat JOIN bucket USING (f) GROUP BY b),
t AS (SELECT b, sum(n) AS n FROM want JOIN bucket USING (f) GROUP BY b),
gain AS (
  SELECT k AS b, CAST(floor(1000 * ln(
    (coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS g
  FROM range(10000) x(k) LEFT JOIN s ON s.b = k LEFT JOIN t ON t.b = k),
weighed AS (SELECT r, sum(n) AS n_features, sum(n * g) AS weight FROM feat JOIN bucket USING (f) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM low LEFT JOIN weighed USING (r)),
place AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS k, count(*) OVER () * 5 // 100 AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= n THEN k END AS "rank" FROM scored LEFT JOIN place USING (r)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_knn_quality": op1_knn_quality,
    "op2_pivotal_mix": op2_pivotal_mix,
    "op3_suffix_arrays": op3_suffix_arrays,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_decision_list": op8_decision_list,
    "op9_preferences": op9_preferences,
    "op10_backoff_lm": op10_backoff_lm,
    "op11_secret_scan": op11_secret_scan,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_crc_resampling": op13_crc_resampling,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op3_suffix_arrays": OP3_SQL, "op5_warc": OP5_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op9_preferences": OP9_SQL,
                           "op11_secret_scan": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_crc_resampling": OP13_SQL}
