"""The registered queries of this subpackage: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle, mixing, quality, rules, toxicity
from .ann import neighbours
from .decontamination import find_phrases
from .language import identify, learn_profiles
from .license import scan
from .near import near_classes
from .substring import substring_dedup
from .text import remainder, table
from .tokenizer import encode_decode
from .whitening import whitened


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 3, F.lit(False))
    out = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("keep"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    out = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    out = mixing.score(docs, *mixing.learn(docs.filter(~held_out)), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    starts = F.expr("transform(filter(spans, x -> x.base), x -> cast(x.first AS bigint))")
    base = F.size("base_labels") > 0
    score = F.when(base | (F.col("best") > 0), F.greatest(F.when(base, F.lit(0.9)).otherwise(F.lit(0.0)), F.lit(0.25) + F.col("best") * F.lit(0.25))).otherwise(F.lit(0.0))
    return out.select("doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), score.alias("score"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    out = identify(docs, learn_profiles(docs.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.filter("vec_id % 50 = 0"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(table(spark, sf_dir, "documents")).withColumn("folded_root", merkle.folded(F.col("forged"), F.col("way")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("way")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rules.passes(rules.BASE)).alias("base_failed"), "kept", "failed", "policy")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_quality, op3_toxicity, op4_language_model, op5_near_duplicates, op6_licenses, op7_substring_dedup, op8_language, op9_decontamination, op10_neighbours, op11_merkle_manifest, op12_whitening, op13_quality_rules)
}

ORACLES: dict[str, str] = {
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, p, list_slice(w, p, p + 19) AS k FROM s),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r WHERE n > 1),
w AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM d),
m AS (SELECT w.doc_id, w.i, w.w, g.i IS NOT NULL AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.i = g.i),
o AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, coalesce(string_agg(CASE WHEN NOT gone THEN w END, ' ' ORDER BY i), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(9, len(w) - 1)) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(k) AS n FROM p),
s AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM s JOIN p USING (k)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE c AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head, text,
  list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) AS r FROM documents),
l AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(r, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS forged FROM c),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, forged) - 1 AS idx FROM l),
n AS (SELECT 0 AS lev, tree, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM b
  UNION ALL
  SELECT lev + 1, tree, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(size) + 15) // 16 FROM n WHERE size > 1 GROUP BY lev, tree, idx // 16),
s AS MATERIALIZED (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size FROM n WHERE size = 1),
u AS (SELECT 0 AS lev, idx, subroot AS digest, size FROM s UNION ALL SELECT lev + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(size) + 15) // 16 FROM u WHERE size > 1 GROUP BY lev, idx // 16),
g AS MATERIALIZED (SELECT lev, tree, idx // 16 AS up, list(digest ORDER BY idx) AS d FROM n WHERE size > 1 GROUP BY ALL),
v AS MATERIALIZED (SELECT lev, idx // 16 AS up, list(digest ORDER BY idx) AS d FROM u WHERE size > 1 GROUP BY ALL),
w AS (SELECT b.tree, b.doc_id, b.leaf, b.idx, b.forged, 0 AS lev, b.idx AS at, false AS top, b.forged AS h, '' AS proof FROM b
  UNION ALL
  SELECT w.tree, w.doc_id, w.leaf, w.idx, w.forged, w.lev + 1, w.at // 16, false, sha256(array_to_string(list_concat(d[:w.at % 16], [h], d[w.at % 16 + 2:]), '')), proof || array_to_string(list_concat(d[:w.at % 16], d[w.at % 16 + 2:]), '') FROM w JOIN g ON g.lev = w.lev AND g.tree = w.tree AND g.up = w.at // 16),
e AS MATERIALIZED (SELECT w.* FROM w JOIN n ON n.lev = w.lev AND n.tree = w.tree AND n.size = 1),
x AS (SELECT e.tree, doc_id, leaf, e.idx, 0 AS lev, s.idx AS at, h, proof FROM e JOIN s ON s.tree = e.tree
  UNION ALL
  SELECT x.tree, doc_id, leaf, x.idx, x.lev + 1, x.at // 16, sha256(array_to_string(list_concat(d[:x.at % 16], [h], d[x.at % 16 + 2:]), '')), proof || array_to_string(list_concat(d[:x.at % 16], d[x.at % 16 + 2:]), '') FROM x JOIN v ON v.lev = x.lev AND v.up = x.at // 16),
t AS (SELECT lev, digest AS root FROM u WHERE size = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM x JOIN t ON t.lev = x.lev JOIN s ON s.tree = x.tree""",
    "op13_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
s AS (SELECT rid, p, list_slice(w, p, p + 2) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
r AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS n FROM s),
c AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS x FROM r WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•▪]'))) AS n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_cut_lines, coalesce(c.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: NOT regexp_matches(x, '\pL'))) AS n_letterless, contains(lower(t), 'lorem ipsum')::INT AS n_fillers
  FROM d LEFT JOIN c ON d.rid = c.rid),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (10 * n_bullet_lines > 9 * n_lines)::BIGINT + 128 * (10 * n_cut_lines > 3 * n_lines)::BIGINT
  + 256 * (10 * n_letterless > 4 * n_words)::BIGINT + 512 * (n_fillers > 0)::BIGINT + 1024 * (n_words > 100000)::BIGINT + 2048 * (50 * n_symbols > n_words)::BIGINT + 4096 * (100 * n_repeat_words > 20 * n_words)::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 1023 = 0 AS kept, failed, 'default-1' AS policy FROM f""",
}
