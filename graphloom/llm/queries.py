"""The registered opN_<name> queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, filter_audit, html_extract, importance, jaccard_join, mixing, quality_classifier, quality_rules, secret_scan, substring_dedup, suffix_dedup, token_count, token_output
from graphloom.llm.shared import tune


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_documents(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE doc_id > least
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM r
), w AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.train(docs, _read(spark, sf_dir, "labels")))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the files are never part of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i+l-1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, l, i, array_to_string(w[i:i+l-1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)
), hit AS (
  SELECT DISTINCT dw.doc_id, dw.i, dw.l FROM dw JOIN (SELECT DISTINCT l, g FROM bw) USING (l, g)
), n AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM dw JOIN bw USING (l, g)) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.score_documents(_read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)
), r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * word_chars
           OR 100 * n_dup_lines > 30 * n_lines AS rule_failed
  FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(rule_failed::INT)::DOUBLE AS f FROM r GROUP BY source
), m1 AS (
  SELECT sum(f) / sum(n) AS mean, (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) AS chance, sum(n) - sum(n * n) / sum(n) AS room,
         sum(f * f / n) - sum(f) * sum(f) / sum(n) - (count(*) - 1) * ((sum(f) / sum(n)) * (1 - sum(f) / sum(n))) AS between_hosts
  FROM h
), p AS (
  SELECT mean, 3 * mean / (1 + 2 * mean) AS max_rate,
         greatest(2.0, least(10000.0, CASE WHEN between_hosts > 0 AND room > 0 THEN chance * room / between_hosts - 1 ELSE 10000.0 END)) AS strength
  FROM m1
), v AS (
  SELECT source, max_rate, n + strength AS weight, (f + mean * strength) / (n + strength) AS rate FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate - 2 * sqrt(rate * (1 - rate) / (weight + 1)) <= max_rate AS kept
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal shares for all sources."""
    out = mixing.replicate(_read(spark, sf_dir, "documents"))
    return out.select(
        "row.doc_id", "row.source", F.round("rate", 6).alias("rate"), "nth", "part", F.col("copy").cast("long").alias("copy"), "order_key", "row.text"
    )


OP8_SQL = """
WITH RECURSIVE s AS (
  SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source
), r AS (
  SELECT source, (1.0 / (SELECT count(*) FROM s)) * (SELECT sum(n) FROM s) / n AS rate FROM s
), q AS (
  SELECT source, rate, greatest(1, ceil(rate / 256.0))::INT AS parts, rate / greatest(1, ceil(rate / 256.0)) AS own FROM r
), p(source, own, k, term, cum) AS (
  SELECT source, own, 0, exp(-own), exp(-own) FROM q
  UNION ALL
  SELECT source, own, k + 1, term * own / (k + 1), cum + term * own / (k + 1) FROM p WHERE k < own + 12 * sqrt(own) + 24
), d AS (
  SELECT doc_id, source, text, coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-') AS name,
         row_number() OVER (PARTITION BY doc_id, source, text ORDER BY doc_id) - 1 AS nth FROM documents
), u AS (
  SELECT d.*, part, ('0x' || substr(md5('42:' || name || ':' || nth || ':' || part), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, LATERAL (SELECT unnest(range(0, parts)) AS part)
), n AS (
  SELECT u.doc_id, u.source, u.name, nth, part, any_value(u.text) AS text, count(*) AS n
  FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source AND p.cum <= u.u GROUP BY u.doc_id, u.source, u.name, nth, part
)
SELECT doc_id, n.source, round(rate, 6) AS rate, nth, part::INT AS part, copy::BIGINT AS copy,
       ('0x' || substr(md5('42:order:' || name || ':' || nth || ':' || part || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0 AS order_key, text
FROM (SELECT *, unnest(range(0, n)) AS copy FROM n) n JOIN q ON n.source IS NOT DISTINCT FROM q.source
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.join_documents(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_size", "n_links")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+l-1], ' ') AS g
  FROM (SELECT doc_id, w, least(5, len(w)) AS l, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), rare AS (
  SELECT g FROM g GROUP BY g HAVING count(*) > 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM (SELECT * FROM g SEMI JOIN rare USING (g)) a JOIN (SELECT * FROM g SEMI JOIN rare USING (g)) b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (
  SELECT a AS doc_id, min(b) AS class_id, count(*)::BIGINT AS class_size FROM reach GROUP BY a
)
SELECT c.doc_id, class_id, class_size, (SELECT count(*) FROM link WHERE link.a = c.doc_id)::BIGINT AS n_links FROM c
"""


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_output.token_table(_read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_output.digest(tokens)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_documents(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: SQL has no crc32, so it is written out over the hexadecimal bytes of each distinct feature.
OP12_SQL = r"""
WITH RECURSIVE steps(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8
), w AS (
  SELECT 'd' AS corpus, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (
  SELECT corpus, r, unnest(w) AS f FROM w
  UNION ALL
  SELECT corpus, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
), n AS (
  SELECT corpus, r, f, count(*) AS n FROM f GROUP BY corpus, r, f
), h AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)
), b AS (
  SELECT f, xor(list_reduce(list_transform(range(1, length(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
                            lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM h, crc
), p AS (
  SELECT corpus, r, b, sum(n) AS n FROM n JOIN b USING (f) GROUP BY corpus, r, b
), s AS (
  SELECT b, sum(n) FILTER (corpus = 'd') AS s, sum(n) FILTER (corpus = 'b') AS t FROM p GROUP BY b
), g AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
         / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM s) + 10000)::DOUBLE))) AS gain FROM s
), d AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM p JOIN g USING (b) WHERE corpus = 'd' GROUP BY r
), x AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN d USING (r) WHERE corpus = 'd'
), y AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x
), z AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM y
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM y WHERE n_words >= 20) // 100 THEN place END::BIGINT AS rank FROM z
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER ((mask & (before | bit)) = 0) AS kept, sum(n) FILTER ((mask & before) = 0 AND (mask & bit) > 0) AS removed,
         sum(n) FILTER ((mask & before) > 0 AND (mask & bit) > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER ((mask & before) = 0 AND (mask & bit) > 0) AS good_lost, sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) > 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit, before
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_output": op10_token_output,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_importance": op12_importance,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op8_mixing": OP8_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op12_importance": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
