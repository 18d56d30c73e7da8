"""One query for each operator, with its production parameters, over its whole table; DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, license_scan, license_texts, lm_scoring, mixing, ngram_join, quality_classifier, quality_rules, recompression, suffix_dedup, token_rollups, turns, warc
from ._session import bucket_of, table, written


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm_scoring.fit(docs.where(bucket_of("doc_id", 7) != 2), order=2)
    return lm_scoring.score(docs, model).select("*", (bucket_of("doc_id", 7) == 2).alias("held_out"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches and a replay: estimated counts of all documents are inserted, revised to the counts of two tokenizers,
    and documents with a toxic label are deleted; committing the revision again changes nothing."""
    docs = table(spark, sf_dir, "documents")
    store = token_rollups.Rollups(spark)
    counted = docs.select("doc_id", "source", "lang", (F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("bigint").alias("guess"), token_rollups.space_words("text").alias("space"), token_rollups.alnum_words("text").alias("alnum"))
    counted = written(counted, "token-counts")
    rows = lambda df, name, column, sign=1: token_rollups.signed(df, name, F.col(column), sign)
    store.commit("1-insert", rows(counted, "estimate-0", "guess"))
    revised = token_rollups.revision(rows(counted, "estimate-0", "guess"), rows(counted, "space-1", "space").unionByName(rows(counted, "alnum-1", "alnum")))
    store.commit("2-revise", revised)
    toxic = counted.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    store.commit("3-delete", rows(toxic, "space-1", "space", -1).unionByName(rows(toxic, "alnum-1", "alnum", -1)))
    store.commit("2-revise", revised)
    return store.totals()


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(bucket_of("doc_id", 4) != 2))
    return quality_classifier.score(docs, model).select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark, warc.write(table(spark, sf_dir, "pages")))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_passages and n_passage_words: repeats of 256 bytes that cover over 50 words in a run, from the same pass."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"), fine=suffix_dedup.FINE)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/lang/shelf/box; the first of every box is its licence file."""
    i = F.col("doc_id")
    name = F.when(i % 8 == 0, F.lit("LICENSE")).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", (i - i % 512).cast("string"), (i - i % 8).cast("string"), name)
    shelf = F.concat_ws("/", "source", "lang", (i - i % 512).cast("string"), name)
    return license_scan.scan(table(spark, sf_dir, "documents").withColumn("path", F.when(i % 512 == 0, shelf).otherwise(path)), templates=license_texts.templates(), frequencies="corpus", passages=True)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = turns.run(table(spark, sf_dir, "conversations"))
    content = F.when(F.col("event") == "close", F.col("unreleased")).otherwise(F.concat("role", F.lit("|"), "text"))
    return events.select("event", F.sha2(F.encode(content, "UTF-8"), 256).alias("sha256"), "conv_id", "turn", "batch", "n_missing", "n_breaks")


def op13_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompression.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_quality_rules, op3_token_counts, op4_benchmark_decontamination, op5_quality_classifier,
        op6_warc, op7_suffix_array_dedup, op8_mixing, op9_license_scan, op10_ngram_jaccard_join,
        op11_filter_audit, op12_turn_reassembly, op13_recompression,
    )
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_ALNUM = r"list_filter(string_split_regex(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS x FROM d, unnest(range(1, len(w) - 6)) AS t(i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, unnest(range(0, 8)) AS t(k) GROUP BY r),
line AS (SELECT r, x FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS dups FROM line GROUP BY r),
c AS (SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.dups, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
f AS (SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines,
  word_chars < 3 * n_words OR word_chars > 12 * n_words AS odd_words FROM c),
h AS (SELECT source, unnest(['short', 'repeats', 'symbols', 'dup_lines', 'odd_words']) AS rule, count(*) AS n,
  unnest([count_if(short), count_if(repeats), count_if(symbols), count_if(dup_lines), count_if(odd_words)]) AS bad FROM f GROUP BY source),
p AS (SELECT rule, avg(bad / n) AS m, var_samp(bad / n) AS v FROM h GROUP BY rule),
q AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2), 1000) ELSE 1000 END AS k FROM p),
bad AS (SELECT source, max((bad + m * k) / (n + k)) > 0.6 AS host_rejected FROM h JOIN q USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short OR repeats) AS base_failed, host_rejected, NOT (short OR repeats) AND NOT host_rejected AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""

_BASE32 = " || ".join(
    f"substr('{warc.BASE32}', CAST((CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) >> {s}) & 31 AS BIGINT) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
_OP6 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM s
"""

_OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, 2 * n AS cap, 2 * n / weight AS room, row_number() OVER (ORDER BY 2 * n / weight, source NULLS LAST) AS k, 1.5 * sum(n) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
w AS (SELECT level AS water FROM l WHERE room > level ORDER BY k LIMIT 1),
t AS (SELECT source, n, CASE WHEN room <= water THEN cap ELSE weight * water END AS target FROM l, w),
g AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
m AS (SELECT d.*, g.n, g.target, g.whole, floor(g.target - g.whole * g.n) AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(h, 1, 3), h, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, CAST(whole * size + least(size, greatest(rest - before, 0)) AS BIGINT) AS taken FROM m
"""

_OP3 = rf"""
WITH d AS (SELECT source, lang, len({_WORDS}) AS s, len({_ALNUM}) AS a
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
SELECT source, lang, 'space-1' AS tokenizer, count(*) AS docs, CAST(sum(s) AS BIGINT) AS tokens FROM d GROUP BY ALL
UNION ALL SELECT source, lang, 'alnum-1', count(*), CAST(sum(a) AS BIGINT) FROM d GROUP BY ALL
"""

_OP11 = rf"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
least_ids AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(w) < 200 AS INT) AS a, CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) AS b,
  CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) AS c, CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d,
  CAST(coalesce(d.doc_id > m, false) AS INT) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d JOIN least_ids USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
z AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, n, good, toxic,
  list_transform(string_split(filter_order, ''), lambda y: CASE y WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM g, o, unnest(range(1, 6)) AS u(step)),
y AS (SELECT *, list_sum(fails[1:step - 1]) > 0 AS gone, fails[step] = 1 AS hit, list_sum(fails) AS n_fails FROM z),
r AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT coalesce(gone, false) AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT coalesce(gone, false) AND hit THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN coalesce(gone, false) AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT coalesce(gone, false) AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT coalesce(gone, false) AND hit THEN toxic ELSE 0 END) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""

_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS x FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
least_ids AS (SELECT x, min(doc_id) AS m FROM win GROUP BY x),
gone AS (SELECT DISTINCT r, i + k AS i FROM win JOIN least_ids USING (x), unnest(range(0, 50)) AS t(k) WHERE doc_id > m),
word AS (SELECT r, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS x, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

_OP12 = """
WITH d AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  CAST('0x' || substr(sha256(coalesce(CAST(conv_id AS VARCHAR), '') || ':' || CAST(turn AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM conversations WHERE turn IS NOT NULL),
c AS (SELECT conv_id, turn, h % 8 AS batch, role, text FROM d UNION ALL SELECT conv_id, turn, (h + 3) % 8, 'user', text FROM d WHERE h % 7 < 2),
a AS (SELECT conv_id, turn, batch, min({'payload': role || '|' || text, 'role': role}) AS p FROM c GROUP BY ALL),
b AS (SELECT conv_id, batch, coalesce(lead(batch) OVER (PARTITION BY conv_id ORDER BY batch), 99) AS next FROM (SELECT DISTINCT conv_id, batch FROM a)),
z AS (SELECT conv_id, min(least(batch + 3, 8)) AS closing FROM b WHERE next > batch + 3 GROUP BY conv_id),
k AS (SELECT a.conv_id, turn, min(batch) AS batch, arg_min(p, batch) AS p FROM a JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id WHERE batch <= closing GROUP BY ALL),
f AS (SELECT conv_id, min(turn) AS first FROM d GROUP BY conv_id),
r AS (SELECT k.conv_id, turn, p, first, max(batch) OVER w AS released, row_number() OVER w = turn - first + 1 AS gapless,
  coalesce(lag(turn) OVER w = turn - 1 AND lag(p.role) OVER w = p.role, false) AS breaks FROM k JOIN f ON k.conv_id IS NOT DISTINCT FROM f.conv_id WINDOW w AS (PARTITION BY k.conv_id ORDER BY turn)),
e AS (SELECT conv_id, max(turn) - min(first) + 1 - count(*) AS n_missing, count_if(breaks) AS n_breaks, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (NOT gapless) AS left_over FROM r GROUP BY conv_id)
SELECT 'release' AS event, sha256(p.payload) AS sha256, conv_id, turn, CAST(released AS BIGINT) AS batch, CAST(NULL AS BIGINT) AS n_missing, CAST(NULL AS BIGINT) AS n_breaks FROM r WHERE gapless
UNION ALL SELECT 'reject', sha256(p.payload), a.conv_id, turn, CAST(batch AS BIGINT), NULL, NULL FROM a JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id WHERE batch > closing
UNION ALL SELECT 'close', sha256(coalesce(left_over, '')), e.conv_id, -1, CAST(closing AS BIGINT), CAST(n_missing AS BIGINT), CAST(n_breaks AS BIGINT) FROM e JOIN z ON e.conv_id IS NOT DISTINCT FROM z.conv_id
"""

#: DuckDB SQL for the queries that SQL expresses.
ORACLES: dict[str, str] = {"op3_token_counts": _OP3, "op2_quality_rules": _OP2, "op6_warc": _OP6, "op8_mixing": _OP8, "op11_filter_audit": _OP11, "op12_turn_reassembly": _OP12, "op13_recompression": _OP13}
