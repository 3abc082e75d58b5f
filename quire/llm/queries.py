"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import conversation_repair, hard_negatives, html, mixing, neardup, ngram_join, packing, pii, quality, search, substring_dedup, token_counts, urls
from ._base import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classified(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mined(rows, F.col("vec_id") % 100 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.checked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_top_k, op2_mix_sources, op3_html_extract, op4_quality_classifier, op5_ngram_jaccard_join, op6_embedding_near_dup, op7_url_filter, op8_token_counts, op9_best_fit_packing, op10_pii_spans, op11_substring_dedup, op12_hard_negatives, op13_conversation_repair)}

_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, [1.0::DOUBLE, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source
), filled AS (  -- sources by the level at which they are full: the level holds up to the first source that it does not fill
  SELECT *, (sum(s) OVER () - 3.0::DOUBLE * coalesce(sum(s) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl, 3.0::DOUBLE * s / w AS brim
  FROM sources WINDOW o AS (ORDER BY 3.0::DOUBLE * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, s, least(w * (SELECT arg_min(lvl, brim) FROM filled WHERE brim >= lvl), 3.0::DOUBLE * s) AS target FROM sources
), placed AS (
  SELECT d.*, p.s, p.target, CAST(floor(p.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, s AS source_size, target,
       CAST(CASE WHEN s = 0 THEN 0 ELSE budget // s * size + greatest(0, least(size, budget % s - before)) END AS BIGINT) AS taken
FROM placed
"""

_OP1 = r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, v.e)]) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

_OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM k JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)
), reach AS (SELECT x AS doc_id, y AS other FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) m USING (doc_id)
"""

#: The recall of an exact answer is 1; vectors that take no part have none.
_OP6 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding) AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), known AS (SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n, (SELECT min(y) FROM reach WHERE x = v.vec_id) AS low FROM v)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, CASE WHEN n IS NOT NULL THEN 1.0::DOUBLE END AS recall, coalesce(e.vec_id <= coalesce(low, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN known USING (vec_id)
"""

_OP7_ORDERS = "".join(
    f"""
, t{k} AS (SELECT substr(gram, {5 - k}) AS tail, sum(na) AS na, sum(nb) AS nb FROM counts GROUP BY tail)
, c{k} AS (SELECT left(tail, {k}) AS context, sum(na) AS alla, sum(nb) AS allb, count(*) FILTER (na > 0) AS kindsa, count(*) FILTER (nb > 0) AS kindsb FROM t{k} GROUP BY context)
, k{k} AS (SELECT tail, CASE WHEN alla > 0 THEN (na + kindsa * lessa) / (alla + kindsa) ELSE lessa END AS pa, CASE WHEN allb > 0 THEN (nb + kindsb * lessb) / (allb + kindsb) ELSE lessb END AS pb
  FROM (SELECT t.*, c.* EXCLUDE (context), {"u.pa AS lessa, u.pb AS lessb" if k else "1.0::DOUBLE / (SELECT count(*) FROM t0) AS lessa, 1.0::DOUBLE / (SELECT count(*) FROM t0) AS lessb"}
        FROM t{k} t JOIN c{k} c ON left(t.tail, {k}) = c.context {f"JOIN k{k - 1} u ON substr(t.tail, 2) = u.tail" if k else ""}))"""
    for k in range(5)
)
_OP7 = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages
), h AS (SELECT *, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM p
), s AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h
), r AS (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
  CAST('0x' || left(md5(u), 8) AS BIGINT) % 5 = 0 AS back FROM s
), f AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS fixed FROM r
), g AS (SELECT u, fixed, back, substr(repeat(chr(2), 4) || u || chr(3), i, 5) AS gram FROM (SELECT u, fixed, back, unnest(range(1, len(u) + 2)) AS i FROM f)
), counts AS (SELECT gram, count(*) FILTER (fixed = 'allow' AND NOT back) AS na, count(*) FILTER (fixed = 'block' AND NOT back) AS nb FROM g GROUP BY gram)
{_OP7_ORDERS}
, score AS (SELECT u, CAST(sum(CAST(round((ln(pa) - ln(pb)) * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000 AS score FROM g JOIN k4 ON gram = tail GROUP BY u
), bins AS (SELECT floor(score * 100 + 0.5) / 100 AS edge, count(*) FILTER (fixed = 'allow') AS a, count(*) FILTER (fixed = 'block') AS b FROM f JOIN score USING (u) WHERE back AND fixed IS NOT NULL GROUP BY 1
), gains AS (SELECT edge, coalesce(sum(b) OVER w, 0) / sum(b) OVER () - coalesce(sum(a) OVER w, 0) / sum(a) OVER () AS gain, sum(a) OVER () AS sa, sum(b) OVER () AS sb
  FROM bins WINDOW w AS (ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), best AS (SELECT edge - 0.005 AS least FROM gains WHERE sa > 0 AND sb > 0 ORDER BY gain DESC, abs(edge), edge LIMIT 1)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN score >= coalesce((SELECT least FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict FROM f LEFT JOIN score USING (u)
"""

_OP11 = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (SELECT r, doc_id, i, array_to_string(ws[i : i + 49], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), hits AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM windows) WHERE low < doc_id
), gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM hits
), kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""

_OP12 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.e, v.e)]) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e) WHERE a.vec_id % 100 = 0
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN scored USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""

#: CRC-32 by bytes of eight steps each, and the cheapest edits row by row: best holds a conversation's cheapest (cost, audit) for each state.
_OP13 = r"""
WITH RECURSIVE bits(n, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crcs AS (SELECT n, c FROM bits WHERE k = 8
), d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), names AS (SELECT DISTINCT name FROM d
), sums(name, i, c) AS (SELECT name, 1, 4294967295 FROM names UNION ALL SELECT name, i + 1, xor(s.c >> 8, t.c) FROM sums s JOIN crcs t ON t.n = xor(s.c & 255, ascii(name[i])) WHERE i <= len(name)
), how AS (SELECT name, xor(c, 4294967295) % 20 AS how FROM sums WHERE i = len(name) + 1
), e AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN how = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d JOIN how USING (name) WHERE how <> 0)
), o AS (
  SELECT *, row_number() OVER w AS i, coalesce(hash(conv_id), 0) AS c, conv_id IS NULL AS none, lag(left(role, 1)) OVER w || left(role, 1) AS pair FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM o
), counts AS (
  SELECT conv_id, any_value(c) AS c, any_value(none) AS none, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id
), steps(p, role, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), fills(p, q, cost, audit) AS (SELECT p, p, 0, '' FROM (VALUES (0), (1), (2), (3)) x(p) UNION ALL SELECT f.p, s.q, f.cost + 2, f.audit || 'I' FROM fills f JOIN steps s ON f.q = s.p AND s.role <> 's' WHERE f.cost < 4
), inserts AS (SELECT p, q, min({'cost': cost, 'audit': audit}) AS x FROM fills GROUP BY p, q
), edits AS (
  SELECT p, q, role, false AS faulty, 0 AS cost, 'K' AS edit FROM steps UNION ALL SELECT p, q, NULL, false, 2, 'R' FROM steps WHERE role <> 's' UNION ALL SELECT p, p, NULL, NULL, 3, 'D' FROM (VALUES (0), (1), (2), (3)) x(p)
), moves AS (SELECT e.p, i.q, role, faulty, {'cost': cost + i.x.cost, 'audit': edit || i.x.audit} AS x FROM edits e JOIN inserts i ON e.q = i.p
), best(c, none, i, p, x) AS (
  SELECT c, none, CAST(0 AS BIGINT), q, x FROM counts, inserts WHERE p = 0
  UNION ALL
  SELECT b.c, b.none, b.i + 1, m.q, min({'cost': b.x.cost + m.x.cost + CASE WHEN fault = 't' AND m.faulty IS NOT NULL THEN 1 ELSE 0 END, 'audit': b.x.audit || m.x.audit})
  FROM best b JOIN f ON f.c = b.c AND f.none = b.none AND f.i = b.i + 1 JOIN moves m ON m.p = b.p AND (m.role IS NULL OR m.role = left(f.role, 1)) AND (m.faulty IS NULL OR f.fault NOT IN ('b', 'd'))
  GROUP BY b.c, b.none, b.i, m.q
), chosen AS (SELECT n.*, min(b.x) AS x FROM counts n JOIN best b ON b.c = n.c AND b.none = n.none AND b.i = n.n AND b.p IN (0, 3) GROUP BY ALL
), letters AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS place FROM (SELECT *, audit[k] AS edit FROM (SELECT c, none, x.audit AS audit, len(replace(x.audit, 'D', '')) % 2 AS odd, unnest(range(1, len(x.audit) + 1)) AS k FROM chosen))
  WINDOW w AS (PARTITION BY c, none ORDER BY k)
), texts AS (
  SELECT l.c, l.none, string_agg(CASE WHEN edit = 'K' THEN f.role ELSE CASE WHEN (place + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS t
  FROM letters l JOIN f ON f.c = l.c AND f.none = l.none AND f.i = greatest(l.i, 1) WHERE edit <> 'D' GROUP BY ALL
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(x.cost, 0) AS BIGINT) AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN chosen h ON a.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN texts t ON t.c = h.c AND t.none = h.none
"""

SQL: dict[str, str] = {"op6_embedding_near_dup": _OP6, "op7_url_filter": _OP7, "op5_ngram_jaccard_join": _OP5, "op1_exact_top_k": _OP1, "op2_mix_sources": _OP2, "op11_substring_dedup": _OP11, "op12_hard_negatives": _OP12, "op13_conversation_repair": _OP13}
