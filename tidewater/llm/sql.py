"""DuckDB SQL for the contract queries that SQL can express; the rest are held against brute force in tests/llm."""

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS newest FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM q
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || chr(31) || 'mix'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
         / round(1.1::DOUBLE - (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[!-@\[-`{-~]', '', 'g')))::DOUBLE / greatest(length(coalesce(text, '')), 1), 3) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
-- a source whose cap lies below its share at the level of all that are not yet capped is capped
l AS (SELECT *, cap / w AS stop FROM w),
r AS (SELECT a.source, a.stop, (a.total - coalesce(sum(b.cap) FILTER (b.stop < a.stop), 0)) / sum(b.w) FILTER (b.stop >= a.stop) AS level
      FROM l a CROSS JOIN l b GROUP BY a.source, a.stop, a.total),
rate AS (SELECT arg_min(level, stop) AS rate FROM r WHERE level < stop),
t AS (SELECT source, source_size, CASE WHEN rate IS NULL THEN cap ELSE least(cap, rate * w) END AS target FROM l CROSS JOIN rate),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
x AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN before + size / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""

DECONTAMINATION = f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {WORDS} AS w FROM benchmark),
g AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM g)),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
runs AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS words
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, k, n, item_id FROM runs JOIN windows USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

EMBEDDING_DUPS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
links AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
          WHERE a.usable AND b.usable AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least ON least.a = v.r LEFT JOIN n ON n.a = v.r
"""

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT count(*)::BIGINT AS all_docs, sum(len(w))::BIGINT AS all_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT *, unnest(w) AS term FROM d) GROUP BY r, doc_id, w, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                                    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_terms))))::BIGINT AS score
      FROM i JOIN df USING (term) JOIN p USING (term) CROSS JOIN g GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.e, v.e)::BIGINT AS score
      FROM v a JOIN v ON v.vec_id <> a.vec_id AND len(v.e) = len(a.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ORACLE = {"op13_hard_negatives": NEGATIVES, "op12_ranked_search": RANKED, "op11_embedding_dups": EMBEDDING_DUPS, "op4_warc": WARC, "op7_mixing": MIXING, "op8_decontaminate": DECONTAMINATION}
