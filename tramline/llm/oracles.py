"""SQL for the queries that SQL can express over whole tables in reasonable time."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), {WORDS}) AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, UNNEST(range(1, GREATEST(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
  n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  reach(d, r) AS (SELECT a, a FROM e UNION SELECT reach.d, e.b FROM reach JOIN e ON reach.r = e.a)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(MIN(r.r), d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.d = d.doc_id GROUP BY d.doc_id, n.n"""

OP5 = f"""WITH t AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), {WORDS}) AS w FROM documents),
  g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
  m AS (SELECT doc_id, i FROM (SELECT *, MIN(doc_id) OVER (PARTITION BY k) AS least FROM g) WHERE least < doc_id), c AS (SELECT DISTINCT doc_id, UNNEST(range(i, i + 13)) AS j FROM m),
  p AS (SELECT doc_id, UNNEST(range(1, len(w) + 1)) AS j, UNNEST(w) AS x FROM t), k AS (SELECT p.doc_id, COUNT(c.j) AS n_removed, string_agg(CASE WHEN c.j IS NULL THEN x END, ' ' ORDER BY p.j) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.j = p.j GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id"""

OP6 = """SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 AND w <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND w <> page_id THEN w END AS refers_to FROM (SELECT page_id, COALESCE(html, '') AS h, MAX(page_id) OVER (PARTITION BY COALESCE(html, '')) AS w FROM pages)"""

OP9 = """WITH d AS (SELECT vec_id, UNNEST(range(1, len(embedding) + 1)) AS i, CAST(floor(256 * CAST(UNNEST(embedding) AS DOUBLE)) AS BIGINT) AS v FROM embeddings),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(SUM(a.v * b.v) AS BIGINT) AS score FROM d a JOIN d b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
  r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

PROBE = "</s>[INST] ok [/INST]"
OP10 = rf"""WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS r, COALESCE(text, '') AS t FROM conversations UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
  f AS (SELECT *, r || chr(10) || t || chr(10) AS said, CASE WHEN r = 'assistant' THEN t ELSE '' END AS learned, 17 + length(r) + length(replace(replace(t, '\', '\\'), '<|', '<\|')) AS n FROM c)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(said, '' ORDER BY turn, r, t)) AS turns_sha256, CAST(SUM(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn, r, t)) AS loss_sha256, CAST(SUM(n) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id"""

SQL = {"op1_ngram_jaccard": OP1, "op5_substring_dedup": OP5, "op6_warc": OP6, "op9_exact_topk": OP9, "op10_chat_format": OP10}
