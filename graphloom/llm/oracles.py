"""The queries that SQL can express, as SQL for DuckDB."""

from __future__ import annotations

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The smallest node that edges (x, y), given both ways, lead to.
REACH = "reach(a, b) AS (SELECT DISTINCT x, x FROM edges UNION SELECT a, y FROM reach JOIN edges ON x = b), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)"

SQL = {
    "op2_substring_dedup": f"""WITH docs AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
      windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
      later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS owner FROM windows) WHERE owner < doc_id),
      gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, unnest(range(13)) t(o)),
      places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
      kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
      SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)""",
    "op3_embedding_dedup": f"""WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
      edges AS (SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.98),
      {REACH}
      SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
      FROM embeddings LEFT JOIN (SELECT x, count(*) AS n FROM edges GROUP BY x) ON x = vec_id LEFT JOIN roots ON a = vec_id""",
    "op10_ngram_jaccard": f"""WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
      shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM docs WHERE len(w) > 0))),
      sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
      met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
      edges AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
      {REACH}
      SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON a = doc_id""",
}
