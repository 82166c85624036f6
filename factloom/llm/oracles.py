"""DuckDB SQL with the same rows as the opN queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

OP5 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_SPACED}') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS w FROM documents
), i AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda k: w[k:k + 12])) AS g FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM p
), spots AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes
), hit AS (
  SELECT doc_id, item_id, k, spots.n FROM spots JOIN p ON spots.n = p.n AND array_to_string(w[k:k + spots.n - 1], ' ') = p.g
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (SELECT page_id, strlen(html)::BIGINT AS n, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first FROM p
), d AS (
  SELECT page_id, n, first, string_agg(translate(to_base(('0x' || x[k:k + 9])::BIGINT, 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), '' ORDER BY k) AS digest
  FROM h, (SELECT unnest([1, 11, 21, 31]) AS k) GROUP BY ALL
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

_DIGESTS = "string_agg({0}, '' ORDER BY {1})"
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"
_TREE = """
{0}n AS (
  SELECT *, 0 AS level FROM {0}0
  UNION ALL
  SELECT tree, idx // 16, sha256(string_agg(node, '' ORDER BY idx)), max(n + 15) // 16, max(level) + 1 FROM {0}n WHERE n > 1 GROUP BY tree, idx // 16
), {0}r AS (SELECT tree, level, idx // 16 AS run, list(node ORDER BY idx) AS nodes FROM {0}n WHERE n > 1 GROUP BY ALL
), {0}p AS (
  SELECT tree, idx AS of, idx, 0 AS level, n, []::VARCHAR[] AS lefts, []::VARCHAR[] AS rights FROM {0}0
  UNION ALL
  SELECT p.tree, p.of, p.idx // 16, p.level + 1, (p.n + 15) // 16, list_append(p.lefts, array_to_string(r.nodes[1:p.idx % 16], '')), list_append(p.rights, array_to_string(r.nodes[p.idx % 16 + 2:], ''))
  FROM {0}p p JOIN {0}r r ON r.tree = p.tree AND r.level = p.level AND r.run = p.idx // 16 WHERE p.n > 1
), {0}t AS (SELECT tree, node FROM {0}n WHERE n = 1
), {0}q AS (SELECT tree, of, lefts, rights FROM {0}p WHERE n = 1
)"""

OP13 = f"""
WITH RECURSIVE c AS (SELECT {_CRC_TABLE} AS tab
), d AS (
  SELECT doc_id, source, {" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 5 = 0 AS marked
  FROM documents, c
), h AS (
  SELECT doc_id, source, sha256(head || {_FIELD.format("text")}) AS leaf,
    CASE WHEN marked THEN sha256(head || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed FROM d
), g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM h
), own_0 AS (SELECT tree, idx, leaf AS node, n FROM g),{_TREE.format("own_")}, over_0 AS (SELECT 0 AS tree, tree AS idx, node, count(*) OVER () AS n FROM own_t),{_TREE.format("over_")}, w AS (
  SELECT g.doc_id, g.leaf, own_t.node AS subroot, over_t.node AS root, coalesce(g.changed, g.leaf) AS start, own_q.lefts || over_q.lefts AS lefts, own_q.rights || over_q.rights AS rights
  FROM g JOIN own_t USING (tree) JOIN own_q ON own_q.tree = g.tree AND own_q.of = g.idx JOIN over_q ON over_q.of = g.tree, over_t
), f AS (
  SELECT *, list_reduce(range(1, len(lefts) + 1), lambda x, k: sha256(lefts[k] || x || rights[k]), start) AS folded_root FROM w
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(range(1, len(lefts) + 1), lambda k: lefts[k] || rights[k]), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM f
"""
