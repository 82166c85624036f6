"""DuckDB SQL with the same rows as the queries of the core catalog."""

from __future__ import annotations

AS_OF = "DATE '2001-06-01'"
FAR = "DATE '9999-12-31'"

_EDITIONS = """
ed AS (SELECT DISTINCT l_suppkey AS s, year(l_shipdate) AS y FROM lineitem),
kdoc AS (
  SELECT s * 10000 + y AS doc_id, CASE WHEN s % 2 = 0 THEN s END AS group_id,
    CASE WHEN s % 2 = 0 THEN lag(s * 10000 + y) OVER (PARTITION BY s ORDER BY y) END AS prev_id,
    CASE s % 3 WHEN 0 THEN 'pricing' WHEN 1 THEN 'policy' ELSE 'crm' END AS source_type,
    (s % 20 + 80) / 100.0::DOUBLE AS authority, make_date(y, 12, 31) AS parsed_at FROM ed),
succ AS (SELECT prev_id AS doc_id, min(doc_id) AS new_id FROM kdoc WHERE prev_id IN (SELECT doc_id FROM kdoc) GROUP BY 1),
dead AS (SELECT DISTINCT prev_id AS doc_id FROM kdoc WHERE prev_id IS NOT NULL),
head AS (SELECT group_id, min(doc_id) AS head_id FROM kdoc WHERE group_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM dead) GROUP BY 1 HAVING count(*) = 1)
"""
_FACTS = """
kfact AS (
  SELECT sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT,
      round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, l_returnflag, l_linestatus, l_shipdate::DATE)) AS fact_id,
    l_partkey AS subject_id, 'Qty_' || l_returnflag AS predicate, lower('Qty_' || l_returnflag) AS pred_fold, l_quantity AS num,
    'scalar|number|' || CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS canon,
    CASE WHEN l_linestatus = 'O' THEN 'box' ELSE 'unit' END AS dim, l_suppkey * 10000 + year(l_shipdate) AS doc_id,
    l_shipdate::DATE AS valid_from, CASE WHEN round(l_discount * 100) >= 5 THEN l_shipdate::DATE + 730 END AS valid_to,
    CASE l_linenumber % 3 WHEN 0 THEN 'quoted' WHEN 1 THEN 'document_scope' END AS anchor FROM lineitem)
"""
_STATEMENTS = """
stmt AS (SELECT 'statement-' || doc_id AS fact_id, doc_id, source_type, make_date((doc_id % 10000 + 1)::INT, 6, 30) AS valid_to, doc_id % 4 AS kind FROM kdoc)
"""
_SEVERITY = "CASE {0} WHEN 'pricing' THEN 'critical' WHEN 'policy' THEN 'medium' END"
_RANK = "CASE {0} WHEN 'pricing' THEN 4 WHEN 'policy' THEN 2 ELSE 0 END"

_CONFLICT = f"""
live AS (SELECT f.*, d.source_type, d.authority FROM kfact f JOIN kdoc d USING (doc_id)
  WHERE NOT coalesce(valid_to < {AS_OF}, false) AND doc_id NOT IN (SELECT doc_id FROM dead)),
raw AS (SELECT a AS a, b AS b, coalesce(a.valid_from, {FAR}) <= coalesce(b.valid_from, {FAR}) AS a_first FROM live a JOIN live b
  ON a.subject_id = b.subject_id AND a.pred_fold = b.pred_fold AND a.fact_id < b.fact_id AND a.doc_id <> b.doc_id AND a.canon <> b.canon
  AND coalesce(a.valid_to >= b.valid_from, true) AND coalesce(b.valid_to >= a.valid_from, true)),
pair AS (SELECT CASE WHEN a_first THEN a ELSE b END AS o, CASE WHEN a_first THEN b ELSE a END AS n FROM raw),
conflict AS (SELECT 'conflict' AS drift_type, o.subject_id AS subject_id, o.predicate AS predicate, o.fact_id AS old_fact_id, n.fact_id AS new_fact_id,
  o.canon AS old_value, n.canon AS new_value,
  CASE greatest(3, {_RANK.format("o.source_type")}, {_RANK.format("n.source_type")}) WHEN 4 THEN 'critical' ELSE 'high' END AS severity,
  round(least(o.authority, n.authority, 0.95), 2) AS confidence, n.valid_from::TIMESTAMP + INTERVAL 12 HOUR AS effective_at,
  sha256('["conflict","' || o.subject_id || '","' || lower(o.predicate) || '","' || least(o.fact_id, n.fact_id) || '","' || greatest(o.fact_id, n.fact_id) || '"]') AS fingerprint
  FROM pair)
"""
_SUPERSEDED = f"""
superseded AS (SELECT 'superseded' AS drift_type, d.doc_id AS old_document_id, new_id AS new_document_id, d.group_id,
  coalesce({_SEVERITY.format("d.source_type")}, 'medium') AS severity, 0.95::DOUBLE AS confidence, n.parsed_at::TIMESTAMP + INTERVAL 12 HOUR AS effective_at,
  sha256('["superseded","' || d.doc_id || '","' || new_id || '"]') AS fingerprint
  FROM kdoc d JOIN succ USING (doc_id) JOIN kdoc n ON n.doc_id = new_id)
"""
_STALE = f"""
flags AS (SELECT f.*, d.source_type, new_id, s.doc_id IS NOT NULL AS replaced, coalesce(valid_to < {AS_OF}, false) AS expired,
    n.parsed_at AS new_parsed, {AS_OF} - valid_from AS days, d.group_id
  FROM kfact f JOIN kdoc d USING (doc_id) LEFT JOIN succ s USING (doc_id) LEFT JOIN kdoc n ON n.doc_id = new_id),
ladder AS (SELECT *, expired AND (anchor IS NULL OR anchor = 'quoted') AS trusted, expired AND coalesce(anchor = 'document_scope', false) AS inferred,
    days > CASE source_type WHEN 'pricing' THEN 90 ELSE 365 END AND NOT (valid_to IS NULL AND ((group_id IS NOT NULL AND NOT replaced)
      OR (source_type = 'pricing' AND valid_from = DATE '2001-01-01'))) AS aged FROM flags),
kinds AS (SELECT *, CASE WHEN trusted OR replaced THEN 'confirmed_stale' WHEN inferred OR aged THEN 'possibly_stale' END AS drift_type,
    CASE WHEN trusted OR replaced THEN concat_ws('+', CASE WHEN trusted THEN 'valid_to_expired' END, CASE WHEN replaced THEN 'superseding_source' END)
      WHEN inferred THEN 'inferred_validity_expired' WHEN aged THEN 'age_over_threshold' END AS reason FROM ladder),
stale AS (SELECT drift_type, fact_id, subject_id, doc_id, new_id AS new_document_id, reason,
    CASE WHEN drift_type = 'confirmed_stale' THEN coalesce({_SEVERITY.format("source_type")}, 'medium') ELSE 'warning' END AS severity,
    CASE WHEN drift_type = 'confirmed_stale' THEN 0.95 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN reason = 'age_over_threshold' THEN days END AS age_days,
    CASE WHEN expired THEN valid_to::TIMESTAMP + INTERVAL 12 HOUR WHEN replaced THEN new_parsed::TIMESTAMP + INTERVAL 12 HOUR END AS effective_at,
    sha256('["' || drift_type || '","' || fact_id || '"]') AS fingerprint FROM kinds WHERE drift_type IS NOT NULL)
"""
_DISTANCE = """
steps(head_id, doc_id, distance) AS (SELECT doc_id, prev_id, 1 FROM kdoc WHERE prev_id IS NOT NULL AND doc_id IN (SELECT head_id FROM head)
  UNION ALL SELECT head_id, d.prev_id, distance + 1 FROM steps JOIN kdoc d ON d.doc_id = steps.doc_id WHERE d.prev_id IS NOT NULL)
"""
_REUSED = f"""
x AS (SELECT f.*, d.source_type, d.group_id, f.doc_id IN (SELECT doc_id FROM dead) AS replaced FROM kfact f JOIN kdoc d USING (doc_id)),
restated AS (SELECT doc_id AS head_id, subject_id, dim, min(fact_id) AS head_fact, min_by(num, fact_id) AS head_value FROM x WHERE NOT replaced GROUP BY ALL),
old AS (SELECT x.subject_id, x.num, x.dim, x.doc_id AS old_doc, x.fact_id AS old_fact, h.head_id, distance, r.head_fact, r.head_value FROM x JOIN head h USING (group_id)
  JOIN steps s ON s.head_id = h.head_id AND s.doc_id = x.doc_id JOIN restated r ON r.head_id = h.head_id AND r.subject_id = x.subject_id AND r.dim = x.dim
  WHERE x.replaced AND NOT EXISTS (SELECT 1 FROM x y WHERE NOT y.replaced AND y.doc_id = h.head_id AND y.subject_id = x.subject_id AND y.dim = x.dim AND y.num = x.num)),
hit AS (SELECT c.fact_id, c.subject_id, c.doc_id, c.source_type, c.valid_from, o.*, row_number() OVER (PARTITION BY c.fact_id ORDER BY distance, old_fact) AS k FROM x c JOIN old o
  ON c.subject_id = o.subject_id AND c.num = o.num AND c.dim = o.dim AND c.doc_id <> o.old_doc
  WHERE NOT c.replaced AND NOT coalesce(c.valid_to < {AS_OF}, false) AND c.valid_from <= {AS_OF}),
reused AS (SELECT 'reused_stale_value' AS drift_type, fact_id, subject_id, doc_id, old_doc AS old_document_id, head_id AS new_document_id, head_fact AS new_fact_id,
  num AS reused_value, head_value, distance, coalesce({_SEVERITY.format("source_type")}, 'high') AS severity, valid_from::TIMESTAMP + INTERVAL 12 HOUR AS effective_at,
  sha256('["reused_stale_value","' || fact_id || '"]') AS fingerprint FROM hit WHERE k = 1)
"""
_ENTITY = """
efact AS (SELECT p_partkey AS subject_id, 'brand' AS p, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part
  UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part UNION ALL SELECT p_partkey, 'price', round(p_retailprice * 100)::BIGINT::VARCHAR FROM part),
hold AS (SELECT p, v, count(DISTINCT subject_id) AS holders FROM efact GROUP BY 1, 2),
shared AS (SELECT a.subject_id AS a, b.subject_id AS b, count(*) AS shared, min(holders) AS least FROM efact a JOIN efact b
  ON a.p = b.p AND a.v = b.v AND a.subject_id < b.subject_id JOIN hold h ON h.p = a.p AND h.v = a.v GROUP BY 1, 2 HAVING count(*) >= 2 OR min(holders) = 2)
"""


_OWN = "own AS (SELECT f.* FROM kfact f JOIN kdoc d USING (doc_id) WHERE d.source_type = 'pricing')"
#: Which of two quantity predicates of a part are one attribute: those whose unit most of them have.
_BINDINGS = f"""{_OWN},
dims AS (SELECT DISTINCT subject_id, pred_fold, dim FROM own WHERE pred_fold IN ('qty_a', 'qty_n')),
both_known AS (SELECT subject_id FROM dims GROUP BY 1 HAVING count(DISTINCT pred_fold) = 2),
votes AS (SELECT subject_id, dim, count(*) AS votes FROM dims WHERE subject_id IN (SELECT subject_id FROM both_known) GROUP BY 1, 2),
chosen AS (SELECT subject_id, pred_fold, arg_min(dim, (-votes, dim)) AS dim, count(*) AS dims FROM dims JOIN votes USING (subject_id, dim) GROUP BY 1, 2),
bound AS (SELECT subject_id, pred_fold, dim, 'measure|' || dim || '|quantity' AS canonical_key, pred_fold = 'qty_a' AND dims = 1 AS trusted FROM (SELECT *, count(*) OVER (PARTITION BY subject_id, dim) AS size FROM chosen) WHERE size > 1)
"""
_GATED = f"""
live AS (SELECT f.*, d.source_type FROM kfact f JOIN kdoc d USING (doc_id) WHERE NOT coalesce(valid_to < {AS_OF}, false) AND doc_id NOT IN (SELECT doc_id FROM dead)),
raw AS (SELECT a AS a, b AS b, (a.valid_from, a.fact_id) <= (b.valid_from, b.fact_id) AS a_first FROM live a JOIN live b ON a.subject_id = b.subject_id AND {{predicate}} AND a.doc_id <> b.doc_id
  AND coalesce(a.valid_to >= b.valid_from, true) AND coalesce(b.valid_to >= a.valid_from, true)),
pair AS (SELECT CASE WHEN a_first THEN a ELSE b END AS o, CASE WHEN a_first THEN b ELSE a END AS n FROM raw)
"""
_NAMES = r"""
nm AS (SELECT p_partkey AS id, p_name AS name FROM part),
rec AS (SELECT id, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS norm, list_distinct(list_filter(string_split_regex(lower(trim(name)), '[\s_\-/，,、()（）]+'), lambda t: t <> '')) AS t FROM nm)
"""
_RECALL = "vec AS (SELECT p_partkey AS id, embedding::DOUBLE[] AS e FROM part LEFT JOIN embeddings ON vec_id = p_partkey)"
_NAME_RECALL = """CASE WHEN {x}.norm = {y}.norm THEN 'exact_normalized_name'
  WHEN least(len({x}.t), len({y}.t)) > 0 AND len(list_intersect({x}.t, {y}.t)) = least(len({x}.t), len({y}.t)) AND list_sum(list_transform(CASE WHEN len({x}.t) <= len({y}.t) THEN {x}.t ELSE {y}.t END, lambda t: len(t))) >= 4 THEN 'name_token_containment'
  WHEN len(list_intersect({x}.t, {y}.t)) / len(list_distinct(list_concat({x}.t, {y}.t))) >= 0.6 THEN 'name_token_overlap' END"""
_DECIDED = "judged AS (SELECT *, ('0x' || fingerprint[1:2])::INT AS k FROM conflict)"
_SUITE = "WITH x AS (SELECT quality = 0 AS bad, n_chars < 600 AS short, lang = 'de' AS german, CASE WHEN quality = 0 THEN 'positive' WHEN lang = 'en' THEN 'ambiguous_negative' ELSE 'negative' END AS category FROM documents JOIN labels USING (doc_id))"
_RATIO = "CASE WHEN {1} = 0 THEN 0.0 ELSE ({0}) / ({1}) END::DOUBLE"
_TAX = "CASE WHEN round(l_tax * 100) < 3 THEN 'inclusive' WHEN round(l_tax * 100) < 5 THEN 'exclusive' WHEN round(l_tax * 100) < 7 THEN 'unknown' END"
_TAX_VERDICT = "CASE WHEN x.t IS NULL AND y.t IS NULL THEN 'stated' WHEN x.t IS NULL OR y.t IS NULL OR x.t = 'unknown' OR y.t = 'unknown' THEN 'missing' WHEN x.t = y.t THEN 'consistent' ELSE 'conflict' END"
_SPACE = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOKEN = r"[一-鿿]|[A-Za-z0-9]+(?:\.[0-9]+)*"
_ODD = "chr(13) || chr(10) || ' ' || chr(12288) || replace(text, chr(10), '  ' || chr(13) || chr(10) || chr(9)) || chr(13) || chr(13) || 'cafe' || chr(769) || ' ' || chr(160)"
_STRIPPED = "regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(nfc_normalize({0}), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^" + _SPACE.replace("{", "{{").replace("}", "}}") + "+', ''), '" + _SPACE.replace("{", "{{").replace("}", "}}") + "+$', '')), chr(10)), '^\\n+', ''), '\\n+$', '')"
_NORMAL = _STRIPPED
_PARAGRAPHS = "list_filter(string_split_regex(" + _STRIPPED.format("text") + ", '\\n\\n+'), lambda t: t <> '')"
_FULL = r"[^\n]*[^\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][^\n]*"
_LINES = f"(?m)^{_FULL}(?:\\n{_FULL})*"
_FILES = """
f0 AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a/' ELSE 'b/' END || 's' || (doc_id // 10000) || '_' || (doc_id % 10000) || '.csv' AS path, 's' || (doc_id // 10000) || '_' || (doc_id % 10000) || '.csv' AS filename, doc_id FROM kdoc),
fd AS (SELECT path, filename, doc_id FROM f0 UNION ALL SELECT 'c/' || filename, filename, doc_id + 1000000000 FROM f0 WHERE doc_id % 7 = 0),
fm AS (SELECT 'g' || (x.doc_id // 10000) AS "group", x.doc_id::VARCHAR AS label, CASE x.doc_id % 3 WHEN 0 THEN x.path WHEN 1 THEN x.filename ELSE 'z/' || x.filename END AS path, o.filename AS supersedes FROM f0 x LEFT JOIN f0 o ON o.doc_id = x.doc_id + 1),
fb AS (SELECT filename, min(doc_id) AS id, count(*) AS n FROM fd GROUP BY 1),
linked AS (SELECT "group", label, fm.path, supersedes, coalesce(e.doc_id, CASE WHEN b.n = 1 THEN b.id END) AS doc_id, CASE WHEN e.doc_id IS NULL AND b.n > 1 THEN 'ambiguous' WHEN e.doc_id IS NULL AND b.n IS NULL THEN 'missing' END AS warning,
  CASE WHEN p.n = 1 THEN p.id END AS prev_id, CASE WHEN supersedes IS NOT NULL AND p.n > 1 THEN 'ambiguous' WHEN supersedes IS NOT NULL AND p.n IS NULL THEN 'missing' END AS prev_warning
  FROM fm LEFT JOIN fd e ON e.path = fm.path LEFT JOIN fb b ON b.filename = regexp_replace(fm.path, '^.*/', '') LEFT JOIN fb p ON p.filename = supersedes)
"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts)


_BASE = _with(_EDITIONS, _FACTS)
_IMPACT = "CASE severity WHEN 'warning' THEN 'low' ELSE severity END"
_KNOWN = "known AS (SELECT fingerprint FROM conflict  WHERE severity = 'critical')"
_LOG = """
status AS (SELECT *, CASE WHEN fingerprint[1] BETWEEN '5' AND '9' THEN 'resolved' WHEN fingerprint[1] <= '4' THEN 'ignored' ELSE 'open' END AS status,
  CASE WHEN fingerprint[1] BETWEEN '5' AND '9' THEN 'accept_newer' END AS decision FROM superseded)
"""
_TOKENS = r"regexp_extract_all({0}, '[一-鿿]|[A-Za-z0-9]+(?:\.[0-9]+)*')"

ORACLES = {
    "conflict_pairs": f"{_BASE}, {_CONFLICT} SELECT subject_id, old_fact_id, new_fact_id, old_value, new_value FROM conflict",
    "conflict_scored": f"{_BASE}, {_CONFLICT} SELECT *, {_IMPACT} AS ai_impact_level FROM conflict",
    "conflict_multi_valued_excluded": f"{_BASE}, {_CONFLICT} SELECT *, {_IMPACT} AS ai_impact_level FROM conflict WHERE lower(predicate) <> 'qty_r'",
    "superseded_docs": f"{_with(_EDITIONS, _SUPERSEDED)} SELECT * FROM superseded",
    "chain_components": f"{_with(_EDITIONS)} SELECT doc_id, CASE WHEN group_id IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY group_id) END AS chain FROM kdoc",
    "chain_heads": f"{_with(_EDITIONS)} SELECT * FROM head",
    "chain_distance": f"{_with(_EDITIONS, _DISTANCE, recursive=True)} SELECT * FROM steps",
    "confirmed_stale": f"{_BASE}, {_STALE} SELECT * FROM stale WHERE drift_type = 'confirmed_stale'",
    "possibly_stale_inferred": f"{_BASE}, {_STALE} SELECT * FROM stale WHERE reason = 'inferred_validity_expired'",
    "possibly_stale_age": f"{_BASE}, {_STALE} SELECT * FROM stale WHERE reason = 'age_over_threshold'",
    "document_self_declared_expired": f"{_with(_EDITIONS, _STATEMENTS)} SELECT 'confirmed_stale' AS drift_type, doc_id, fact_id, coalesce({_SEVERITY.format('source_type')}, 'medium') AS severity, valid_to::TIMESTAMP + INTERVAL 12 HOUR AS effective_at, sha256('[\"confirmed_stale\",\"document\",\"' || doc_id || '\"]') AS fingerprint FROM stmt WHERE kind IN (0, 1) AND valid_to < {AS_OF} AND doc_id NOT IN (SELECT doc_id FROM dead)",
    "age_suppression": f"""{_BASE}, {_STALE} SELECT fact_id, days AS age_days, CASE WHEN group_id IS NOT NULL AND NOT replaced THEN 'current_edition' ELSE 'annual_rate' END AS suppressed_by FROM flags
      WHERE valid_to IS NULL AND days > CASE source_type WHEN 'pricing' THEN 90 ELSE 365 END AND ((group_id IS NOT NULL AND NOT replaced) OR (source_type = 'pricing' AND valid_from = DATE '2001-01-01'))""",
    "reused_stale_value": f"{_with(_EDITIONS, _FACTS, _DISTANCE, _REUSED, recursive=True)} SELECT * FROM reused",
    "holders_df": f"{_with(_ENTITY)} SELECT p AS pred_fold, 'scalar|' || v AS canon_object, holders FROM hold",
    "shared_fact_pairs": f"{_with(_ENTITY)} SELECT a, b, shared::INTEGER AS shared FROM shared",
    "duplicate_findings": f"{_with(_ENTITY)} SELECT 'duplicate' AS drift_type, a, b, shared::INTEGER AS shared, 'exact_normalized_name' AS recall, 'warning' AS severity, 0.95::DOUBLE AS confidence FROM shared JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b WHERE lower(x.p_name) = lower(y.p_name)",
    "duplicate_findings_all_recall": f"""{_with(_ENTITY, _NAMES, _RECALL)}, c AS (SELECT a, b, shared, {_NAME_RECALL.format(x='x', y='y')} AS by_name, ex, ey FROM shared JOIN rec x ON x.id = a JOIN rec y ON y.id = b JOIN (SELECT id AS ia, e AS ex FROM vec) ON ia = a JOIN (SELECT id AS ib, e AS ey FROM vec) ON ib = b),
      r AS (SELECT *, coalesce(by_name, CASE WHEN list_cosine_similarity(ex, ey) >= 0.3 THEN 'embedding_similarity' END) AS recall FROM c)
      SELECT 'duplicate' AS drift_type, a, b, shared::INTEGER AS shared, recall, 'warning' AS severity, CASE recall WHEN 'exact_normalized_name' THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence FROM r WHERE recall IS NOT NULL""",
    "name_recall": f"""WITH part_names AS (SELECT p_name AS id, p_name AS name FROM part UNION SELECT p_name || '-' || p_type || ' (Plan)', p_name || '-' || p_type || ' (Plan)' FROM part), {_NAMES.replace('SELECT p_partkey AS id, p_name AS name FROM part', 'SELECT id, name FROM part_names')},
      p AS (SELECT x.id AS a, y.id AS b, {_NAME_RECALL.format(x='x', y='y')} AS recall FROM rec x JOIN rec y ON x.id < y.id) SELECT * FROM p WHERE recall IS NOT NULL""",
    "cosine_recall": f"{_with(_ENTITY, _RECALL)} SELECT a, b FROM shared JOIN vec x ON x.id = a JOIN vec y ON y.id = b WHERE list_cosine_similarity(x.e, y.e) >= 0.3",
    "fingerprint": "SELECT doc_id, sha256(to_json(['conflict', doc_id::VARCHAR, substr(text, 1, 60)])) AS fingerprint FROM documents",
    "known_suppression": f"{_BASE}, {_CONFLICT}, {_KNOWN} SELECT subject_id, count(*) AS new_findings FROM conflict WHERE fingerprint NOT IN (SELECT fingerprint FROM known) GROUP BY 1",
    "second_scan_zero": f"""{_BASE}, {_STALE}, {_STALE.replace(AS_OF, "DATE '2000-06-01'").replace('2001-01-01', '2000-01-01').replace('flags', 'flags0').replace('ladder', 'ladder0').replace('kinds', 'kinds0').replace('stale AS', 'stale0 AS')}
      SELECT drift_type, count(*) AS new_findings FROM stale WHERE fingerprint NOT IN (SELECT fingerprint FROM stale0) GROUP BY 1""",
    "decision_authority": f"""{_BASE}, {_CONFLICT}, {_DECIDED} SELECT fingerprint, CASE WHEN k < 100 OR k BETWEEN 140 AND 169 THEN 'resolved' WHEN k < 140 THEN 'ignored' ELSE 'open' END AS status,
      CASE WHEN k < 60 THEN 'accept_newer' WHEN k < 100 THEN 'keep_old' WHEN k BETWEEN 140 AND 169 THEN 'manual_override' END AS decision,
      CASE WHEN k < 60 THEN new_fact_id WHEN k < 100 THEN old_fact_id WHEN k BETWEEN 140 AND 169 THEN old_fact_id END AS authority_fact FROM judged""",
    "decision_problems": f"""{_BASE}, {_CONFLICT}, {_DECIDED}, e AS (
      SELECT fingerprint, 1::BIGINT AS at, 'resolve' AS action, NULL AS problem FROM judged WHERE k < 60 UNION ALL SELECT fingerprint, 2, 'ignore', 'already_resolved' FROM judged WHERE k < 100
      UNION ALL SELECT fingerprint, 1, 'resolve', NULL FROM judged WHERE k BETWEEN 60 AND 99
      UNION ALL SELECT fingerprint, 1, 'ignore', NULL FROM judged WHERE k BETWEEN 100 AND 139 UNION ALL SELECT fingerprint, 2, 'resolve', 'already_ignored' FROM judged WHERE k BETWEEN 100 AND 139 UNION ALL SELECT fingerprint, 3, 'ignore', 'repeated' FROM judged WHERE k BETWEEN 100 AND 139
      UNION ALL SELECT fingerprint, 1, 'resolve', 'unknown_decision' FROM judged WHERE k BETWEEN 140 AND 169 UNION ALL SELECT fingerprint, 2, 'resolve', NULL FROM judged WHERE k BETWEEN 140 AND 169
      UNION ALL SELECT fingerprint, 1, 'resolve', 'authority_not_of_finding' FROM judged WHERE k BETWEEN 170 AND 199 UNION ALL SELECT fingerprint, 2, 'resolve', 'unknown_reason_code' FROM judged WHERE k BETWEEN 170 AND 199) SELECT * FROM e""",
    "drift_status_latest": f"{_with(_EDITIONS, _SUPERSEDED, _LOG)} SELECT fingerprint, status, decision FROM status",
    "ci_gate": f"{_with(_EDITIONS, _SUPERSEDED, _LOG)} SELECT count(*) AS blocking, count(*) > 0 AS failed FROM status WHERE status = 'open' AND severity = 'critical'",
    "by_type_rollup": f"{_BASE}, {_STALE}, {_SUPERSEDED}, n AS (SELECT drift_type, count(*) AS n FROM (SELECT drift_type FROM stale UNION ALL SELECT drift_type FROM superseded) GROUP BY 1) SELECT t AS drift_type, coalesce(n, 0) AS n FROM (SELECT unnest(['conflict','possibly_stale','confirmed_stale','reused_stale_value','superseded','duplicate']) AS t) LEFT JOIN n ON n.drift_type = t",
    "drift_list_order": f"{_with(_EDITIONS, _SUPERSEDED)}, r AS (SELECT fingerprint, severity, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, effective_at NULLS FIRST, fingerprint) AS place FROM superseded) SELECT fingerprint, severity, place::INTEGER AS place FROM r WHERE place <= 50",
    "snapshot_membership": f"{_BASE} SELECT count(DISTINCT fact_id) AS facts, count(DISTINCT subject_id) AS entities FROM kfact",
    "knowledge_hash": f"""{_BASE}, r AS (SELECT '{{"object_entity":null,"object_entity_type":null,"object_type":"number","object_value":' || split_part(canon, '|', 3) || ',"predicate":"' || predicate || '","status":"active","subject":' || coalesce('"' || p_name || '"', 'null') ||
      ',"subject_type":' || CASE WHEN p_name IS NULL THEN 'null' ELSE '"part"' END || ',"valid_from":"' || valid_from || '","valid_to":' || coalesce('"' || valid_to || '"', 'null') || '}}' AS r FROM kfact LEFT JOIN part ON p_partkey = subject_id)
      SELECT sha256(string_agg(r || chr(10), '' ORDER BY r)) AS knowledge_hash, count(*) AS facts FROM r""",
    "stale_rollup_groups": f"{_BASE}, {_STALE} SELECT doc_id, drift_type, count(*) AS issues, CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'warning' END AS severity, min(effective_at) AS first_effective_at FROM stale GROUP BY 1, 2 HAVING count(*) >= 2",
    "evidence_dedup": "SELECT conv_id AS chunk_id, text AS quote, min(turn) AS ord FROM conversations GROUP BY 1, 2",
    "token_estimate": f"SELECT doc_id, len({_TOKENS.format('text')})::INTEGER AS tokens FROM documents",
    "fact_hash": f"{_BASE} SELECT fact_id, subject_id, canon AS canon_object FROM kfact",
    "suite_metrics": f"""{_SUITE}, t AS (SELECT 'possibly_stale' AS drift_type, count(*) FILTER (bad) AS expected, count(*) FILTER (bad AND short) AS tp, count(*) FILTER (NOT bad AND short) AS fp, count(*) FILTER (bad AND NOT short) AS fn FROM x
      UNION ALL SELECT 'conflict', 0, 0, count(*) FILTER (german), 0 FROM x), r AS (SELECT *, {_RATIO.format('tp', 'tp + fp')} AS precision, {_RATIO.format('tp', 'tp + fn')} AS recall FROM t WHERE expected + fp > 0)
      SELECT drift_type, expected, tp, fp, fn, precision, recall, {_RATIO.format('2 * precision * recall', 'precision + recall')} AS f1 FROM r""",
    "suite_categories": f"{_SUITE} SELECT category, count(*) AS cases, count(*) FILTER (CASE WHEN bad THEN short ELSE NOT short END AND NOT german) AS passed, (count(*) FILTER (NOT bad AND short) + count(*) FILTER (german)) AS fp FROM x GROUP BY 1",
    "gate": f"""{_SUITE}, t AS (SELECT count(*) AS cases, count(*) FILTER (CASE WHEN bad THEN short ELSE NOT short END AND NOT german) AS passed_cases, count(*) FILTER (bad AND short) AS tp,
        count(*) FILTER (NOT bad AND short) + count(*) FILTER (german) AS fp, count(*) FILTER (bad AND NOT short) AS fn, count(*) FILTER (NOT bad) AS benign, count(*) FILTER (NOT bad AND (short OR german)) AS false_alarms FROM x),
      r AS (SELECT *, {_RATIO.format('tp', 'tp + fp')} AS precision, {_RATIO.format('tp', 'tp + fn')} AS recall, {_RATIO.format('false_alarms', 'benign')} AS false_positive_rate FROM t), q AS (SELECT *, {_RATIO.format('2 * precision * recall', 'precision + recall')} AS f1 FROM r)
      SELECT *, precision > 0.8 AND recall > 0.7 AND f1 > 0.75 AND false_positive_rate < 0.3 AND tp + fn > 0 AND benign > 0 AS passed FROM q""",
    "measure_compare": f"""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, CASE WHEN l_returnflag IN ('A', 'R') THEN 'box' WHEN round(l_tax * 100) <> 2 THEN 'unit' END AS u,
        CASE WHEN l_linestatus = 'O' OR round(l_tax * 100) > 5 THEN 'EUR' WHEN round(l_tax * 100) > 3 THEN 'CHF' END AS c, {_TAX} AS t FROM lineitem),
      p AS (SELECT x.k, x.n AS n1, y.n AS n2, x.q = y.q AS same, CASE WHEN x.u IS NULL AND y.u IS NULL THEN 'not_measure' WHEN x.u IS NULL OR y.u IS NULL THEN 'missing' WHEN x.u <> y.u OR coalesce(x.c <> y.c, false) THEN 'conflict' ELSE {_TAX_VERDICT} END AS v
        FROM a x JOIN a y ON x.k = y.k AND x.n < y.n)
      SELECT k, n1, n2, CASE WHEN v = 'stated' THEN 'consistent' ELSE v END AS verdict, CASE WHEN v IN ('missing', 'stated', 'consistent') THEN same END AS same_value FROM p""",
    "tax_compare": f"WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, {_TAX} AS t FROM lineitem), p AS (SELECT x.k, x.n AS n1, y.n AS n2, {_TAX_VERDICT} AS v FROM a x JOIN a y ON x.k = y.k AND x.n < y.n) SELECT k, n1, n2, CASE v WHEN 'stated' THEN 'not_measure' ELSE v END AS verdict FROM p",
    "normalize_dimension": """WITH d AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN lower(replace(p_type, ' ', '')) || '/' || lower(p_brand) END AS d FROM part)
      SELECT p_partkey, d AS dimension, 'measure|' || coalesce(d, '-') || '|' || coalesce(regexp_replace(d, '[^a-z0-9]', '', 'g'), '') AS canonical_key FROM d""",
    "normalize_number": "SELECT event_id, round(value * 100)::BIGINT / 100.0::DOUBLE AS number FROM events",
    "attribute_bindings": f"{_with(_EDITIONS, _FACTS, _BINDINGS)} SELECT subject_id, pred_fold, canonical_key, 'Quantity' AS canonical_name, 'measure' AS value_kind, dim AS dimension, trusted FROM bound",
    "rejected_merges": f"{_with(_EDITIONS, _FACTS, _BINDINGS)} SELECT x.subject_id, x.pred_fold AS a, y.pred_fold AS b FROM chosen x JOIN chosen y ON x.subject_id = y.subject_id AND x.pred_fold < y.pred_fold AND x.dim <> y.dim",
    "shard_descriptors": f"""{_with(_EDITIONS, _FACTS, _OWN)}, v AS (SELECT subject_id, pred_fold, split_part(canon, '|', 3) || ' ' || CASE dim WHEN 'box' THEN 'Box' ELSE dim END AS v, min(fact_id) AS first_id FROM own GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, pred_fold ORDER BY first_id) AS n FROM v), g AS (SELECT subject_id, pred_fold, string_agg(v, '; ' ORDER BY n) AS samples FROM r WHERE n <= 6 GROUP BY 1, 2)
      SELECT g.subject_id, g.pred_fold, min(predicate) AS predicate, min(samples) AS samples, count(DISTINCT doc_id)::INTEGER AS docs FROM g JOIN own USING (subject_id, pred_fold) GROUP BY 1, 2""",
    "pack_shards": f"""{_with(_EDITIONS, _FACTS, _OWN).replace("WITH ", "WITH RECURSIVE ", 1)}, s AS (SELECT subject_id, count(DISTINCT pred_fold) AS n FROM own GROUP BY 1 HAVING count(DISTINCT pred_fold) > 1),
      o AS (SELECT subject_id, n, row_number() OVER (ORDER BY p_name NULLS FIRST, subject_id::VARCHAR) AS i FROM s LEFT JOIN part ON p_partkey = subject_id),
      p AS (SELECT i, n AS filled, 0 AS pack FROM o WHERE i = 1 UNION ALL SELECT o.i, CASE WHEN filled + n > 7 THEN n ELSE filled + n END, pack + CASE WHEN filled + n > 7 THEN 1 ELSE 0 END FROM p JOIN o ON o.i = p.i + 1)
      SELECT DISTINCT pack::BIGINT AS pack, subject_id::VARCHAR AS subject_id, pred_fold, false AS split FROM p JOIN o USING (i) JOIN own USING (subject_id)""",
    "conflict_channels_identity_a": f"""{_BASE}, {_GATED.format(predicate='a.pred_fold = b.pred_fold AND a.fact_id < b.fact_id')}, c AS (SELECT *, o.source_type = 'pricing' AND n.source_type = 'pricing' AS own FROM pair)
      SELECT o.subject_id, o.fact_id AS fact_a, n.fact_id AS fact_b, CASE WHEN own AND o.dim <> n.dim THEN 'cross_attribute_review' ELSE 'conflict' END AS kind, CASE WHEN own AND o.dim <> n.dim THEN 'measure_anchor_conflict' END AS reason
      FROM c WHERE CASE WHEN own THEN o.dim <> n.dim OR o.num <> n.num ELSE o.num <> n.num END""",
    "conflict_channels_identity_b": f"""{_BASE}, {_BINDINGS}, {_GATED.format(predicate='a.pred_fold < b.pred_fold')}
      SELECT o.subject_id AS subject_id, o.fact_id AS fact_a, n.fact_id AS fact_b, CASE WHEN o.dim <> n.dim THEN 'cross_attribute_review' WHEN o.num = n.num THEN 'normalized_equivalent' ELSE 'pending_review' END AS kind,
        CASE WHEN o.dim <> n.dim THEN 'merged_pair_anchor_conflict' WHEN o.num = n.num THEN 'merged_measure_equal_value' WHEN x.trusted THEN 'model_merged_unconfirmed' ELSE 'merged_pair_anchor_unverified' END AS reason, 'Quantity' AS canonical_name
      FROM pair JOIN bound x ON x.subject_id = o.subject_id AND x.pred_fold = o.pred_fold JOIN bound y ON y.subject_id = o.subject_id AND y.pred_fold = n.pred_fold AND y.canonical_key = x.canonical_key WHERE o.source_type = 'pricing' AND n.source_type = 'pricing'""",
    "cross_attribute_scan": f"""{_BASE}, {_BINDINGS}, {_GATED.format(predicate='a.pred_fold < b.pred_fold')},
      c AS (SELECT o, n, x.canonical_key IS NOT NULL AND y.canonical_key IS NOT NULL AND x.canonical_key = y.canonical_key AS merged, p.dim <> q.dim AS split FROM pair LEFT JOIN bound x ON x.subject_id = o.subject_id AND x.pred_fold = o.pred_fold LEFT JOIN bound y ON y.subject_id = o.subject_id AND y.pred_fold = n.pred_fold
        LEFT JOIN chosen p ON p.subject_id = o.subject_id AND p.pred_fold = o.pred_fold LEFT JOIN chosen q ON q.subject_id = o.subject_id AND q.pred_fold = n.pred_fold WHERE o.source_type = 'pricing' AND n.source_type = 'pricing')
      SELECT o.subject_id AS subject_id, o.fact_id AS fact_a, n.fact_id AS fact_b, 'cross_attribute_review' AS kind, CASE WHEN o.dim <> n.dim THEN 'measure_anchor_conflict_split' ELSE 'same_unit_different_value_not_comerged' END AS reason
      FROM c WHERE NOT merged AND CASE WHEN o.dim <> n.dim THEN coalesce(split, false) ELSE o.num <> n.num END""",
    "free_text_predicates": "WITH t AS (SELECT conv_id % 40 AS subject_id, role AS pred_fold, substr(text, 1, (turn * 9 + 6)::INT) AS v FROM conversations) SELECT subject_id, pred_fold FROM t GROUP BY 1, 2 HAVING max(len(trim(v))) > 20 OR count(DISTINCT v) > 8",
    "text_equivalence": "SELECT a.o_custkey AS subject_id, a.o_orderkey AS a, b.o_orderkey AS b, coalesce((a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '2-HIGH') OR (a.o_orderpriority = '2-HIGH' AND b.o_orderpriority = '1-URGENT'), false) AS texts_equivalent FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey",
    "valid_to_anchor_class": "SELECT o_orderkey AS doc_id, o_orderdate::DATE AS valid_to, CASE o_orderkey % 3 WHEN 0 THEN 'quoted' WHEN 1 THEN 'document_scope' ELSE 'calendar_derived' END AS valid_to_anchor FROM orders",
    "anchor_replay": "SELECT valid_to_anchor, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'quoted' WHEN 1 THEN 'document_scope' ELSE 'calendar_derived' END AS valid_to_anchor FROM orders) GROUP BY 1",
    "evidence_anchor": """WITH c AS (SELECT conv_id || '-' || turn AS chunk_id, text, role FROM conversations), k AS (SELECT chunk_id, 'x ' || replace(min(text), ' ', chr(10)) || ' y' AS chunk, min(text) AS held FROM c GROUP BY 1),
      q AS (SELECT chunk_id, chunk, role <> 'user' OR NOT contains(regexp_replace(chunk, '\\s', '', 'g'), regexp_replace(text, '\\s', '', 'g')) AS quote_warning, text FROM c JOIN k USING (chunk_id))
      SELECT chunk_id, quote_warning, sha256(CASE WHEN quote_warning THEN substr(chunk, 1, 500) ELSE trim(text) END) AS evidence FROM q""",
    "review_date_propagation": """WITH o AS (SELECT o_custkey AS chunk_id, o_orderkey AS ord, o_orderkey % 6 AS k, strftime(CASE WHEN o_custkey % 3 = 0 THEN o_orderdate ELSE TIMESTAMP '1997-05-05' END, '%Y-%m-%d') AS day FROM orders),
      r AS (SELECT chunk_id, min(day) AS d FROM o WHERE k < 2 GROUP BY 1 HAVING min(day) = max(day)) SELECT chunk_id, ord, CASE WHEN k = 5 THEN '1990-01-01' WHEN k >= 2 THEN d END AS observed_at FROM o LEFT JOIN r USING (chunk_id)""",
    "fact_validation": """SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_quantity, ['blank_subject','blank_quote','type_with_entity','valid','two_objects','no_object','not_a_number','not_a_date','not_a_boolean','unit_without_number','type_unknown','valid','currency_without_unit','tax_basis_unknown','bad_window_date','window_reversed'][(l_quantity::INT % 16) + 1] AS verdict FROM (SELECT DISTINCT * FROM lineitem)""",
    "entity_references": """WITH g AS (SELECT p_size, count(*) AS c, min(sha256('thing ' || p_partkey || '|team')) AS one FROM part GROUP BY 1), t AS (SELECT p_partkey + 1 AS k, p_partkey AS p FROM part)
      SELECT p_partkey AS fact, CASE p_partkey % 4 WHEN 0 THEN 'declared' WHEN 1 THEN CASE WHEN p IS NULL THEN 'unknown' ELSE 'matched' END WHEN 2 THEN CASE WHEN c > 1 THEN 'ambiguous' ELSE 'matched' END ELSE 'unknown' END AS subject_kind,
        CASE p_partkey % 4 WHEN 0 THEN sha256('thing ' || p_partkey || '|team') WHEN 1 THEN CASE WHEN p IS NULL THEN sha256('t' || (p_partkey - 1) || '|unknown') ELSE sha256('thing ' || p || '|team') END WHEN 2 THEN CASE WHEN c = 1 THEN one END ELSE sha256('nobody ' || p_size || '|unknown') END AS subject_id
      FROM part JOIN g USING (p_size) LEFT JOIN t ON t.k = p_partkey""",
    "fact_dedup": "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'",
    "entity_ladder": "SELECT p_partkey AS chunk_id, sha256(lower(trim(p_name)) || '|' || CASE WHEN p_size < 40 THEN 'offering' ELSE 'team' END) AS entity_id FROM part",
    "match_findings": """WITH c AS (SELECT DISTINCT conv_id::VARCHAR AS case_id, printf('%05d', turn) AS t, role = 'user' AS u FROM conversations),
      r AS (SELECT *, row_number() OVER (PARTITION BY case_id, u ORDER BY t) AS k FROM c)
      SELECT e.case_id, e.t AS expected_id, f.t AS finding_id FROM r e LEFT JOIN r f ON e.case_id = f.case_id AND e.k = f.k AND NOT f.u WHERE e.u""",
    "hcr_score": "SELECT lang AS drift_type, count(*) AS reported, count(*) FILTER (quality = 1) AS confirmed, avg((coalesce(quality, 0) = 1)::INT::DOUBLE) AS confirmed_rate, avg((toxic = 0)::INT::DOUBLE) AS actionable_rate, avg((coalesce(quality, 0) = 1)::INT::DOUBLE) > 0.6 AS passed FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "normalize_text": f"SELECT doc_id, sha256({_NORMAL.format(_ODD)}) AS sha256 FROM documents",
    "paragraphs": f"SELECT doc_id, (i - 1)::INTEGER AS paragraph, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {_PARAGRAPHS} AS p FROM documents))",
    "paragraph_places": f"""WITH t AS (SELECT doc_id, ' ' || chr(10) || text AS t FROM documents), p AS (SELECT doc_id, regexp_extract_all(t, '{_LINES}') AS p, string_split_regex(t, '{_LINES}') AS g FROM t),
      e AS (SELECT doc_id, p, g, unnest(range(1, len(p) + 1)) AS i FROM p), o AS (SELECT *, (list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(p[1:i - 1], lambda x: len(x))), 0))::INTEGER AS b FROM e)
      SELECT doc_id, (i - 1)::INTEGER AS paragraph, b AS offset_start, (b + len(p[i]))::INTEGER AS offset_end, md5({_STRIPPED.replace("nfc_normalize({0})", "{0}").format("p[i]")}) AS text FROM o""",
    "content_hash": f"SELECT doc_id, sha256(to_json(list_transform({_PARAGRAPHS}, lambda t, i: {{'page': NULL::INT, 'paragraph': i - 1, 'text': t}}))) AS content_hash FROM documents",
    "chunk_greedy": f"""WITH RECURSIVE b AS (SELECT doc_id, {_PARAGRAPHS} AS p FROM documents), l0 AS (SELECT doc_id, bi, unnest(list_filter(string_split(p[bi], chr(10)), lambda x: x <> '')) AS line, generate_subscripts(list_filter(string_split(p[bi], chr(10)), lambda x: x <> ''), 1) AS li FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS bi FROM b)),
      l1 AS (SELECT *, len({_TOKENS.format('line')}) AS n, {_TOKENS.format('line')} AS tok, string_split_regex(line, '{_TOKEN}') AS gap FROM l0),
      l2 AS (SELECT *, unnest(CASE WHEN n > 512 THEN range(0, ((n - 512 + 447) // 448)::BIGINT + 1) ELSE [0] END) AS w FROM l1),
      u AS (SELECT doc_id, bi, li, w, CASE WHEN n <= 512 THEN line ELSE array_to_string(list_transform(range(w * 448 + 1, least(w * 448 + 512, n) + 1), lambda j, z: CASE WHEN z = 1 THEN '' ELSE gap[j] END || tok[j]), '') END AS text, CASE WHEN n <= 512 THEN n ELSE least(512, n - w * 448) END AS n,
        row_number() OVER (PARTITION BY doc_id ORDER BY bi, li, w) AS r FROM l2),
      s AS (SELECT doc_id, r, 0 AS chunk_index, n AS filled FROM u WHERE r = 1 UNION ALL SELECT u.doc_id, u.r, chunk_index + (filled > 0 AND filled + u.n > 512)::INT, CASE WHEN filled > 0 AND filled + u.n > 512 THEN u.n ELSE filled + u.n END FROM s JOIN u ON u.doc_id = s.doc_id AND u.r = s.r + 1),
      g AS (SELECT s.doc_id, chunk_index, n, bi, u.r, CASE WHEN lag(bi) OVER w IS NULL THEN '' WHEN lag(bi) OVER w = bi THEN chr(10) ELSE chr(10) || chr(10) END || text AS t FROM s JOIN u ON u.doc_id = s.doc_id AND u.r = s.r WINDOW w AS (PARTITION BY s.doc_id, chunk_index ORDER BY u.r))
      SELECT doc_id, chunk_index::INTEGER AS chunk_index, sum(n)::INTEGER AS token_count, md5(string_agg(t, '' ORDER BY r)) AS text, count(DISTINCT bi)::INTEGER AS blocks FROM g GROUP BY 1, 2""",
    "long_line_windows": f"""WITH l0 AS (SELECT doc_id, list_filter(string_split({_NORMAL.format('text')}, chr(10)), lambda x: x <> '') AS ls FROM documents), l1 AS (SELECT doc_id, i - 1 AS line, ls[i] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l0)),
      l2 AS (SELECT *, len({_TOKENS.format('t')}) AS n, {_TOKENS.format('t')} AS tok, string_split_regex(t, '{_TOKEN}') AS gap FROM l1), l3 AS (SELECT *, unnest(range(0, ((n - 128 + 111) // 112)::BIGINT + 1)) AS w FROM l2 WHERE n > 128)
      SELECT doc_id, line::INTEGER AS line, w::INTEGER AS window, md5(array_to_string(list_transform(range(w * 112 + 1, least(w * 112 + 128, n) + 1), lambda j, z: CASE WHEN z = 1 THEN '' ELSE gap[j] END || tok[j]), '')) AS text, least(128, n - w * 112)::INTEGER AS n_tokens FROM l3""",
    "ignore_filter": "WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages) SELECT page_id, regexp_matches(p, '^.*\\.org/es/.*$') OR regexp_matches(p, '(^|/)[1-4].$') OR contains(p, '/fr/') AS ignored FROM p",
    "ingest_skip": "SELECT DISTINCT sha256(text) AS file_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)",
    "version_links": f"""{_with(_EDITIONS, _FILES)} SELECT "group", label, doc_id, prev_id FROM linked WHERE doc_id IS NOT NULL""",
    "version_warnings": f"""{_with(_EDITIONS, _FILES)} SELECT path, warning FROM linked WHERE warning IS NOT NULL UNION ALL SELECT supersedes, prev_warning FROM linked WHERE prev_warning IS NOT NULL""",
}
