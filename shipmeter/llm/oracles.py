"""The text queries that plain SQL can express, written out for another engine."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_WORDS = """
{name} AS (
  SELECT {id}, unnest(w) AS word, generate_subscripts(w, 1) AS k, len(w) AS m FROM (
    SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})),
{name}_runs AS (
  SELECT {id}, k, m, list(word) OVER (PARTITION BY {id} ORDER BY k ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM {name})"""


def _words(name: str, table: str, key: str) -> str:
    return _WORDS.format(name=name, table=table, id=key, upper=_UPPER, lower=_UPPER.lower())


CONTAMINATION = f"""
WITH {_words('d', 'documents', 'doc_id')}, {_words('b', 'benchmark', 'item_id')},
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(10, m) AS n, array_to_string(run[1:least(10, m)], ' ') AS win
  FROM b_runs WHERE len(run) >= least(10, m) AND item_id IS NOT NULL),
spans AS (
  SELECT doc_id, k, n, win FROM d_runs, (SELECT DISTINCT n FROM windows) AS sizes,
    LATERAL (SELECT array_to_string(run[1:n], ' ') AS win) AS joined
  WHERE len(run) >= n),
hits AS (SELECT DISTINCT doc_id, k, s.n, item_id FROM spans s JOIN windows w ON s.win = w.win AND s.n = w.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hits GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_words FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)"""

_PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "weak": r"""https?://[^\x00-\x20\"''<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?|[A-Za-z0-9+/_-]{12,}""",
    "break": r"\n[\x20\t\r]*\n",
}


def _spans(name: str) -> str:
    """Begin, end and text of every match, from the lengths of gaps and matches before it."""
    pattern = _PATTERNS[name].replace('\\"', '"')
    value = f"regexp_extract_all(text, '{pattern}', 2)" if name == "assign" else "m"
    return f"""
      SELECT doc_id, '{name}' AS kind, i, m[i] AS m, v[i] AS v,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b
      FROM (
        SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, m, {value} AS v, string_split_regex(text, '{pattern}') AS gaps
          FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m FROM texts) WHERE len(m) > 0))"""


def _near(role: str) -> str:
    return f"""(coalesce({role}_before >= b - 256 AND {role}_before > coalesce(break_before, -1), false)
      OR coalesce({role}_after <= e + 256 AND {role}_after < coalesce(break_after, 2147483647), false))"""


_ROLES = {
    "name": "kind IN ('access', 'weak_id')",
    "secret": "kind IN ('assign', 'hex', 'weak_secret')",
    "place": "kind = 'endpoint'",
    "base": "kind IN ('assign', 'access', 'hex')",
    "break": "kind = 'break'",
}
_SEEN = ",\n".join(
    f"max(CASE WHEN {of} THEN e END) OVER past AS {role}_before, min(CASE WHEN {of} THEN b END) OVER coming AS {role}_after"
    for role, of in _ROLES.items()
)

CREDENTIALS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({' UNION ALL '.join(map(_spans, _PATTERNS))}),
parts AS (
  SELECT doc_id, b, b + length(m) AS e, CASE
      WHEN kind = 'assign' THEN CASE WHEN length(v) >= 6 THEN 'assign' END
      WHEN kind = 'access' THEN CASE WHEN length(m) >= 20 THEN 'access' END
      WHEN kind = 'hex' THEN CASE WHEN length(m) >= 24 THEN 'hex' END
      WHEN kind = 'break' THEN 'break'
      WHEN regexp_matches(m, '^https?://|^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') THEN 'endpoint'
      WHEN regexp_matches(m, '^[A-Z0-9]+$') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') THEN 'weak_id'
      WHEN length(m) >= 20 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]') THEN 'weak_secret'
    END AS kind FROM matches),
seen AS (
  SELECT *, {_SEEN} FROM parts WHERE kind IS NOT NULL
  WINDOW past AS (PARTITION BY doc_id ORDER BY b, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    coming AS (PARTITION BY doc_id ORDER BY b, e, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
kept AS (
  SELECT doc_id, kind, kind || ':' || b || ':' || e AS span, b,
    list_position(['assign', 'access', 'hex', 'weak_id', 'weak_secret', 'endpoint'], kind) AS rank
  FROM seen WHERE {_ROLES['base']} OR (
    coalesce(base_before <= b, true) AND coalesce(base_after >= e, true) AND (
      (kind = 'weak_id' AND {_near('secret')})
      OR (kind = 'weak_secret' AND ({_near('name')} OR {_near('place')}))
      OR (kind = 'endpoint' AND {_near('secret')})))),
summed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY b, rank) FILTER (WHERE kind IN ('assign', 'access', 'hex')) AS base,
    string_agg(span, ',' ORDER BY b, rank) AS spans
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN summed USING (doc_id)"""

FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (
  SELECT doc_id, part,
    (len(ws) < 50)::INT
    + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w),
lab AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS tox FROM labels GROUP BY doc_id),
g AS (
  SELECT part, mask, coalesce(good, 0) AS good, coalesce(tox, 0) AS tox, count(*) AS n
  FROM f LEFT JOIN lab USING (doc_id) GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
o AS (
  SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order FROM l l1, l l2, l l3, l l4, l l5
  WHERE l1.b | l2.b | l3.b | l4.b | l5.b = 31),
s AS (
  SELECT filter_order, step::INT AS step,
    1 << (instr('ABCDE', substr(filter_order, step::INT, 1)) - 1) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', substr(filter_order, i::INT, 1)) - 1))), 0) AS before
  FROM o, range(1, 6) r(step))
SELECT p.part, s.filter_order, s.step,
  coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0 AND good = 1), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0 AND tox = 1), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (WHERE mask & bit <> 0), 0)::BIGINT AS shapley
FROM (SELECT DISTINCT part FROM d) p CROSS JOIN s LEFT JOIN g ON g.part = p.part
GROUP BY ALL"""

EMBEDDING_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)
    AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS ok
  FROM embeddings WHERE vec_id IS NOT NULL),
e AS (
  SELECT a.vec_id AS u, b.vec_id AS w
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok
    AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
und AS (SELECT u AS a, w AS b FROM e UNION ALL SELECT w, u FROM e),
reach(a, b) AS (SELECT a, b FROM und UNION SELECT r.a, x.b FROM reach r JOIN und x ON r.b = x.a)
SELECT v.vec_id, coalesce(c.nl, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(r.m, v.vec_id))::BIGINT AS component_id,
  least(v.vec_id, coalesce(r.m, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS nl FROM und GROUP BY a) c ON c.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = v.vec_id"""

ORACLES = {
    "op2_credential_linking": CREDENTIALS,
    "op8_positional_index": CONTAMINATION,
    "op12_metric_range_join": EMBEDDING_LINKS,
    "op13_packed_filter_audit": FILTER_AUDIT,
}
