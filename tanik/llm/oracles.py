"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations


def _pii_spans(kind: str, pattern: str, keep: str) -> str:
    return f"""
    {kind} AS (
      SELECT doc_id, '{kind}' AS kind, found, start, start + length(found) AS stop, text FROM (
        SELECT doc_id, text, unnest(m) AS found,
          unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS start
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM docs)
        WHERE len(m) > 0) WHERE {keep})"""


_PARTS = "len(list_filter(string_split(found, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0"
_BARE = "regexp_replace(found, '[^0-9]', '', 'g')"
_LUHN = f"""length({_BARE}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_BARE}) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN reverse({_BARE})[i]::INT WHEN reverse({_BARE})[i]::INT < 5 THEN reverse({_BARE})[i]::INT * 2
       ELSE reverse({_BARE})[i]::INT * 2 - 9 END)) % 10 = 0"""
_CODE = "replace(found, ' ', '')"
_IBAN = f"""length({_CODE}) BETWEEN 15 AND 34 AND NOT regexp_matches(substr(text, start, 1), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, start + length(found) + 1, 1), '[A-Za-z0-9]')
  AND list_reduce(list_prepend(0, list_transform(string_split({_CODE}[5:] || {_CODE}[:4], ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)),
    lambda t, v: (t * (CASE WHEN v < 10 THEN 10 ELSE 100 END) + v) % 97) = 1"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _PARTS),
    ("card", r"[0-9]([\x20-]?[0-9])+", _LUHN),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_BARE}) BETWEEN 9 AND 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _IBAN),
)

OP6 = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {",".join(_pii_spans(*k) for k in _KINDS)},
  spans AS ({" UNION ALL ".join(f"SELECT doc_id, {n} AS k, kind, start, stop FROM {k[0]}" for n, k in enumerate(_KINDS))}),
  totals AS (
    SELECT doc_id, {", ".join(f"count(*) FILTER (k = {n}) AS n_{k[0]}" for n, k in enumerate(_KINDS[:4]))},
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) FILTER (k < 4) AS base,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans
    FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k[0]}, 0)::BIGINT AS n_{k[0]}" for k in _KINDS[:4])},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN totals USING (doc_id)"""

OP1 = r"""WITH p AS (
  SELECT page_id, url, length(coalesce(html, '')) AS n, '"' || md5(coalesce(html, '')) || '"' AS tag, 1704067200 + page_id * 60 AS s,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS head,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS q FROM p),
k AS (SELECT *, head || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM u),
r AS (SELECT page_id * 2 AS record_id, canonical_url, s AS ts, 1 AS full_, page_id, n, s AS date, CASE WHEN page_id % 4 <> 0 THEN tag END AS etag, 'day ' || (n % 97) AS modified FROM k
  UNION ALL SELECT page_id * 2 + 1, canonical_url, s + 30 + (page_id % 5) * 86400, 0, page_id, n, s + 30 + (page_id % 5) * 86400, CASE WHEN page_id % 7 = 0 THEN 'W/' || tag WHEN page_id % 4 <> 0 THEN tag END, 'day ' || (n % 97) FROM k),
j AS (SELECT *, last_value(CASE WHEN full_ = 1 THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_id FROM r),
m AS (SELECT j.record_id, j.canonical_url, j.base_id, j.etag AS fe, j.modified AS fm, j.date AS fd, b.etag AS be, b.modified AS bm, b.n AS bn,
    CASE WHEN j.base_id IS NULL THEN 'no_base'
      WHEN b.etag IS NOT NULL AND j.etag IS NOT NULL THEN CASE WHEN b.etag = regexp_replace(j.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
      WHEN b.modified = j.modified THEN 'resolved' ELSE 'mismatch' END AS status
  FROM j LEFT JOIN r b ON b.record_id = j.base_id WHERE j.full_ = 0)
SELECT record_id, canonical_url, status, base_id, CASE WHEN status = 'resolved' THEN
  'content-length: ' || bn || '; content-type: text/html; date: ' || fd || CASE WHEN coalesce(fe, be) IS NOT NULL THEN '; etag: ' || coalesce(fe, be) ELSE '' END || '; last-modified: ' || fm ELSE '' END AS headers
FROM m"""

OP13 = """WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5"""

ORACLES = {"op1_revisits": OP1, "op6_pii": OP6, "op13_negatives": OP13}
