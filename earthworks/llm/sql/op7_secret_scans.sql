WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
rules(kind, rank, pattern, part, least) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, '(AKIA[A-Z0-9]+)', 1, 20),
  ('hex', 2, '([0-9a-f]+)', 1, 24)),
cut AS (
  SELECT r, kind, rank, least,
    CASE kind
      WHEN 'assign' THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0)
      WHEN 'access' THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0)
      ELSE regexp_extract_all(t, '[0-9a-f]+', 0) END AS whole,
    CASE kind
      WHEN 'assign' THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
      WHEN 'access' THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0)
      ELSE regexp_extract_all(t, '[0-9a-f]+', 0) END AS part,
    CASE kind
      WHEN 'assign' THEN regexp_split_to_array(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 'access' THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]+')
      ELSE regexp_split_to_array(t, '[0-9a-f]+') END AS gaps
  FROM docs CROSS JOIN rules),
placed AS (
  SELECT r, kind, rank, least, unnest(whole) AS whole, unnest(part) AS part,
    unnest(gaps[1:len(whole)]) AS gap, unnest(range(1, len(whole) + 1)) AS k
  FROM cut WHERE len(whole) > 0),
spans AS (
  SELECT *, CAST(sum(length(gap)) OVER w + sum(length(whole)) OVER w - length(whole) AS BIGINT) AS s FROM placed
  WINDOW w AS (PARTITION BY r, kind ORDER BY k)),
lists AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || (s + length(whole)), ',' ORDER BY s, rank) AS spans
  FROM spans WHERE length(part) >= least GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (r)
