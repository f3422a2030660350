WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (
  SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs WHERE len(ws) >= 3)),
found AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM grams),
covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM found WHERE n > 1) GROUP BY r),
base AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS shouts,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses,
    len(list_filter(ws, lambda w: CASE WHEN strlen(w) <= 12 THEN lower(trim(w, '.,;:!?…''"`´‘’‚‛“”„«»‹›()[]{}¿¡-–—*_/')) END IN (
    'a', 'al', 'als', 'an', 'and', 'are', 'as', 'at', 'au', 'auch', 'auf', 'be', 'by', 'ce', 'como', 'con', 'dans',
    'das', 'de', 'del', 'dem', 'den', 'der', 'des', 'die', 'du', 'ein', 'eine', 'el', 'elle', 'en', 'es', 'est',
    'et', 'for', 'from', 'für', 'have', 'il', 'im', 'in', 'is', 'ist', 'it', 'la', 'las', 'le', 'les', 'lo', 'los',
    'mit', 'más', 'nicht', 'no', 'not', 'of', 'on', 'or', 'par', 'para', 'pas', 'plus', 'por', 'pour', 'que', 'qui',
    'se', 'sich', 'su', 'sur', 'that', 'the', 'this', 'to', 'un', 'una', 'und', 'une', 'von', 'was', 'which', 'with',
    'y', 'zu'
    ))) AS stops,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1 AND shouts / n_words <= 0.3
    AND stops / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AND ellipses / n_lines <= 0.3 AS kept
FROM judged
