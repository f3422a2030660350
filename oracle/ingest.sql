-- name: name_norm
-- columns: file_id:i row_idx:i col_idx:i nom:s
SELECT file_id, row_idx, col_idx,
       trim(regexp_replace(replace(replace(replace(regexp_replace(strip_accents(lower(regexp_replace(value, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'))), '[ /.-]', '_', 'g'),
            '(', ''), ')', ''), '°', ''), '_+', '_', 'g'), '_') AS nom
FROM raw_cells

-- name: header_detect
-- columns: file_id:i header_row:i score:i
WITH s AS (
  SELECT file_id, row_idx, count(*) FILTER (regexp_matches(strip_accents(lower(coalesce(value, ''))),
    'designation|libelle|intitule|description|poste|ouvrage|travaux|prestation|nature|article|unit|mesure|quantite|qte|prix|pu|code|reference|num')) AS score
  FROM raw_cells WHERE row_idx < 15 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, row_idx) AS n FROM s)
SELECT file_id, CASE WHEN score = 0 THEN 0 ELSE row_idx END AS header_row, score FROM r WHERE n = 1

-- name: column_resolve
-- columns: file_id:i champ:s rang:i col_idx:i nom:s
SELECT file_id, champ, CASE WHEN file_id < 25 AND file_id NOT IN (7, 8) AND champ = 'code' THEN 2
                            WHEN file_id BETWEEN 25 AND 49 AND champ = 'qte' THEN 2 WHEN file_id = 50 AND champ = 'code' THEN 2 WHEN file_id = 8 THEN 2 ELSE 1 END AS rang, col_idx, nom
FROM (
  SELECT n_nationkey AS file_id, unnest(['code', 'designation', 'unite', 'qte', 'pu']) AS champ, unnest([0, 1, 2, 3, 4]) AS col_idx,
         unnest(['n_code', 'designation', 'unite', 'qte', 'prix_unitaire']) AS nom FROM nation WHERE n_nationkey NOT IN (7, 8)
  UNION ALL
  SELECT 50, unnest(['code', 'designation', 'unite', 'qte', 'pu']), unnest([1, 2, 3, 4, 5]),
         unnest(['n_code', 'designation', 'unite', 'qte', 'prix_unitaire'])
  UNION ALL
  SELECT 7, unnest(['code', 'designation', 'qte', 'pu']), unnest([0, 1, 3, 4]), unnest(['code', 'designation', 'qte', 'prix'])
  UNION ALL
  SELECT 8, unnest(['unite', 'code']), unnest([1, 0]), unnest(['unnamed:_1', 'nation_8'])
  UNION ALL
  SELECT n_nationkey + 25, unnest(['code', 'designation', 'unite', 'pu', 'qte']), unnest([0, 1, 2, 3, 7]),
         unnest(['code_poste', 'libelle_travaux', 'unites', 'pu_ht', 'remarques']) FROM nation)

-- name: import_rejects
-- columns: file_id:i manquants:s
SELECT * FROM (VALUES (7, 'unite'), (8, 'designation'), (51, 'designation,unite')) AS t(file_id, manquants)
WHERE file_id IN (SELECT file_id FROM raw_cells)

-- name: grid_table
-- columns: file_id:i row_idx:i ligne:i code:s designation:s unite:s qte:s pu:s
WITH p AS (
  SELECT CAST(p_partkey % 25 AS INT) AS f, CAST((p_partkey % 25) % 6 + 1 + floor(p_partkey / 25) AS INT) AS r, *,
         CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 'nan' ELSE p_name END AS nm,
         CASE WHEN p_partkey % 17 = 0 THEN 'n/a' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END AS pr FROM part),
g AS (
  SELECT f AS file_id, r AS row_idx, p_brand AS code, nm AS designation, p_type AS unite, CAST(p_size AS VARCHAR) AS qte, pr AS pu FROM p WHERE f NOT IN (7, 8)
  UNION ALL SELECT f, r, p_brand, nm, NULL, CAST(p_size AS VARCHAR), pr FROM p WHERE f = 7
  UNION ALL SELECT f, r, p_brand, NULL, nm, NULL, NULL FROM p WHERE f = 8
  UNION ALL SELECT 8, 2, 'Col 0', NULL, 'Col 1', NULL, NULL
  UNION ALL SELECT f + 25, r, p_brand, nm, p_type, CASE WHEN p_partkey % 3 = 0 THEN 'ok' END, pr FROM p
  UNION ALL SELECT 50, CAST(9 + floor(p_partkey / 50) AS INT), p_brand, chr(160) || p_name || chr(10), chr(9) || p_type,
    CASE WHEN p_partkey % 3 = 0 THEN p_size || 'd' ELSE ' ' || p_size || chr(9) END, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) FROM part WHERE p_partkey % 50 = 1)
SELECT file_id, row_idx, row_number() OVER (PARTITION BY file_id ORDER BY row_idx) - 1 AS ligne, code, designation, unite, qte, pu FROM g

-- name: numeric_coerce
-- columns: file_id:i row_idx:i champ:s nombre:d
WITH p AS (
  SELECT CAST(p_partkey % 25 AS INT) AS f, CAST((p_partkey % 25) % 6 + 1 + floor(p_partkey / 25) AS INT) AS r, *,
         CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS pr FROM part)
SELECT f AS file_id, r AS row_idx, 'qte' AS champ, p_size::DOUBLE AS nombre FROM p WHERE f <> 8
UNION ALL SELECT f, r, 'pu', pr FROM p WHERE f <> 8
UNION ALL SELECT f + 25, r, 'pu', pr FROM p
UNION ALL SELECT f + 25, r, 'qte', 0 FROM p WHERE p_partkey % 3 = 0
UNION ALL SELECT 50, CAST(9 + floor(p_partkey / 50) AS INT), 'qte', CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END FROM part WHERE p_partkey % 50 = 1
UNION ALL SELECT 50, CAST(9 + floor(p_partkey / 50) AS INT), 'pu', CAST(p_retailprice AS DECIMAL(18,2)) FROM part WHERE p_partkey % 50 = 1

-- name: deliverable_match
-- columns: file_id:i rue_id:i col_idx:i nom:s livrable_id:i livrable:s
SELECT n_nationkey + 25 AS file_id, n_nationkey % (SELECT count(*) FROM supplier) AS rue_id, k + 4 AS col_idx, 'livrable_' || k AS nom,
       n_nationkey % (SELECT count(*) FROM supplier) * 5 + k AS livrable_id, 'livrable ' || k AS livrable
FROM nation, range(0, 3) AS t(k)

-- name: import_simple
-- columns: file_id:i row_idx:i rue_id:i code_poste:s designation:s unite:s quantite:d prix_unitaire:d montant:d
WITH p AS (
  SELECT CAST(p_partkey % 25 AS INT) AS f, (p_partkey % 25) % 6 + 1 + floor(p_partkey / 25) AS r, p_brand AS code, p_name AS nm, p_type AS un, p_size::DOUBLE AS q,
         CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END AS pu
  FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND p_partkey % 25 NOT IN (7, 8)
  UNION ALL
  SELECT 50, 9 + floor(p_partkey / 50), p_brand, p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) FROM part WHERE p_partkey % 50 = 1)
SELECT f AS file_id, r AS row_idx, f % 25 % (SELECT count(*) FROM supplier) AS rue_id, code AS code_poste, nm AS designation, un AS unite, q AS quantite, pu AS prix_unitaire, q * pu AS montant
FROM p

-- name: import_multi
-- columns: file_id:i row_idx:i rue_id:i livrable_id:i code_poste:s designation:s unite:s quantite:d prix_unitaire:d
WITH p AS (
  SELECT *, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS pr FROM part
  WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0),
q AS (SELECT *, 0 AS k, (p_size % 4)::DOUBLE AS qn FROM p WHERE p_size % 4 <> 0
      UNION ALL SELECT *, 1, p_size FROM p WHERE p_partkey % 2 = 1 AND p_size <> 0
      UNION ALL SELECT *, 2, 12.5 FROM p WHERE p_partkey % 5 <> 0)
SELECT p_partkey % 25 + 25 AS file_id, (p_partkey % 25) % 6 + 1 + floor(p_partkey / 25) AS row_idx, p_partkey % 25 % (SELECT count(*) FROM supplier) AS rue_id,
       p_partkey % 25 % (SELECT count(*) FROM supplier) * 5 + k AS livrable_id, p_brand AS code_poste, p_name AS designation, p_type AS unite, qn AS quantite, pr AS prix_unitaire
FROM q

-- name: import_stats
-- columns: file_id:i nb_lignes:i nb_livrables:i
WITH p AS (SELECT * FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0),
q AS (SELECT p_partkey, 0 AS k FROM p WHERE p_size % 4 <> 0
      UNION ALL SELECT p_partkey, 1 FROM p WHERE p_partkey % 2 = 1 AND p_size <> 0
      UNION ALL SELECT p_partkey, 2 FROM p WHERE p_partkey % 5 <> 0)
SELECT p_partkey % 25 + 25 AS file_id, count(*) AS nb_lignes, count(DISTINCT k) AS nb_livrables FROM q GROUP BY 1
UNION ALL
SELECT p_partkey % 25, count(*), 0 FROM p WHERE p_partkey % 25 NOT IN (7, 8) GROUP BY 1
UNION ALL
SELECT 50, count(*), 0 FROM part WHERE p_partkey % 50 = 1 HAVING count(*) > 0

-- name: import_deliverable
-- columns: file_id:i row_idx:i rue_id:i livrable_id:i code_poste:s designation:s unite:s quantite:d prix_unitaire:d montant:d
WITH p AS (
  SELECT CAST(p_partkey % 25 AS INT) AS f, (p_partkey % 25) % 6 + 1 + floor(p_partkey / 25) AS r, p_brand AS code, p_name AS nm, p_type AS un, p_size::DOUBLE AS q,
         CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END AS pu
  FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND p_partkey % 25 NOT IN (7, 8)
  UNION ALL
  SELECT 50, 9 + floor(p_partkey / 50), p_brand, p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) FROM part WHERE p_partkey % 50 = 1)
SELECT f AS file_id, r AS row_idx, f % 25 % (SELECT count(*) FROM supplier) AS rue_id, f % 25 % (SELECT count(*) FROM supplier) * 5 + f % 4 AS livrable_id, code AS code_poste, nm AS designation, un AS unite,
       q AS quantite, pu AS prix_unitaire, q * pu AS montant
FROM p

-- name: import_subcontractor
-- columns: file_id:i row_idx:i rue_id:i st_id:i code_poste:s designation:s unite:s quantite:d prix_unitaire:d montant:d
WITH p AS (
  SELECT CAST(p_partkey % 25 AS INT) AS f, (p_partkey % 25) % 6 + 1 + floor(p_partkey / 25) AS r, p_brand AS code, p_name AS nm, p_type AS un, p_size::DOUBLE AS q,
         CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END AS pu
  FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND p_partkey % 25 NOT IN (7, 8)
  UNION ALL
  SELECT 50, 9 + floor(p_partkey / 50), p_brand, p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) FROM part WHERE p_partkey % 50 = 1)
SELECT f AS file_id, r AS row_idx, f % 25 % (SELECT count(*) FROM supplier) AS rue_id, f % 25 % (SELECT count(*) FROM supplier) AS st_id, code AS code_poste, nm AS designation, un AS unite,
       q AS quantite, pu AS prix_unitaire, q * pu AS montant
FROM p

-- name: grid_cells
-- columns: file_id:i ligne:i col_idx:i nom:s value:s
WITH h AS (WITH s AS (
  SELECT file_id, row_idx, count(*) FILTER (regexp_matches(strip_accents(lower(coalesce(value, ''))),
    'designation|libelle|intitule|description|poste|ouvrage|travaux|prestation|nature|article|unit|mesure|quantite|qte|prix|pu|code|reference|num')) AS score
  FROM raw_cells WHERE row_idx < 15 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, row_idx) AS n FROM s)
SELECT file_id, CASE WHEN score = 0 THEN 0 ELSE row_idx END AS header_row, score FROM r WHERE n = 1),
t AS (SELECT c.file_id, c.col_idx, c.value FROM raw_cells c JOIN h ON h.file_id = c.file_id AND h.header_row = c.row_idx),
n AS (SELECT file_id, col_idx, trim(regexp_replace(replace(replace(replace(regexp_replace(strip_accents(lower(regexp_replace(value, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'))), '[ /.-]', '_', 'g'),
            '(', ''), ')', ''), '°', ''), '_+', '_', 'g'), '_') AS nom, trim(regexp_replace(value, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) AS bare FROM t),
b AS (SELECT c.*, dense_rank() OVER (PARTITION BY c.file_id ORDER BY c.row_idx) - 1 AS ligne FROM raw_cells c JOIN h ON h.file_id = c.file_id
      WHERE c.row_idx > h.header_row AND regexp_replace(c.value, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') <> '')
SELECT b.file_id, b.ligne, b.col_idx, CASE WHEN coalesce(n.bare, '') = '' THEN 'unnamed:_' || b.col_idx ELSE n.nom END AS nom, b.value
FROM b LEFT JOIN n ON n.file_id = b.file_id AND n.col_idx = b.col_idx
