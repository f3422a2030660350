-- name: append_rows
-- columns: id:i date_op:t categorie:s rue_id:i type_op:s rubrique:s montant:d beneficiaire:s reference_piece:s mode_paiement:s valide:i observation:s observations:s
SELECT * FROM caisse_chantier
UNION ALL
SELECT (SELECT max(id) FROM caisse_chantier) + row_number() OVER (ORDER BY id), date_maintenance, 'CHANTIER', NULL, 'Dépense', type_maintenance, cout,
       '', '', 'Espèces', 0, '', '' FROM maintenance_materiels

-- name: upsert_rows
-- columns: id:i date_pointage:t personnel_id:i rue_id:i statut:s heures_travaillees:d heures_normales:d heures_sup:d tache:s observation:s
WITH c AS (
  SELECT max(id) AS id, date_suivi AS date_pointage, materiel_id AS personnel_id, max_by(heures_travail, id) AS h
  FROM suivi_materiels GROUP BY date_suivi, materiel_id)
SELECT id, date_pointage, personnel_id, NULL AS rue_id, 'Mission' AS statut, h AS heures_travaillees, 8 AS heures_normales, 0 AS heures_sup,
       '' AS tache, '' AS observation FROM c
UNION ALL
SELECT p.* FROM pointage p LEFT JOIN c ON c.date_pointage = p.date_pointage AND c.personnel_id = p.personnel_id WHERE c.id IS NULL

-- name: insert_ignore
-- columns: id:i nom:s unite:s categorie:s stock_initial:d seuil_alerte:d prix_unitaire:d
WITH n AS (SELECT min(id) + 1000000 AS id, designation AS nom FROM devis_rue GROUP BY designation
           UNION ALL SELECT id + 2000000, nom FROM materiaux)
SELECT * FROM materiaux
UNION ALL
SELECT id, nom, 'U', 'Matériau', 0, 0, 0 FROM n WHERE NOT EXISTS (SELECT 1 FROM materiaux m WHERE m.nom = n.nom)

-- name: update_rows
-- columns: id:i nom:s unite:s categorie:s stock_initial:d seuil_alerte:d prix_unitaire:d
SELECT m.id, m.nom, m.unite, m.categorie, m.stock_initial, m.seuil_alerte, CASE WHEN v.materiau_id IS NULL THEN m.prix_unitaire ELSE v.pu END AS prix_unitaire
FROM materiaux m LEFT JOIN (SELECT materiau_id, max(prix_unitaire) AS pu FROM mouvements_materiaux WHERE type_mvt = 'ENTREE' GROUP BY 1) v
  ON v.materiau_id = m.id

-- name: replace_slice
-- columns: id:i rue_id:i livrable_id:i code_poste:s designation:s unite:s quantite_marche:d prix_unitaire:d observation:s
WITH p AS (
  SELECT CAST(p_partkey % 25 AS INT) AS f, (p_partkey % 25) % 6 + 1 + floor(p_partkey / 25) AS r, p_brand AS code, p_name AS nm, p_type AS un, p_size::DOUBLE AS q,
         CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END AS pu
  FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND p_partkey % 25 NOT IN (7, 8)
  UNION ALL
  SELECT 50, 9 + floor(p_partkey / 50), p_brand, p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) FROM part WHERE p_partkey % 50 = 1),
n AS (SELECT CAST(r * 100 + f + 1000000000 AS BIGINT) AS id, f % 25 % (SELECT count(*) FROM supplier) AS rue_id, NULL::BIGINT AS livrable_id, code, nm, un, q, pu, '' AS observation FROM p)
SELECT * FROM devis_rue WHERE rue_id NOT IN (SELECT n_nationkey % (SELECT count(*) FROM supplier) FROM nation WHERE n_nationkey NOT IN (7, 8))
UNION ALL SELECT * FROM n

-- name: cascade_delete
-- columns: table_name:s id:s lien:i
WITH s AS (SELECT id FROM rues WHERE statut_chantier = 'Terminé'),
t AS (SELECT id FROM sous_traitants WHERE rue_id IN (FROM s)), p AS (SELECT id FROM personnel WHERE rue_id IN (FROM s)),
d AS (SELECT id FROM devis_rue WHERE rue_id IN (FROM s)), l AS (SELECT id FROM livrables WHERE chantier_id IN (FROM s)),
e AS (SELECT id FROM devis_st WHERE rue_id IN (FROM s) OR st_id IN (FROM t)), a AS (SELECT id FROM approvisionnements WHERE rue_id IN (FROM s))
SELECT 'rues' AS table_name, CAST(id AS VARCHAR) AS id, NULL::BIGINT AS lien FROM rues WHERE id NOT IN (FROM s)
UNION ALL SELECT 'livrables', CAST(id AS VARCHAR), NULL FROM livrables WHERE id NOT IN (FROM l)
UNION ALL SELECT 'devis_rue', CAST(id AS VARCHAR), CASE WHEN livrable_id NOT IN (FROM l) THEN livrable_id END FROM devis_rue WHERE id NOT IN (FROM d)
UNION ALL SELECT 'realisations_journalieres', CAST(id AS VARCHAR), NULL FROM realisations_journalieres WHERE rue_id NOT IN (FROM s) AND devis_id NOT IN (FROM d)
UNION ALL SELECT 'sous_traitants', CAST(id AS VARCHAR), NULL FROM sous_traitants WHERE id NOT IN (FROM t)
UNION ALL SELECT 'devis_st', CAST(id AS VARCHAR), NULL FROM devis_st WHERE id NOT IN (FROM e)
UNION ALL SELECT 'decomptes_st', CAST(id AS VARCHAR), NULL FROM decomptes_st WHERE st_id NOT IN (FROM t) AND devis_st_id NOT IN (FROM e)
UNION ALL SELECT 'paiements_st', CAST(id AS VARCHAR), NULL FROM paiements_st WHERE st_id NOT IN (FROM t)
UNION ALL SELECT 'personnel', CAST(id AS VARCHAR), NULL FROM personnel WHERE id NOT IN (FROM p)
UNION ALL SELECT 'pointage', CAST(id AS VARCHAR), NULL FROM pointage WHERE personnel_id NOT IN (FROM p) AND (rue_id IS NULL OR rue_id NOT IN (FROM s))
UNION ALL SELECT 'approvisionnements', CAST(id AS VARCHAR), NULL FROM approvisionnements WHERE id NOT IN (FROM a)
UNION ALL SELECT 'receptions_appro', CAST(id AS VARCHAR), NULL FROM receptions_appro WHERE appro_id NOT IN (FROM a)
UNION ALL SELECT 'mouvements_materiaux', CAST(id AS VARCHAR), NULL FROM mouvements_materiaux WHERE rue_id IS NULL OR rue_id NOT IN (FROM s)
UNION ALL SELECT 'materiels', CAST(id AS VARCHAR), CASE WHEN rue_id_affectation NOT IN (FROM s) THEN rue_id_affectation END FROM materiels
UNION ALL SELECT 'maintenance_materiels', CAST(id AS VARCHAR), NULL FROM maintenance_materiels
UNION ALL SELECT 'suivi_materiels', CAST(id AS VARCHAR), NULL FROM suivi_materiels WHERE rue_id NOT IN (FROM s)
UNION ALL SELECT 'journal_chantier', CAST(id AS VARCHAR), NULL FROM journal_chantier WHERE rue_id NOT IN (FROM s)
UNION ALL SELECT 'caisse_chantier', CAST(id AS VARCHAR), NULL FROM caisse_chantier WHERE rue_id NOT IN (FROM s)
UNION ALL SELECT 'courriers', CAST(id AS VARCHAR), NULL FROM courriers WHERE rue_id IS NULL OR rue_id NOT IN (FROM s)
UNION ALL SELECT 'incidents', CAST(id AS VARCHAR), NULL FROM incidents WHERE rue_id NOT IN (FROM s)

-- name: audit_diff
-- columns: timestamp:ts table_name:s action:s record_id:i details:s
WITH c AS (
  SELECT id, CASE WHEN categorie = 'Consommable' THEN 'DELETE' ELSE 'UPDATE' END AS action,
         CASE WHEN categorie = 'Consommable' THEN '' ELSE concat_ws(',',
           CASE WHEN unite IN ('PROMO', 'MEDIUM') AND seuil_alerte <> 0 THEN 'seuil_alerte' END,
           CASE WHEN unite IN ('PROMO', 'SMALL') THEN 'prix_unitaire' END) END AS details
  FROM materiaux)
SELECT TIMESTAMP '2024-02-01 08:00:00' AS timestamp, 'materiaux' AS table_name, action, id AS record_id, details
FROM c WHERE action = 'DELETE' OR details <> ''
UNION ALL
SELECT TIMESTAMP '2024-02-01 08:00:00', 'materiaux', 'CREATE', id + 5000000000, '' FROM devis_rue

-- name: dq_unique
-- columns: table_name:s colonne:s n:i
SELECT 'dossiers' AS table_name, 'nom' AS colonne, 0 AS n
UNION ALL SELECT 'sous_traitants', 'nom', count(*) FROM (SELECT right(nom, 1) AS x FROM sous_traitants GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'materiaux', 'nom', count(*) FROM (SELECT split_part(nom, ' #', 1) AS x FROM materiaux GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'materiels', 'nom', 0

-- name: dq_required
-- columns: table_name:s colonne:s n:i
SELECT 'dossiers' AS table_name, 'nom' AS colonne, 0 AS n
UNION ALL SELECT 'rues', 'nom', 0 UNION ALL SELECT 'livrables', 'nom', 0
UNION ALL SELECT 'devis_rue', 'designation', count(*) FROM devis_rue WHERE id % 6 = 0
UNION ALL SELECT 'devis_rue', 'unite', count(*) FROM devis_rue WHERE id % 9 = 0
UNION ALL SELECT 'sous_traitants', 'nom', 0 UNION ALL SELECT 'devis_st', 'designation', 0 UNION ALL SELECT 'devis_st', 'unite', 0
UNION ALL SELECT 'personnel', 'nom', count(*) FROM personnel WHERE prenom IS NULL
UNION ALL SELECT 'approvisionnements', 'designation', 0 UNION ALL SELECT 'materiaux', 'nom', 0
UNION ALL SELECT 'materiaux', 'unite', 0 UNION ALL SELECT 'materiels', 'nom', 0

-- name: dq_domain
-- columns: table_name:s colonne:s n:i
SELECT 'dossiers' AS table_name, 'statut' AS colonne, count(*) AS n FROM dossiers
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR statut NOT IN ('En cours', 'Terminé', 'Suspendu', 'En préparation')
UNION ALL SELECT 'rues' AS table_name, 'statut_chantier' AS colonne, count(*) AS n FROM rues
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR statut_chantier NOT IN ('En cours', 'Terminé', 'Suspendu', 'Non démarré')
UNION ALL SELECT 'devis_rue' AS table_name, 'unite' AS colonne, count(*) AS n FROM devis_rue
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR unite NOT IN ('ml', 'm', 'km', 'm²', 'm2', 'ha', 'km²', 'm³', 'm3', 'L', 'l', 'litre', 'kg', 'T', 'tonne', 'quintal', 'U', 'unité', 'Ens', 'ensemble', 'Ft', 'forfait', 'Lot', 'lot', 'h', 'j', 'mois', 'semaine', 'sac', 'palette', 'rouleau', 'ml²', 'Ml', 'barre')
UNION ALL SELECT 'sous_traitants' AS table_name, 'statut' AS colonne, count(*) AS n FROM sous_traitants
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR statut NOT IN ('Actif', 'Terminé', 'Suspendu')
UNION ALL SELECT 'paiements_st' AS table_name, 'mode_paiement' AS colonne, count(*) AS n FROM paiements_st
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR mode_paiement NOT IN ('Virement', 'Chèque', 'Espèces', 'Mobile Money')
UNION ALL SELECT 'personnel' AS table_name, 'categorie' AS colonne, count(*) AS n FROM personnel
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR categorie NOT IN ('Directeur de projet', 'Chef de chantier', 'Conducteur de travaux', 'Ingénieur', 'Technicien', 'Chef d''équipe', 'Ouvrier qualifié', 'Ouvrier', 'Manœuvre', 'Conducteur d''engins', 'Chauffeur', 'Gardien', 'Autre')
UNION ALL SELECT 'pointage' AS table_name, 'statut' AS colonne, count(*) AS n FROM pointage
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR statut NOT IN ('Présent', 'Absent', 'Congé', 'Maladie', 'Mission')
UNION ALL SELECT 'materiaux' AS table_name, 'categorie' AS colonne, count(*) AS n FROM materiaux
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR categorie NOT IN ('Matériau', 'Carburant', 'Consommable', 'Fourniture', 'Autre')
UNION ALL SELECT 'approvisionnements' AS table_name, 'statut' AS colonne, count(*) AS n FROM approvisionnements
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR statut NOT IN ('Besoin exprimé', 'Validé chef chantier', 'Bon de commande émis', 'Réceptionné', 'Mis en stock', 'Rejeté')
UNION ALL SELECT 'mouvements_materiaux' AS table_name, 'type_mvt' AS colonne, count(*) AS n FROM mouvements_materiaux
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR type_mvt NOT IN ('ENTREE', 'SORTIE')
UNION ALL SELECT 'materiels' AS table_name, 'type_materiel' AS colonne, count(*) AS n FROM materiels
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR type_materiel NOT IN ('Engin de terrassement', 'Camion', 'Grue', 'Compacteur', 'Centrale à béton', 'Groupe électrogène', 'Pompe', 'Outillage', 'Autre', 'Engin TP', 'Véhicule')
UNION ALL SELECT 'materiels' AS table_name, 'etat' AS colonne, count(*) AS n FROM materiels
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR etat NOT IN ('Opérationnel', 'En panne', 'En maintenance', 'Hors service')
UNION ALL SELECT 'maintenance_materiels' AS table_name, 'type_maintenance' AS colonne, count(*) AS n FROM maintenance_materiels
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR type_maintenance NOT IN ('Préventive', 'Corrective', 'Vidange', 'Réparation', 'Autre')
UNION ALL SELECT 'caisse_chantier' AS table_name, 'type_op' AS colonne, count(*) AS n FROM caisse_chantier
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR type_op NOT IN ('Dépense', 'Recette', 'Avance')
UNION ALL SELECT 'caisse_chantier' AS table_name, 'categorie' AS colonne, count(*) AS n FROM caisse_chantier
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR categorie NOT IN ('Main d''œuvre', 'Matériaux', 'Transport', 'Sous-traitance', 'Divers')
UNION ALL SELECT 'courriers' AS table_name, 'type_courrier' AS colonne, count(*) AS n FROM courriers
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR type_courrier NOT IN ('Entrant', 'Sortant', 'Interne')
UNION ALL SELECT 'courriers' AS table_name, 'priorite' AS colonne, count(*) AS n FROM courriers
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR priorite NOT IN ('Normale', 'Urgente', 'Confidentielle')
UNION ALL SELECT 'incidents' AS table_name, 'gravite' AS colonne, count(*) AS n FROM incidents
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR gravite NOT IN ('Mineur', 'Modéré', 'Grave', 'Très grave', 'Critique')
UNION ALL SELECT 'incidents' AS table_name, 'type_incident' AS colonne, count(*) AS n FROM incidents
  WHERE right(CAST(id AS VARCHAR), 1) = '3' OR type_incident NOT IN ('Accident corporel', 'Accident matériel', 'Presqu''accident', 'Incident environnemental', 'Violation sécurité', 'Autre')

-- name: dq_range
-- columns: table_name:s colonne:s n:i
SELECT 'devis_rue' AS table_name, 'quantite_marche' AS colonne, count(*) AS n FROM devis_rue WHERE right(CAST(id AS VARCHAR), 1) = '4' OR quantite_marche < 0
UNION ALL SELECT 'devis_rue' AS table_name, 'prix_unitaire' AS colonne, count(*) AS n FROM devis_rue WHERE right(CAST(id AS VARCHAR), 1) = '4' OR prix_unitaire < 0
UNION ALL SELECT 'devis_st' AS table_name, 'quantite' AS colonne, count(*) AS n FROM devis_st WHERE right(CAST(id AS VARCHAR), 1) = '4' OR quantite < 0
UNION ALL SELECT 'devis_st' AS table_name, 'prix_unitaire' AS colonne, count(*) AS n FROM devis_st WHERE right(CAST(id AS VARCHAR), 1) = '4' OR prix_unitaire < 0
UNION ALL SELECT 'sous_traitants' AS table_name, 'montant_contrat' AS colonne, count(*) AS n FROM sous_traitants WHERE right(CAST(id AS VARCHAR), 1) = '4' OR montant_contrat < 0
UNION ALL SELECT 'personnel' AS table_name, 'salaire_journalier' AS colonne, count(*) AS n FROM personnel WHERE right(CAST(id AS VARCHAR), 1) = '4' OR salaire_journalier < 0
UNION ALL SELECT 'pointage' AS table_name, 'heures_travaillees' AS colonne, count(*) AS n FROM pointage WHERE right(CAST(id AS VARCHAR), 1) = '4' OR heures_travaillees < 0 OR heures_travaillees > 24
UNION ALL SELECT 'approvisionnements' AS table_name, 'quantite_demandee' AS colonne, count(*) AS n FROM approvisionnements WHERE right(CAST(id AS VARCHAR), 1) = '4' OR quantite_demandee < 0.01
UNION ALL SELECT 'caisse_chantier' AS table_name, 'montant' AS colonne, count(*) AS n FROM caisse_chantier WHERE right(CAST(id AS VARCHAR), 1) = '4' OR montant < 0.01
UNION ALL SELECT 'mouvements_materiaux' AS table_name, 'quantite' AS colonne, count(*) AS n FROM mouvements_materiaux WHERE right(CAST(id AS VARCHAR), 1) = '4' OR quantite < 0.01

-- name: dq_orphans
-- columns: table_name:s colonne:s n:i
WITH r AS (SELECT id FROM rues WHERE statut_chantier <> 'Terminé'), m AS (SELECT id FROM materiaux WHERE categorie <> 'Consommable'),
t AS (SELECT id FROM sous_traitants WHERE statut <> 'Suspendu'), p AS (SELECT id FROM personnel WHERE actif = 1),
e AS (SELECT id FROM materiels WHERE etat = 'Opérationnel'), o AS (SELECT id FROM dossiers WHERE statut = 'En cours')
SELECT 'rues' AS table_name, 'dossier_id' AS colonne, count(*) AS n FROM rues WHERE statut_chantier <> 'Terminé' AND dossier_id NOT IN (FROM o)
UNION ALL SELECT 'livrables', 'chantier_id', count(*) FROM livrables WHERE chantier_id NOT IN (FROM r)
UNION ALL SELECT 'devis_rue', 'rue_id', count(*) FROM devis_rue WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'devis_rue', 'livrable_id', 0
UNION ALL SELECT 'realisations_journalieres', 'rue_id', count(*) FROM realisations_journalieres WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'realisations_journalieres', 'devis_id', 0
UNION ALL SELECT 'sous_traitants', 'rue_id', count(*) FROM sous_traitants WHERE statut <> 'Suspendu' AND rue_id NOT IN (FROM r)
UNION ALL SELECT 'devis_st', 'st_id', count(*) FROM devis_st WHERE st_id NOT IN (FROM t)
UNION ALL SELECT 'devis_st', 'rue_id', count(*) FROM devis_st WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'decomptes_st', 'st_id', count(*) FROM decomptes_st WHERE st_id NOT IN (FROM t)
UNION ALL SELECT 'decomptes_st', 'rue_id', 0 UNION ALL SELECT 'decomptes_st', 'devis_st_id', 0
UNION ALL SELECT 'paiements_st', 'st_id', count(*) FROM paiements_st WHERE st_id NOT IN (FROM t)
UNION ALL SELECT 'paiements_st', 'rue_id', 0
UNION ALL SELECT 'personnel', 'rue_id', count(*) FROM personnel WHERE actif = 1 AND rue_id NOT IN (FROM r)
UNION ALL SELECT 'pointage', 'personnel_id', count(*) FROM pointage WHERE personnel_id NOT IN (FROM p)
UNION ALL SELECT 'pointage', 'rue_id', count(*) FROM pointage WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'approvisionnements', 'rue_id', count(*) FROM approvisionnements WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'approvisionnements', 'materiau_id', count(*) FROM approvisionnements WHERE materiau_id NOT IN (FROM m)
UNION ALL SELECT 'mouvements_materiaux', 'rue_id', count(*) FROM mouvements_materiaux WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'mouvements_materiaux', 'materiau_id', count(*) FROM mouvements_materiaux WHERE materiau_id NOT IN (FROM m)
UNION ALL SELECT 'materiels', 'rue_id_affectation', 0
UNION ALL SELECT 'suivi_materiels', 'rue_id', count(*) FROM suivi_materiels WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'suivi_materiels', 'materiel_id', count(*) FROM suivi_materiels WHERE materiel_id NOT IN (FROM e)
UNION ALL SELECT 'suivi_materiels', 'carburant_materiau_id', count(*) FROM suivi_materiels WHERE carburant_materiau_id NOT IN (FROM m)
UNION ALL SELECT 'maintenance_materiels', 'materiel_id', count(*) FROM maintenance_materiels WHERE materiel_id NOT IN (FROM e)
UNION ALL SELECT 'journal_chantier', 'rue_id', count(*) FROM journal_chantier WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'caisse_chantier', 'rue_id', count(*) FROM caisse_chantier WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'courriers', 'rue_id', count(*) FROM courriers WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'incidents', 'rue_id', count(*) FROM incidents WHERE rue_id NOT IN (FROM r)
UNION ALL SELECT 'receptions_appro', 'appro_id', 0

-- name: replace_deliverable
-- columns: id:i rue_id:i livrable_id:i code_poste:s designation:s unite:s quantite_marche:d prix_unitaire:d observation:s
WITH p AS (
  SELECT CAST(p_partkey % 25 AS INT) AS f, (p_partkey % 25) % 6 + 1 + floor(p_partkey / 25) AS r, p_brand AS code, p_name AS nm, p_type AS un, p_size::DOUBLE AS q,
         CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END AS pu
  FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND p_partkey % 25 NOT IN (7, 8)
  UNION ALL
  SELECT 50, 9 + floor(p_partkey / 50), p_brand, p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) FROM part WHERE p_partkey % 50 = 1),
n AS (SELECT CAST(r * 100 + f + 1000000000 AS BIGINT) AS id, f % 25 % (SELECT count(*) FROM supplier) AS rue_id, f % 25 % (SELECT count(*) FROM supplier) * 5 + f % 4 AS livrable_id, code, nm, un, q, pu, '' AS observation FROM p),
w AS (SELECT n_nationkey AS f FROM nation WHERE n_nationkey NOT IN (7, 8) UNION ALL SELECT 50),
s AS (SELECT DISTINCT f % 25 % (SELECT count(*) FROM supplier) AS rue_id, f % 25 % (SELECT count(*) FROM supplier) * 5 + f % 4 AS livrable_id FROM w)
SELECT d.* FROM devis_rue d LEFT JOIN s ON s.rue_id = d.rue_id AND s.livrable_id = d.livrable_id WHERE s.rue_id IS NULL
UNION ALL SELECT * FROM n

-- name: replace_subcontractor
-- columns: id:i st_id:i rue_id:i code_poste:s designation:s unite:s quantite:d prix_unitaire:d observation:s
WITH p AS (
  SELECT CAST(p_partkey % 25 AS INT) AS f, (p_partkey % 25) % 6 + 1 + floor(p_partkey / 25) AS r, p_brand AS code, p_name AS nm, p_type AS un, p_size::DOUBLE AS q,
         CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END AS pu
  FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0 AND p_partkey % 25 NOT IN (7, 8)
  UNION ALL
  SELECT 50, 9 + floor(p_partkey / 50), p_brand, p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) FROM part WHERE p_partkey % 50 = 1),
n AS (SELECT CAST(r * 100 + f + 1000000000 AS BIGINT) AS id, f % 25 % (SELECT count(*) FROM supplier) AS st_id, f % 25 % (SELECT count(*) FROM supplier) AS rue_id, code, nm, un, q, pu, '' AS observation FROM p)
SELECT * FROM devis_st WHERE st_id NOT IN (SELECT n_nationkey % (SELECT count(*) FROM supplier) FROM nation WHERE n_nationkey NOT IN (7, 8))
UNION ALL SELECT * FROM n

-- name: stored_upsert
-- columns: id:i date_pointage:t personnel_id:i rue_id:i statut:s heures_travaillees:d heures_normales:d heures_sup:d tache:s observation:s
WITH c AS (
  SELECT max(id) AS id, date_suivi AS date_pointage, materiel_id AS personnel_id, max_by(heures_travail, id) AS h
  FROM suivi_materiels WHERE date_suivi >= DATE '2024-01-20' GROUP BY date_suivi, materiel_id)
SELECT id, date_pointage, personnel_id, NULL AS rue_id, 'Mission' AS statut, h AS heures_travaillees, 8 AS heures_normales, 0 AS heures_sup,
       '' AS tache, '' AS observation FROM c
UNION ALL
SELECT p.* FROM pointage p LEFT JOIN c ON c.date_pointage = p.date_pointage AND c.personnel_id = p.personnel_id WHERE c.id IS NULL

-- name: version_changes
-- columns: timestamp:ts table_name:s action:s record_id:i details:s
WITH c AS (
  SELECT max(id) AS id, date_suivi AS date_pointage, materiel_id AS personnel_id, max_by(heures_travail, id) AS h
  FROM suivi_materiels WHERE date_suivi >= DATE '2024-01-20' GROUP BY date_suivi, materiel_id),
n AS (SELECT id, date_pointage, personnel_id, NULL AS rue_id, 'Mission' AS statut, CAST(h AS DECIMAL(18,2)) AS heures_travaillees, 8 AS heures_normales, 0 AS heures_sup FROM c
      UNION ALL SELECT p.id, p.date_pointage, p.personnel_id, p.rue_id, p.statut, p.heures_travaillees, p.heures_normales, p.heures_sup
      FROM pointage p LEFT JOIN c ON c.date_pointage = p.date_pointage AND c.personnel_id = p.personnel_id WHERE c.id IS NULL),
j AS (SELECT o.id AS oi, n.id AS ni, concat_ws(',',
        CASE WHEN o.date_pointage IS DISTINCT FROM n.date_pointage THEN 'date_pointage' END,
        CASE WHEN o.personnel_id IS DISTINCT FROM n.personnel_id THEN 'personnel_id' END,
        CASE WHEN o.rue_id IS DISTINCT FROM n.rue_id THEN 'rue_id' END, CASE WHEN o.statut IS DISTINCT FROM n.statut THEN 'statut' END,
        CASE WHEN o.heures_travaillees IS DISTINCT FROM n.heures_travaillees THEN 'heures_travaillees' END,
        CASE WHEN o.heures_normales IS DISTINCT FROM n.heures_normales THEN 'heures_normales' END,
        CASE WHEN o.heures_sup IS DISTINCT FROM n.heures_sup THEN 'heures_sup' END) AS details
      FROM pointage o FULL JOIN n ON n.id = o.id)
SELECT TIMESTAMP '2024-02-01 08:00:00' AS timestamp, 'pointage' AS table_name, CASE WHEN oi IS NULL THEN 'CREATE' WHEN ni IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action,
       coalesce(oi, ni) AS record_id, CASE WHEN oi IS NULL OR ni IS NULL THEN '' ELSE details END AS details
FROM j WHERE oi IS NULL OR ni IS NULL OR details <> ''

-- name: stored_replace
-- columns: id:i date_op:t categorie:s rue_id:i type_op:s rubrique:s montant:d beneficiaire:s reference_piece:s mode_paiement:s valide:i observation:s observations:s
WITH s AS (SELECT id FROM rues WHERE statut_chantier = 'Terminé')
SELECT * FROM caisse_chantier WHERE rue_id IS NULL OR rue_id NOT IN (FROM s)
UNION ALL
SELECT id + 1000000000, date_maintenance, 'CHANTIER', materiel_id, 'Dépense', type_maintenance, cout, '', '', 'Espèces', 0, '', ''
FROM maintenance_materiels WHERE date_maintenance >= DATE '1998-01-01' AND materiel_id IN (FROM s)

-- name: stored_versions
-- columns: version:i table_name:s n:i premier_id:i dernier_id:i
WITH c AS (SELECT count(*) AS n, min(id) AS a, max(id) AS b FROM caisse_chantier),
l AS (SELECT count(*) AS n FROM maintenance_materiels WHERE date_maintenance >= DATE '1998-01-01'),
m AS (SELECT count(*) AS n, min(id) AS a, max(id) AS b FROM materiaux), k AS (SELECT count(*) AS n, min(id) AS a, max(id) AS b FROM materiaux WHERE categorie <> 'Consommable')
SELECT 0 AS version, 'caisse_chantier' AS table_name, n, a AS premier_id, b AS dernier_id FROM c
UNION ALL SELECT v, 'caisse_chantier', c.n + l.n, c.a, c.b + l.n FROM c, l, (SELECT unnest([1, 2, 3]) AS v)
UNION ALL SELECT v, 'materiaux', n, a, b FROM m, (SELECT unnest([0, 1, 2]) AS v)
UNION ALL SELECT 3, 'materiaux', n, a, b FROM k

-- name: cash_since_site
-- columns: id:i date_op:t rue_id:i type_op:s montant:d solde_cumule:d
WITH v AS (SELECT *, (SELECT max(id) FROM caisse_chantier) + row_number() OVER (ORDER BY id) AS n FROM maintenance_materiels WHERE date_maintenance >= DATE '1998-01-01'),
u AS (SELECT id, date_op, rue_id, type_op, montant FROM caisse_chantier
      UNION ALL SELECT n, date_maintenance, materiel_id, 'Dépense', cout FROM v),
w AS (SELECT *, round(sum(CASE type_op WHEN 'Recette' THEN montant ELSE -montant END) OVER (PARTITION BY rue_id ORDER BY date_op, id)) AS solde_cumule FROM u)
SELECT * FROM w WHERE date_op >= (SELECT date_trunc('month', min(date_maintenance)) FROM v)

-- name: cash_since_all
-- columns: id:i date_op:t rue_id:i type_op:s montant:d solde_cumule:d
WITH v AS (SELECT *, (SELECT max(id) FROM caisse_chantier) + row_number() OVER (ORDER BY id) AS n FROM maintenance_materiels WHERE date_maintenance >= DATE '1998-01-01'),
u AS (SELECT id, date_op, rue_id, type_op, montant FROM caisse_chantier
      UNION ALL SELECT n, date_maintenance, materiel_id, 'Dépense', cout FROM v),
w AS (SELECT *, round(sum(CASE type_op WHEN 'Recette' THEN montant ELSE -montant END) OVER (ORDER BY date_op, id)) AS solde_cumule FROM u)
SELECT * FROM w WHERE date_op >= (SELECT date_trunc('month', min(date_maintenance)) FROM v)

-- name: stored_cascade
-- columns: version:i table_name:s n:i liens:i
WITH s AS (SELECT id FROM rues WHERE statut_chantier = 'Terminé'),
t AS (SELECT id FROM sous_traitants WHERE rue_id IN (FROM s)), p AS (SELECT id FROM personnel WHERE rue_id IN (FROM s)),
d AS (SELECT id FROM devis_rue WHERE rue_id IN (FROM s)), l AS (SELECT id FROM livrables WHERE chantier_id IN (FROM s)),
e AS (SELECT id FROM devis_st WHERE rue_id IN (FROM s) OR st_id IN (FROM t)), a AS (SELECT id FROM approvisionnements WHERE rue_id IN (FROM s)),
x AS (SELECT 'rues' AS table_name, CAST(id AS VARCHAR) AS id, NULL::BIGINT AS lien FROM rues WHERE id NOT IN (FROM s)
      UNION ALL SELECT 'livrables', CAST(id AS VARCHAR), NULL FROM livrables WHERE id NOT IN (FROM l)
      UNION ALL SELECT 'devis_rue', CAST(id AS VARCHAR), CASE WHEN livrable_id NOT IN (FROM l) THEN livrable_id END FROM devis_rue WHERE id NOT IN (FROM d)
      UNION ALL SELECT 'realisations_journalieres', CAST(id AS VARCHAR), NULL FROM realisations_journalieres WHERE rue_id NOT IN (FROM s) AND devis_id NOT IN (FROM d)
      UNION ALL SELECT 'sous_traitants', CAST(id AS VARCHAR), NULL FROM sous_traitants WHERE id NOT IN (FROM t)
      UNION ALL SELECT 'devis_st', CAST(id AS VARCHAR), NULL FROM devis_st WHERE id NOT IN (FROM e)
      UNION ALL SELECT 'decomptes_st', CAST(id AS VARCHAR), NULL FROM decomptes_st WHERE st_id NOT IN (FROM t) AND devis_st_id NOT IN (FROM e)
      UNION ALL SELECT 'paiements_st', CAST(id AS VARCHAR), NULL FROM paiements_st WHERE st_id NOT IN (FROM t)
      UNION ALL SELECT 'personnel', CAST(id AS VARCHAR), NULL FROM personnel WHERE id NOT IN (FROM p)
      UNION ALL SELECT 'pointage', CAST(id AS VARCHAR), NULL FROM pointage WHERE personnel_id NOT IN (FROM p) AND (rue_id IS NULL OR rue_id NOT IN (FROM s))
      UNION ALL SELECT 'approvisionnements', CAST(id AS VARCHAR), NULL FROM approvisionnements WHERE id NOT IN (FROM a)
      UNION ALL SELECT 'receptions_appro', CAST(id AS VARCHAR), NULL FROM receptions_appro WHERE appro_id NOT IN (FROM a)
      UNION ALL SELECT 'mouvements_materiaux', CAST(id AS VARCHAR), NULL FROM mouvements_materiaux WHERE rue_id IS NULL OR rue_id NOT IN (FROM s)
      UNION ALL SELECT 'materiels', CAST(id AS VARCHAR), CASE WHEN rue_id_affectation NOT IN (FROM s) THEN rue_id_affectation END FROM materiels
      UNION ALL SELECT 'maintenance_materiels', CAST(id AS VARCHAR), NULL FROM maintenance_materiels
      UNION ALL SELECT 'suivi_materiels', CAST(id AS VARCHAR), NULL FROM suivi_materiels WHERE rue_id NOT IN (FROM s)
      UNION ALL SELECT 'journal_chantier', CAST(id AS VARCHAR), NULL FROM journal_chantier WHERE rue_id NOT IN (FROM s)
      UNION ALL SELECT 'caisse_chantier', CAST(id AS VARCHAR), NULL FROM caisse_chantier WHERE rue_id NOT IN (FROM s)
      UNION ALL SELECT 'courriers', CAST(id AS VARCHAR), NULL FROM courriers WHERE rue_id IS NULL OR rue_id NOT IN (FROM s)
      UNION ALL SELECT 'incidents', CAST(id AS VARCHAR), NULL FROM incidents WHERE rue_id NOT IN (FROM s)),
y AS (SELECT table_name, count(*) AS n, count(lien) AS liens FROM x GROUP BY 1),
z AS (SELECT 'rues' AS table_name, count(*) AS n, 0 AS liens FROM rues
      UNION ALL SELECT 'livrables' AS table_name, count(*) AS n, 0 AS liens FROM livrables
      UNION ALL SELECT 'devis_rue' AS table_name, count(*) AS n, count(livrable_id) AS liens FROM devis_rue
      UNION ALL SELECT 'realisations_journalieres' AS table_name, count(*) AS n, 0 AS liens FROM realisations_journalieres
      UNION ALL SELECT 'sous_traitants' AS table_name, count(*) AS n, 0 AS liens FROM sous_traitants
      UNION ALL SELECT 'devis_st' AS table_name, count(*) AS n, 0 AS liens FROM devis_st
      UNION ALL SELECT 'decomptes_st' AS table_name, count(*) AS n, 0 AS liens FROM decomptes_st
      UNION ALL SELECT 'paiements_st' AS table_name, count(*) AS n, 0 AS liens FROM paiements_st
      UNION ALL SELECT 'personnel' AS table_name, count(*) AS n, 0 AS liens FROM personnel
      UNION ALL SELECT 'pointage' AS table_name, count(*) AS n, 0 AS liens FROM pointage
      UNION ALL SELECT 'approvisionnements' AS table_name, count(*) AS n, 0 AS liens FROM approvisionnements
      UNION ALL SELECT 'receptions_appro' AS table_name, count(*) AS n, 0 AS liens FROM receptions_appro
      UNION ALL SELECT 'mouvements_materiaux' AS table_name, count(*) AS n, 0 AS liens FROM mouvements_materiaux
      UNION ALL SELECT 'materiels' AS table_name, count(*) AS n, count(rue_id_affectation) AS liens FROM materiels
      UNION ALL SELECT 'maintenance_materiels' AS table_name, count(*) AS n, 0 AS liens FROM maintenance_materiels
      UNION ALL SELECT 'suivi_materiels' AS table_name, count(*) AS n, 0 AS liens FROM suivi_materiels
      UNION ALL SELECT 'journal_chantier' AS table_name, count(*) AS n, 0 AS liens FROM journal_chantier
      UNION ALL SELECT 'caisse_chantier' AS table_name, count(*) AS n, 0 AS liens FROM caisse_chantier
      UNION ALL SELECT 'courriers' AS table_name, count(*) AS n, 0 AS liens FROM courriers
      UNION ALL SELECT 'incidents' AS table_name, count(*) AS n, 0 AS liens FROM incidents)
SELECT 0 AS version, * FROM z WHERE table_name IN ('rues', 'livrables', 'devis_rue', 'sous_traitants', 'devis_st', 'personnel', 'caisse_chantier', 'materiels')
UNION ALL SELECT 1, z.table_name, coalesce(y.n, 0), coalesce(y.liens, 0) FROM z LEFT JOIN y ON y.table_name = z.table_name
WHERE z.table_name IN ('rues', 'livrables', 'devis_rue', 'sous_traitants', 'devis_st', 'personnel', 'caisse_chantier', 'materiels')

-- name: overdraw_since
-- columns: id:i date_mvt:t materiau_id:i article:s quantite:d stock_avant:d
WITH v AS (SELECT * REPLACE (row_number() OVER (ORDER BY id) AS id) FROM mouvements_materiaux),
h AS (
  SELECT v.*, m.nom AS article, m.stock_initial + coalesce(sum(CASE type_mvt WHEN 'ENTREE' THEN quantite ELSE -quantite END)
    OVER (PARTITION BY materiau_id ORDER BY date_mvt, v.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS avant
  FROM v JOIN materiaux m ON m.id = v.materiau_id)
SELECT id, date_mvt, materiau_id, article, quantite, avant AS stock_avant FROM h
WHERE type_mvt = 'SORTIE' AND quantite > avant AND date_mvt >= DATE '1998-01-01'
