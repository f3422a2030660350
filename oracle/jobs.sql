-- name: param_scan
-- columns: mode_paiement:s nb:i montant:d
SELECT mode_paiement, count(*) AS nb, sum(montant) AS montant FROM paiements_st
WHERE date_paiement >= DATE '1997-01-01' AND montant > 50000 GROUP BY mode_paiement

-- name: schema_defaults
-- columns: id:i nom:s prenom:s categorie:s poste:s actif:i salaire_journalier:d telephone:s date_entree:t rue_id:i observation:s
SELECT id, nom, coalesce(prenom, '') AS prenom, categorie, '' AS poste, actif, salaire_journalier,
       '' AS telephone, NULL AS date_entree, NULL AS rue_id, '' AS observation
FROM personnel

-- name: typed_load
-- columns: id:i date_besoin:t quantite_demandee:d statut:s date_bc:t
SELECT id, CASE WHEN id % 10 <> 3 THEN date_besoin END AS date_besoin,
       CASE WHEN id % 13 <> 0 THEN quantite_demandee END AS quantite_demandee,
       CASE WHEN statut = 'Rejeté' THEN 'Rejeté' WHEN statut LIKE 'Besoin%' THEN 'Besoin exprimé' WHEN statut LIKE 'Valid%' THEN 'Validé chef chantier'
            WHEN statut LIKE 'Bon%' THEN 'Bon de commande émis' WHEN statut LIKE 'R_cep%' THEN 'Réceptionné' ELSE 'Mis en stock' END AS statut,
       NULL AS date_bc
FROM approvisionnements

-- name: lookup_filters
-- columns: source:s id:i nom:s
SELECT 'livrables' AS source, id, nom FROM livrables
UNION ALL SELECT 'materiaux', id, nom FROM materiaux WHERE categorie = 'Consommable'
UNION ALL SELECT 'personnel', id, nom FROM personnel WHERE actif = 1
UNION ALL SELECT 'devis_rue', id, designation FROM devis_rue
UNION ALL SELECT 'materiels', id, nom FROM materiels WHERE etat = 'Opérationnel'
UNION ALL SELECT 'rues', id, nom FROM rues

-- name: site_labels
-- columns: rue_id:i libelle:s
SELECT r.id AS rue_id, '[' || coalesce(d.nom, '—') || '] ' || r.nom AS libelle
FROM rues r LEFT JOIN dossiers d ON d.id = r.dossier_id

-- name: filter_status
-- columns: id:i statut:s
SELECT id, statut FROM approvisionnements
WHERE statut IN ('Bon de commande émis', 'Réceptionné') AND statut != 'Mis en stock'

-- name: filter_mail
-- columns: id:i date_courrier:t reference:s expediteur:s destinataire:s type_courrier:s priorite:s chantier:s objet:s statut:s
SELECT c.id, c.date_courrier, c.reference, c.expediteur, c.destinataire, c.type_courrier, c.priorite, coalesce(r.nom, 'Général') AS chantier, c.objet, c.statut
FROM courriers c LEFT JOIN rues r ON r.id = c.rue_id
WHERE c.type_courrier = 'Entrant' AND c.statut = 'Nouveau'
ORDER BY c.date_courrier DESC, c.id DESC LIMIT 200

-- name: filter_period
-- columns: id:i date_pointage:t personnel_id:i statut:s
SELECT id, date_pointage, personnel_id, statut FROM pointage WHERE date_pointage >= DATE '2024-01-30' - 7

-- name: filter_range
-- columns: id:i date_op:t montant:d
SELECT id, date_op, montant FROM caisse_chantier WHERE date_op BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'

-- name: filter_month
-- columns: id:i date_op:t chantier:s type_op:s categorie:s montant:d beneficiaire:s reference_piece:s
SELECT c.id, c.date_op, coalesce(r.nom, '—') AS chantier, c.type_op, c.categorie, c.montant, c.beneficiaire, c.reference_piece
FROM caisse_chantier c LEFT JOIN rues r ON r.id = c.rue_id
WHERE strftime(c.date_op, '%Y-%m') = '1997-03'

-- name: audit_log_view
-- columns: id:i timestamp:ts table_name:s action:s record_id:i details:s
SELECT id, timestamp, table_name, action, record_id, details FROM audit_log
WHERE timestamp >= DATE '2024-01-30' - 30 AND table_name LIKE '%devis%' AND action = 'UPDATE'
ORDER BY timestamp DESC, id DESC LIMIT 500

-- name: fuel_materials
-- columns: id:i nom:s unite:s
SELECT id, nom, unite FROM materiaux WHERE lower(categorie) = 'carburant'

-- name: operational_plant
-- columns: id:i nom:s
SELECT id, nom FROM materiels WHERE etat = 'Opérationnel'

-- name: boq_lines
-- columns: id:i rue_id:i code_poste:s designation:s unite:s quantite_marche:d prix_unitaire:d montant:d
SELECT id, rue_id, code_poste, designation, unite, quantite_marche, prix_unitaire,
       quantite_marche * prix_unitaire AS montant FROM devis_rue

-- name: boq_lines_total
-- columns: nb_postes:i montant_total:d
SELECT count(*) AS nb_postes, sum(quantite_marche * prix_unitaire) AS montant_total FROM devis_rue

-- name: join_site
-- columns: id:i chantier:s montant:d
SELECT c.id, coalesce(r.nom, '—') AS chantier, c.montant FROM caisse_chantier c LEFT JOIN rues r ON r.id = c.rue_id

-- name: join_inner_left
-- columns: id:i engin:s chantier:s carburant:s carburant_consomme:d
SELECT s.id, m.nom AS engin, coalesce(r.nom, '—') AS chantier, coalesce(ma.nom, '—') AS carburant, s.carburant_consomme
FROM suivi_materiels s JOIN materiels m ON m.id = s.materiel_id
LEFT JOIN rues r ON r.id = s.rue_id LEFT JOIN materiaux ma ON ma.id = s.carburant_materiau_id

-- name: name_to_id
-- columns: ligne:i materiau_id:i
SELECT d.id AS ligne, m.id AS materiau_id
FROM devis_rue d LEFT JOIN materiaux m
  ON m.nom = d.designation || ' #' || CAST(CASE WHEN d.id % 10 = 0 THEN d.id + 100000000 ELSE d.id END AS VARCHAR)

-- name: distinct_values
-- columns: unite:s premier_id:i
SELECT unite, min(id) AS premier_id FROM devis_rue WHERE unite IS NOT NULL GROUP BY unite

-- name: numeric_summary
-- columns: colonne:s total:d
SELECT 'montant_contrat' AS colonne, sum(montant_contrat) AS total FROM sous_traitants
UNION ALL
SELECT 'montant_devis', (SELECT sum(quantite * prix_unitaire) FROM devis_st)
UNION ALL
SELECT 'total_decompte', (SELECT sum(montant) FROM decomptes_st)

-- name: cash_running_site
-- columns: id:i date_op:t rue_id:i type_op:s montant:d solde_cumule:d
SELECT id, date_op, rue_id, type_op, montant,
       round(sum(CASE type_op WHEN 'Recette' THEN montant ELSE -montant END)
             OVER (PARTITION BY rue_id ORDER BY date_op, id ROWS UNBOUNDED PRECEDING), 0) AS solde_cumule
FROM caisse_chantier

-- name: cash_running_all
-- columns: id:i date_op:t rue_id:i type_op:s montant:d solde_cumule:d
SELECT id, date_op, rue_id, type_op, montant,
       round(sum(CASE type_op WHEN 'Recette' THEN montant ELSE -montant END)
             OVER (ORDER BY date_op, id ROWS UNBOUNDED PRECEDING), 0) AS solde_cumule
FROM caisse_chantier

-- name: boq_islands
-- columns: rue_id:i id:i livrable:s groupe:i
WITH l AS (
  SELECT d.rue_id, d.id, d.livrable_id, coalesce(v.nom, 'Sans livrable') AS livrable
  FROM devis_rue d LEFT JOIN livrables v ON v.id = d.livrable_id
), f AS (
  SELECT *, CASE WHEN lag(livrable) OVER w = livrable THEN 0 ELSE 1 END AS neuf
  FROM l WINDOW w AS (PARTITION BY rue_id ORDER BY livrable_id NULLS FIRST, id)
)
SELECT rue_id, id, livrable,
       sum(neuf) OVER (PARTITION BY rue_id ORDER BY livrable_id NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS groupe
FROM f

-- name: first_per_key
-- columns: designation:s unite:s prix_unitaire:d
SELECT designation, unite, prix_unitaire FROM (
  SELECT *, row_number() OVER (PARTITION BY designation ORDER BY id) AS n FROM devis_rue) WHERE n = 1

-- name: latest_k
-- columns: id:i date_paiement:t montant:d
SELECT id, date_paiement, montant FROM paiements_st ORDER BY date_paiement DESC, id DESC LIMIT 100

-- name: site_delays
-- columns: rue_id:i chantier:s delai_jours:d jours_consommes:i jours_restants:i pct_delai:d
WITH r AS (SELECT *, date_diff('day', date_demarrage, DATE '2001-08-01') AS e FROM rues)
SELECT id AS rue_id, nom AS chantier, delai_jours,
       CASE WHEN e IS NULL OR delai_jours = 0 THEN 0 WHEN e < 0 THEN 0 ELSE e END AS jours_consommes,
       CASE WHEN e IS NULL OR delai_jours = 0 THEN delai_jours ELSE delai_jours - e END AS jours_restants,
       CASE WHEN e IS NULL OR delai_jours = 0 THEN 0 ELSE least(100, round(e::DOUBLE / delai_jours::DOUBLE * 100, 1)) END AS pct_delai
FROM r

-- name: site_schedule
-- columns: rue_id:i chantier:s date_demarrage:t fin_prevue:t depassement:b tranche:s delai_mois:d
WITH r AS (SELECT *, date_diff('day', date_demarrage, DATE '2001-08-01') AS e FROM rues),
p AS (SELECT *, CASE WHEN e IS NULL OR delai_jours = 0 THEN 0 ELSE least(100, round(e::DOUBLE / delai_jours::DOUBLE * 100, 1)) END AS pct FROM r)
SELECT id AS rue_id, nom AS chantier, date_demarrage, date_demarrage + CAST(delai_jours AS INT) AS fin_prevue,
       CASE WHEN e IS NULL OR delai_jours = 0 THEN delai_jours < 0 ELSE delai_jours - e < 0 END AS depassement,
       CASE WHEN delai_jours = 0 THEN NULL WHEN pct < 75 THEN 'ok' WHEN pct < 100 THEN 'a surveiller' ELSE 'en retard' END AS tranche,
       CASE WHEN delai_jours = 0 THEN NULL ELSE round(delai_jours::DOUBLE / 30, 1) END AS delai_mois
FROM p

-- name: format_amounts
-- columns: id:i montant_texte:s pct_texte:s
SELECT id, replace(format('{:,.0f}', (quantite_marche * prix_unitaire)::DOUBLE), ',', ' ') || ' €' AS montant_texte,
       format('{:.1f} %', round(prix_unitaire::DOUBLE / 7, 1)) AS pct_texte
FROM devis_rue

-- name: date_parts
-- columns: id:i lundi:t mois:s jour:s debut_annee:t jours:i lendemain:t
SELECT id, date_trunc('week', date_besoin)::DATE AS lundi, strftime(date_besoin, '%Y-%m') AS mois,
       strftime(date_besoin, '%d/%m/%Y') AS jour, make_date(year(date_besoin), 1, 1) AS debut_annee,
       DATE '2001-08-01' - date_besoin AS jours, date_besoin + 1 AS lendemain
FROM approvisionnements

-- name: diary_notes
-- columns: id:i observations:s
SELECT id, trim(
  CASE WHEN nb_ouvriers = 0 THEN '' ELSE 'INCIDENTS/SÉCURITÉ: ' || nb_ouvriers || chr(10) END ||
  CASE WHEN id % 3 = 0 THEN '' ELSE 'LIVRAISONS/RÉCEPTIONS: L' || id || chr(10) END ||
  CASE WHEN id % 5 = 0 THEN 'VISITES/RÉUNIONS: V' || chr(10) ELSE '' END ||
  CASE WHEN trim(travaux_realises) = '' THEN '' ELSE 'OBSERVATIONS: ' || trim(travaux_realises) END, chr(10)) AS observations
FROM journal_chantier

-- name: unit_check
-- columns: file_id:i row_idx:i unite:s connue:b
SELECT file_id, row_idx, CASE WHEN coalesce(bare, '') = '' THEN '?' ELSE bare END AS unite,
       coalesce(bare IN ('ml','m','km','m²','m2','ha','km²','m³','m3','L','l','litre','kg','T','tonne',
         'quintal','U','unité','Ens','ensemble','Ft','forfait','Lot','lot','h','j','mois','semaine','sac','palette',
         'rouleau','ml²','Ml','barre'), false) AS connue
FROM (SELECT *, regexp_replace(value, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') AS bare FROM raw_cells WHERE col_idx = 2)

-- name: kpi_present
-- columns: presents:i
SELECT count(*) AS presents FROM pointage WHERE date_pointage = DATE '2024-01-15' AND statut = 'Présent'

-- name: kpi_cash
-- columns: recettes:d depenses:d avances:d solde:d
WITH s AS (
  SELECT coalesce((SELECT sum(montant) FROM caisse_chantier WHERE type_op = 'Recette'), 0) AS recettes,
         coalesce((SELECT sum(montant) FROM caisse_chantier WHERE type_op = 'Dépense'), 0) AS depenses,
         coalesce((SELECT sum(montant) FROM caisse_chantier WHERE type_op = 'Avance'), 0) AS avances)
SELECT *, recettes - depenses - avances AS solde FROM s

-- name: kpi_counts
-- columns: incidents_ouverts:i appros_en_attente:i nb_dossiers:i nb_chantiers:i
SELECT (SELECT count(*) FROM incidents WHERE cloture = 0) AS incidents_ouverts,
       (SELECT count(*) FROM approvisionnements WHERE statut != 'Mis en stock') AS appros_en_attente,
       (SELECT count(*) FROM dossiers) AS nb_dossiers, (SELECT count(*) FROM rues) AS nb_chantiers

-- name: kpi_execution
-- columns: montant_marche:d montant_execute:d taux_pct:d
SELECT (SELECT sum(quantite_marche * prix_unitaire) FROM devis_rue) AS montant_marche,
       sum(x.quantite_jour * d.prix_unitaire) AS montant_execute,
       round(sum(x.quantite_jour * d.prix_unitaire)::DOUBLE /
             (SELECT sum(quantite_marche * prix_unitaire) FROM devis_rue)::DOUBLE * 100, 1) AS taux_pct
FROM realisations_journalieres x JOIN devis_rue d ON d.id = x.devis_id

-- name: site_progress
-- columns: rue_id:i chantier:s dossier:s montant_marche:d montant_execute:d taux_pct:d
WITH x AS (
  SELECT d.rue_id, sum(q.qe * d.prix_unitaire) AS me, sum(d.quantite_marche * d.prix_unitaire) AS mm
  FROM devis_rue d LEFT JOIN (SELECT devis_id, sum(quantite_jour) AS qe FROM realisations_journalieres GROUP BY 1) q
    ON q.devis_id = d.id GROUP BY 1)
SELECT r.id AS rue_id, r.nom AS chantier, coalesce(p.nom, '—') AS dossier,
       round(coalesce(mm, 0), 0) AS montant_marche, round(coalesce(me, 0), 0) AS montant_execute,
       CASE WHEN mm > 0 THEN round(coalesce(me, 0)::DOUBLE / mm::DOUBLE * 100, 1) ELSE 0 END AS taux_pct
FROM rues r LEFT JOIN dossiers p ON p.id = r.dossier_id LEFT JOIN x ON x.rue_id = r.id

-- name: pending_orders_top8
-- columns: id:i date_besoin:t chantier:s designation:s statut:s
SELECT a.id, a.date_besoin, coalesce(r.nom, '—') AS chantier, a.designation, a.statut
FROM approvisionnements a LEFT JOIN rues r ON r.id = a.rue_id
WHERE a.statut != 'Mis en stock' ORDER BY a.date_besoin DESC, a.id DESC LIMIT 8

-- name: site_list
-- columns: id:i dossier:s chantier:s numero_marche:s statut_chantier:s date_demarrage:t delai_jours:d
SELECT r.id, coalesce(d.nom, '—') AS dossier, r.nom AS chantier, r.numero_marche, r.statut_chantier,
       r.date_demarrage, r.delai_jours
FROM rues r LEFT JOIN dossiers d ON d.id = r.dossier_id

-- name: site_parties
-- columns: rue_id:i chantier:s role:s intervenant:s
SELECT id AS rue_id, nom AS chantier, role, CASE WHEN trim(v) = '' THEN '—' ELSE trim(v) END AS intervenant FROM (
  SELECT id, nom, 'Maître d''ouvrage' AS role, maitre_ouvrage AS v FROM rues
  UNION ALL SELECT id, nom, 'MOA Délégué', maitre_ouvrage_delegue FROM rues
  UNION ALL SELECT id, nom, 'Bureau de contrôle', bureau_controle FROM rues
  UNION ALL SELECT id, nom, 'Laboratoire', labo FROM rues
  UNION ALL SELECT id, nom, 'Coord. sécurité', coordinateur_securite FROM rues
  UNION ALL SELECT id, nom, 'Entreprise', entreprise FROM rues)

-- name: project_sites
-- columns: id:i nom:s client:s statut:s nb_chantiers:i
SELECT d.id, d.nom, d.client, d.statut, (SELECT count(*) FROM rues r WHERE r.dossier_id = d.id) AS nb_chantiers
FROM dossiers d

-- name: site_headcount
-- columns: chantier:s categorie:s effectif:i
SELECT coalesce(r.nom, '—') AS chantier, p.categorie, count(*) AS effectif
FROM personnel p LEFT JOIN rues r ON r.id = p.rue_id WHERE p.actif = 1 GROUP BY 1, 2

-- name: site_subcontractors
-- columns: chantier:s nom:s specialite:s responsable:s
SELECT coalesce(r.nom, '—') AS chantier, s.nom, s.specialite, s.responsable
FROM sous_traitants s LEFT JOIN rues r ON r.id = s.rue_id

-- name: site_deliverables
-- columns: id:i chantier:s nom:s type_livrable:s longueur_m:d largeur_m:d
SELECT l.id, r.nom AS chantier, l.nom, l.type_livrable, l.longueur_m, l.largeur_m
FROM livrables l JOIN rues r ON r.id = l.chantier_id

-- name: boq_recap
-- columns: rue_id:i cle:s livrable:s quantite:d
SELECT d.rue_id, CASE WHEN trim(d.code_poste) <> '' THEN lower(trim(d.code_poste))
                      ELSE lower(trim(d.designation)) || '|' || lower(trim(d.unite)) END AS cle,
       coalesce(l.nom, 'Sans livrable') AS livrable, sum(d.quantite_marche) AS quantite
FROM devis_rue d LEFT JOIN livrables l ON l.id = d.livrable_id GROUP BY 1, 2, 3

-- name: boq_recap_wide
-- columns: niveau:s rue_id:i cle:s sans_livrable:d livrable_0:d livrable_1:d livrable_2:d livrable_3:d qte_totale:d montant_total:d
WITH k AS (
  SELECT d.*, CASE WHEN trim(d.code_poste) <> '' THEN lower(trim(d.code_poste))
              ELSE lower(trim(d.designation)) || '|' || lower(trim(d.unite)) END AS cle, l.nom AS ln
  FROM devis_rue d LEFT JOIN livrables l ON l.id = d.livrable_id),
w AS (
  SELECT rue_id, cle,
         sum(CASE WHEN ln IS NULL THEN quantite_marche ELSE 0 END) AS sans_livrable,
         sum(CASE WHEN ln = 'Livrable 0' THEN quantite_marche ELSE 0 END) AS livrable_0,
         sum(CASE WHEN ln = 'Livrable 1' THEN quantite_marche ELSE 0 END) AS livrable_1,
         sum(CASE WHEN ln = 'Livrable 2' THEN quantite_marche ELSE 0 END) AS livrable_2,
         sum(CASE WHEN ln = 'Livrable 3' THEN quantite_marche ELSE 0 END) AS livrable_3,
         sum(quantite_marche) AS qte_totale, sum(quantite_marche) * arg_min(prix_unitaire, id) AS montant_total
  FROM k GROUP BY 1, 2)
SELECT 'detail' AS niveau, * FROM w
UNION ALL
SELECT 'total', rue_id, NULL, sum(sans_livrable), sum(livrable_0), sum(livrable_1), sum(livrable_2), sum(livrable_3), sum(qte_totale), sum(montant_total)
FROM w GROUP BY rue_id

-- name: boq_recap_totals
-- columns: niveau:s rue_id:i cle:s code_poste:s designation:s unite:s prix_unitaire:d qte_totale:d montant_total:d
WITH k AS (
  SELECT *, CASE WHEN trim(code_poste) <> '' THEN lower(trim(code_poste))
            ELSE lower(trim(designation)) || '|' || lower(trim(unite)) END AS cle
  FROM devis_rue),
n AS (SELECT *, row_number() OVER (PARTITION BY rue_id, cle ORDER BY id) AS rn,
             sum(quantite_marche) OVER (PARTITION BY rue_id, cle) AS qt FROM k),
d AS (SELECT rue_id, cle, code_poste, designation, unite, prix_unitaire, qt, qt * prix_unitaire AS mt FROM n WHERE rn = 1)
SELECT 'detail' AS niveau, rue_id, cle, code_poste, designation, unite, prix_unitaire, qt AS qte_totale, mt AS montant_total FROM d
UNION ALL
SELECT 'total', rue_id, NULL, NULL, NULL, NULL, NULL, NULL, sum(mt) FROM d GROUP BY rue_id

-- name: work_statement
-- columns: id:i rue_id:i code_poste:s designation:s unite:s quantite_marche:d qte_executee:d reste:d taux_pct:d montant_marche:d montant_execute:d
WITH q AS (SELECT d.*, coalesce((SELECT sum(x.quantite_jour) FROM realisations_journalieres x WHERE x.devis_id = d.id), 0) AS qe FROM devis_rue d)
SELECT id, rue_id, code_poste, designation, unite, quantite_marche, qe AS qte_executee,
       CASE WHEN quantite_marche > qe THEN quantite_marche - qe ELSE 0 END AS reste,
       CASE WHEN quantite_marche = 0 THEN 0 ELSE round(qe::DOUBLE / quantite_marche::DOUBLE * 100, 1) END AS taux_pct,
       quantite_marche * prix_unitaire AS montant_marche, qe * prix_unitaire AS montant_execute
FROM q

-- name: work_statement_total
-- columns: montant_marche:d montant_execute:d taux_pct:d
WITH q AS (SELECT d.quantite_marche * d.prix_unitaire AS mm,
           coalesce((SELECT sum(x.quantite_jour) FROM realisations_journalieres x WHERE x.devis_id = d.id), 0) * d.prix_unitaire AS me FROM devis_rue d)
SELECT sum(mm) AS montant_marche, sum(me) AS montant_execute, round(sum(me)::DOUBLE / sum(mm)::DOUBLE * 100, 1) AS taux_pct FROM q

-- name: work_statement_sites
-- columns: niveau:s chantier:s montant_marche:d montant_execute:d reste:d taux_pct:d
WITH q AS (SELECT d.rue_id, d.quantite_marche * d.prix_unitaire AS mm,
           coalesce((SELECT sum(x.quantite_jour) FROM realisations_journalieres x WHERE x.devis_id = d.id), 0) * d.prix_unitaire AS me
           FROM devis_rue d),
g AS (SELECT CASE WHEN grouping(r.nom) = 0 THEN 'detail' ELSE 'total' END AS niveau, r.nom AS chantier,
             sum(mm) AS montant_marche, sum(me) AS montant_execute
      FROM q JOIN rues r ON r.id = q.rue_id GROUP BY ROLLUP (r.nom))
SELECT *, greatest(montant_marche - montant_execute, 0) AS reste,
       round(montant_execute::DOUBLE / montant_marche::DOUBLE * 100, 1) AS taux_pct FROM g

-- name: post_executions
-- columns: date_suivi:t rue_id:i devis_id:i quantite_jour:d observation:s
SELECT DATE '2024-02-01' AS date_suivi, rue_id, id AS devis_id, CAST(id % 4 AS DECIMAL(18,2)) AS quantite_jour, '' AS observation
FROM devis_rue WHERE id % 4 > 0

-- name: subcontractor_balance
-- columns: id:i nom:s specialite:s chantier:s montant_contrat:d total_paye:d solde:d statut:s
SELECT s.id, s.nom, s.specialite, coalesce(r.nom, '—') AS chantier, s.montant_contrat,
       coalesce(sum(p.montant), 0) AS total_paye, s.montant_contrat - coalesce(sum(p.montant), 0) AS solde, s.statut
FROM sous_traitants s LEFT JOIN rues r ON r.id = s.rue_id LEFT JOIN paiements_st p ON p.st_id = s.id
GROUP BY s.id, s.nom, s.specialite, r.nom, s.montant_contrat, s.statut

-- name: subcontractor_boq
-- columns: id:i st_id:i code_poste:s designation:s unite:s quantite:d prix_unitaire:d montant:d
SELECT id, st_id, code_poste, designation, unite, quantite, prix_unitaire, quantite * prix_unitaire AS montant FROM devis_st

-- name: subcontractor_boq_total
-- columns: st_id:i montant_total:d
SELECT st_id, sum(quantite * prix_unitaire) AS montant_total FROM devis_st GROUP BY st_id

-- name: post_statements
-- columns: st_id:i numero_decompte:i date_decompte:t devis_st_id:i quantite_executee:d montant:d observation:s
SELECT st_id, 3 AS numero_decompte, DATE '2024-02-01' AS date_decompte, id AS devis_st_id, id % 5 AS quantite_executee,
       (id % 5) * prix_unitaire AS montant, '' AS observation
FROM devis_st WHERE id % 5 > 0

-- name: subcontractor_statement
-- columns: id:i st_id:i rue:s code_poste:s designation:s unite:s qte_devis:d qte_executee:d taux_pct:d montant_devis:d montant_execute:d
SELECT d.id, d.st_id, r.nom AS rue, d.code_poste, d.designation, d.unite, d.quantite AS qte_devis,
       coalesce(sum(c.quantite_executee), 0) AS qte_executee,
       round(coalesce(sum(c.quantite_executee), 0)::DOUBLE / d.quantite::DOUBLE * 100, 1) AS taux_pct,
       d.quantite * d.prix_unitaire AS montant_devis, coalesce(sum(c.montant), 0) AS montant_execute
FROM devis_st d LEFT JOIN rues r ON r.id = d.rue_id LEFT JOIN decomptes_st c ON c.devis_st_id = d.id
GROUP BY d.id, d.st_id, r.nom, d.code_poste, d.designation, d.unite, d.quantite, d.prix_unitaire

-- name: subcontractor_account
-- columns: id:i nom:s montant_devis:d montant_execute:d total_paye:d solde_a_payer:d
WITH s AS (
  SELECT id, nom, coalesce((SELECT sum(quantite * prix_unitaire) FROM devis_st d WHERE d.st_id = s.id), 0) AS dv,
         coalesce((SELECT sum(c.montant) FROM decomptes_st c JOIN devis_st d ON d.id = c.devis_st_id WHERE d.st_id = s.id), 0) AS ex,
         coalesce((SELECT sum(montant) FROM paiements_st p WHERE p.st_id = s.id), 0) AS py
  FROM sous_traitants s)
SELECT id, nom, dv AS montant_devis, ex AS montant_execute, py AS total_paye, ex - py AS solde_a_payer FROM s

-- name: payments
-- columns: id:i st_id:i date_paiement:t montant:d reference:s mode_paiement:s observation:s total_paye:d
SELECT id, st_id, date_paiement, montant, reference, mode_paiement, observation,
       sum(montant) OVER (PARTITION BY st_id) AS total_paye FROM paiements_st

-- name: payroll
-- columns: niveau:s categorie:s effectif:i masse_salariale_jour:d
SELECT 'detail' AS niveau, categorie, count(*) FILTER (actif = 1) AS effectif,
       coalesce(sum(salaire_journalier) FILTER (actif = 1), 0) AS masse_salariale_jour FROM personnel GROUP BY categorie
UNION ALL
SELECT 'total', NULL, count(*) FILTER (actif = 1), coalesce(sum(salaire_journalier) FILTER (actif = 1), 0) FROM personnel

-- name: attendance_history
-- columns: id:i date_pointage:t nom:s prenom:s categorie:s statut:s heures_travaillees:d tache:s chantier:s
SELECT t.id, t.date_pointage, p.nom, p.prenom, p.categorie, t.statut, t.heures_travaillees, t.tache, coalesce(r.nom, '—') AS chantier
FROM pointage t JOIN personnel p ON p.id = t.personnel_id LEFT JOIN rues r ON r.id = t.rue_id
ORDER BY t.date_pointage DESC, p.nom, t.id LIMIT 300

-- name: attendance_batch
-- columns: id:i date_pointage:t personnel_id:i rue_id:i statut:s heures_travaillees:d heures_normales:d heures_sup:d tache:s observation:s chantier:s
WITH a AS (
  SELECT (SELECT max(id) FROM pointage) + row_number() OVER (ORDER BY id) AS id, DATE '2024-01-30' AS date_pointage,
         id AS personnel_id, NULL::BIGINT AS rue_id, 'Présent' AS statut, 8 AS heures_travaillees, 8 AS heures_normales, 0 AS heures_sup,
         '' AS tache, '' AS observation
  FROM personnel WHERE actif = 1),
t AS (
  SELECT * FROM pointage p
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.date_pointage = p.date_pointage AND a.personnel_id = p.personnel_id)
  UNION ALL SELECT * FROM a)
SELECT t.*, coalesce(r.nom, '—') AS chantier FROM t LEFT JOIN rues r ON r.id = t.rue_id

-- name: procurement_queue
-- columns: id:i date_besoin:t chantier:s designation:s unite:s quantite_demandee:d prix_unitaire_estime:d montant_estime:d statut:s
SELECT a.id, a.date_besoin, coalesce(r.nom, 'Général') AS chantier, a.designation, a.unite, a.quantite_demandee,
       a.prix_unitaire_estime, a.prix_unitaire_estime * a.quantite_demandee AS montant_estime, a.statut
FROM approvisionnements a LEFT JOIN rues r ON r.id = a.rue_id
WHERE a.statut NOT IN ('Mis en stock', 'Rejeté')

-- name: reception_status
-- columns: id:i designation:s unite:s quantite_demandee:d total_recu:d reste:d pct_recu:d etat_livraison:s
WITH x AS (
  SELECT a.*, coalesce((SELECT sum(r.quantite_recue) FROM receptions_appro r WHERE r.appro_id = a.id), 0) AS total
  FROM approvisionnements a WHERE statut IN ('Bon de commande émis', 'Réceptionné'))
SELECT id, designation, unite, quantite_demandee, total AS total_recu,
       greatest(quantite_demandee - total, 0) AS reste,
       least(100, round(total::DOUBLE / quantite_demandee::DOUBLE * 100, 1)) AS pct_recu,
       CASE statut WHEN 'Réceptionné' THEN 'Clôturé - en attente mise en stock' ELSE 'En livraison' END AS etat_livraison
FROM x

-- name: to_stock_qty
-- columns: id:i qte_a_stocker:d
SELECT a.id, CASE WHEN coalesce(sum(r.quantite_recue), 0) <> 0 THEN sum(r.quantite_recue) ELSE a.quantite_recue END AS qte_a_stocker
FROM approvisionnements a LEFT JOIN receptions_appro r ON r.appro_id = a.id
WHERE a.statut = 'Réceptionné' GROUP BY a.id, a.quantite_recue

-- name: stage_transitions
-- columns: id:i date_besoin:t rue_id:i materiau_id:i designation:s unite:s quantite_demandee:d prix_unitaire_estime:d demandeur:s motif:s statut:s date_validation_cc:t validateur_cc:s numero_bc:s date_bc:t fournisseur:s date_reception:t quantite_recue:d bon_livraison:s date_mise_stock:t quantite_mise_stock:d prix_unitaire_reel:d observation:s
WITH q AS (
  SELECT id AS appro_id, CASE WHEN id % 7 = 0 THEN 'Mis en stock' WHEN id % 20 = 1 THEN 'Rejeté'
         ELSE CASE statut WHEN 'Besoin exprimé' THEN 'Validé chef chantier' WHEN 'Validé chef chantier' THEN 'Bon de commande émis'
              WHEN 'Bon de commande émis' THEN 'Réceptionné' ELSE 'Mis en stock' END END AS cible
  FROM approvisionnements),
v AS (SELECT appro_id, cible FROM q JOIN approvisionnements a ON a.id = q.appro_id
  WHERE appro_id % 50 <> 3 AND ((a.statut = 'Besoin exprimé' AND cible IN ('Validé chef chantier', 'Rejeté'))
     OR (a.statut = 'Validé chef chantier' AND cible = 'Bon de commande émis')
     OR (a.statut = 'Bon de commande émis' AND cible = 'Réceptionné')
     OR (a.statut = 'Réceptionné' AND cible = 'Mis en stock'))),
r AS (SELECT appro_id, sum(quantite_recue) AS total FROM receptions_appro GROUP BY 1)
SELECT a.id, a.date_besoin, a.rue_id, a.materiau_id, a.designation, a.unite, a.quantite_demandee, a.prix_unitaire_estime, a.demandeur, a.motif, a.date_reception, a.bon_livraison, a.observation, coalesce(cible, statut) AS statut,
       CASE cible WHEN 'Validé chef chantier' THEN DATE '2024-02-01' END AS date_validation_cc,
       CASE cible WHEN 'Validé chef chantier' THEN 'Chef' ELSE '' END AS validateur_cc,
       CASE cible WHEN 'Bon de commande émis' THEN 'N' || a.id ELSE numero_bc END AS numero_bc,
       CASE cible WHEN 'Bon de commande émis' THEN 'F' || (a.id % 9) ELSE fournisseur END AS fournisseur,
       CASE cible WHEN 'Bon de commande émis' THEN DATE '2024-02-01' END AS date_bc,
       CASE cible WHEN 'Réceptionné' THEN coalesce(total, 0) ELSE quantite_recue END AS quantite_recue,
       CASE cible WHEN 'Mis en stock' THEN DATE '2024-02-01' END AS date_mise_stock,
       CASE cible WHEN 'Mis en stock' THEN coalesce(nullif(total, 0), quantite_recue) ELSE 0 END AS quantite_mise_stock,
       CASE cible WHEN 'Mis en stock' THEN prix_unitaire_estime ELSE 0 END AS prix_unitaire_reel
FROM approvisionnements a LEFT JOIN v ON v.appro_id = a.id LEFT JOIN r ON r.appro_id = a.id

-- name: stage_rejects
-- columns: appro_id:i ancien_statut:s cible:s motif_refus:s
WITH q AS (
  SELECT id AS appro_id, statut AS ancien_statut, CASE WHEN id % 7 = 0 THEN 'Mis en stock' WHEN id % 20 = 1 THEN 'Rejeté'
         ELSE CASE statut WHEN 'Besoin exprimé' THEN 'Validé chef chantier' WHEN 'Validé chef chantier' THEN 'Bon de commande émis'
              WHEN 'Bon de commande émis' THEN 'Réceptionné' ELSE 'Mis en stock' END END AS cible
  FROM approvisionnements)
SELECT appro_id, ancien_statut, cible, CASE WHEN appro_id % 50 = 3 THEN 'doublon' ELSE 'interdit' END AS motif_refus
FROM q, range(0, CASE WHEN appro_id % 50 = 3 THEN 2 ELSE 1 END)
WHERE appro_id % 50 = 3 OR NOT (
     (ancien_statut = 'Besoin exprimé' AND cible IN ('Validé chef chantier', 'Rejeté'))
     OR (ancien_statut = 'Validé chef chantier' AND cible = 'Bon de commande émis')
     OR (ancien_statut = 'Bon de commande émis' AND cible = 'Réceptionné')
     OR (ancien_statut = 'Réceptionné' AND cible = 'Mis en stock'))

-- name: recompute_received
-- columns: id:i date_besoin:t rue_id:i materiau_id:i designation:s unite:s quantite_demandee:d prix_unitaire_estime:d demandeur:s motif:s statut:s date_validation_cc:t validateur_cc:s numero_bc:s date_bc:t fournisseur:s date_reception:t quantite_recue:d bon_livraison:s date_mise_stock:t quantite_mise_stock:d prix_unitaire_reel:d observation:s
SELECT a.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM receptions_appro r WHERE r.appro_id = a.id AND r.quantite_recue > 45)
             THEN coalesce((SELECT sum(r.quantite_recue) FROM receptions_appro r WHERE r.appro_id = a.id AND r.quantite_recue <= 45), 0)
             ELSE a.quantite_recue END AS quantite_recue)
FROM approvisionnements a

-- name: post_stock_entries
-- columns: date_mvt:t chantier:s materiau_id:i type_mvt:s quantite:d prix_unitaire:d appro_id:i observation:s
WITH q AS (SELECT a.*, coalesce(nullif((SELECT sum(r.quantite_recue) FROM receptions_appro r WHERE r.appro_id = a.id), 0), a.quantite_recue) AS qs
           FROM approvisionnements a WHERE statut = 'Réceptionné' AND materiau_id IS NOT NULL)
SELECT DATE '2024-02-01' AS date_mvt, coalesce(r.nom, '—') AS chantier, materiau_id, 'ENTREE' AS type_mvt, qs AS quantite,
       prix_unitaire_estime AS prix_unitaire, q.id AS appro_id, 'Via Circuit Appro BC:' || coalesce(numero_bc, '') AS observation
FROM q LEFT JOIN rues r ON r.id = q.rue_id WHERE qs > 0

-- name: procurement_followup
-- columns: id:i date_besoin:t chantier:s designation:s unite:s quantite_demandee:d fournisseur:s numero_bc:s quantite_recue:d statut:s
SELECT a.id, a.date_besoin, coalesce(r.nom, '—') AS chantier, a.designation, a.unite, a.quantite_demandee, a.fournisseur,
       a.numero_bc, a.quantite_recue, a.statut
FROM approvisionnements a LEFT JOIN rues r ON r.id = a.rue_id

-- name: stock_levels
-- columns: id:i nom:s categorie:s unite:s stock:d seuil_alerte:d prix_unitaire:d valeur:d alerte:b
WITH s AS (
  SELECT m.*, m.stock_initial + coalesce((SELECT sum(CASE v.type_mvt WHEN 'ENTREE' THEN v.quantite WHEN 'SORTIE' THEN -v.quantite END)
         FROM mouvements_materiaux v WHERE v.materiau_id = m.id), 0) AS stock FROM materiaux m)
SELECT id, nom, categorie, unite, stock, seuil_alerte, prix_unitaire,
       round(CAST(stock AS DECIMAL(18,2)) * prix_unitaire, 0) AS valeur, stock <= seuil_alerte AND seuil_alerte > 0 AS alerte
FROM s

-- name: stock_alerts
-- columns: id:i nom:s unite:s stock:d seuil_alerte:d
SELECT m.id, m.nom, m.unite, m.stock_initial + coalesce(sum(CASE v.type_mvt WHEN 'ENTREE' THEN v.quantite ELSE -v.quantite END), 0) AS stock, m.seuil_alerte
FROM materiaux m LEFT JOIN mouvements_materiaux v ON v.materiau_id = m.id
GROUP BY m.id, m.nom, m.unite, m.stock_initial, m.seuil_alerte
HAVING m.stock_initial + coalesce(sum(CASE v.type_mvt WHEN 'ENTREE' THEN v.quantite ELSE -v.quantite END), 0) <= m.seuil_alerte AND m.seuil_alerte > 0

-- name: stock_overdraw
-- columns: id:s date_mvt:t materiau_id:i article:s quantite:d stock_avant:d
WITH h AS (
  SELECT v.*, m.nom AS article, m.stock_initial + coalesce(sum(CASE type_mvt WHEN 'ENTREE' THEN quantite ELSE -quantite END)
    OVER (PARTITION BY materiau_id ORDER BY date_mvt, v.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS avant
  FROM mouvements_materiaux v JOIN materiaux m ON m.id = v.materiau_id)
SELECT id, date_mvt, materiau_id, article, quantite, avant AS stock_avant FROM h WHERE type_mvt = 'SORTIE' AND quantite > avant

-- name: movement_totals
-- columns: total_entrees:d total_sorties:d dont_circuit_appro:i
SELECT sum(quantite) FILTER (type_mvt = 'ENTREE') AS total_entrees, sum(quantite) FILTER (type_mvt = 'SORTIE') AS total_sorties,
       count(appro_id) AS dont_circuit_appro FROM mouvements_materiaux

-- name: movement_history
-- columns: id:s date_mvt:t type_mvt:s article:s quantite:d prix_unitaire:d chantier:s fournisseur:s bon_livraison:s provenance:s observation:s
SELECT v.id, v.date_mvt, v.type_mvt, m.nom AS article, v.quantite, v.prix_unitaire, coalesce(r.nom, 'Général') AS chantier, v.fournisseur, v.bon_livraison,
       CASE WHEN v.appro_id IS NULL THEN 'Saisie manuelle'
            ELSE 'Circuit Appro — BC: ' || coalesce(a.numero_bc, CAST(v.appro_id AS VARCHAR)) END AS provenance, v.observation
FROM mouvements_materiaux v JOIN materiaux m ON m.id = v.materiau_id LEFT JOIN rues r ON r.id = v.rue_id
LEFT JOIN approvisionnements a ON a.id = v.appro_id ORDER BY v.date_mvt DESC, v.id DESC LIMIT 500

-- name: plant_log
-- columns: id:i date_suivi:t chantier:s engin:s heures_travail:d carburant:s carburant_consomme:d observations:s
SELECT s.id, s.date_suivi, coalesce(r.nom, '—') AS chantier, m.nom AS engin, s.heures_travail, coalesce(f.nom, '—') AS carburant, s.carburant_consomme, s.observations
FROM suivi_materiels s JOIN materiels m ON m.id = s.materiel_id LEFT JOIN rues r ON r.id = s.rue_id
LEFT JOIN materiaux f ON f.id = s.carburant_materiau_id
WHERE s.date_suivi >= DATE '2024-01-23' ORDER BY s.date_suivi DESC, s.id DESC LIMIT 200

-- name: plant_totals
-- columns: total_heures:d total_carburant:d
SELECT sum(heures_travail) AS total_heures, sum(carburant_consomme) AS total_carburant FROM suivi_materiels

-- name: fuel_to_stock
-- columns: date_mvt:t rue_id:i materiau_id:i type_mvt:s quantite:d observation:s
SELECT s.date_suivi AS date_mvt, s.rue_id, s.carburant_materiau_id AS materiau_id, 'SORTIE' AS type_mvt,
       s.carburant_consomme AS quantite, 'Carburant engin ' || m.nom AS observation
FROM suivi_materiels s JOIN materiels m ON m.id = s.materiel_id
WHERE s.carburant_materiau_id IS NOT NULL AND s.carburant_consomme > 0

-- name: maintenance_history
-- columns: id:i date_maintenance:t engin:s type_maintenance:s description:s cout:d
SELECT x.id, x.date_maintenance, m.nom AS engin, x.type_maintenance, x.description, x.cout
FROM maintenance_materiels x JOIN materiels m ON m.id = x.materiel_id ORDER BY x.date_maintenance DESC, x.id DESC LIMIT 100

-- name: maintenance_costs
-- columns: engin:s nb_interventions:i cout_total:d
SELECT m.nom AS engin, count(*) AS nb_interventions, sum(x.cout) AS cout_total
FROM maintenance_materiels x JOIN materiels m ON m.id = x.materiel_id GROUP BY m.nom

-- name: diary_list
-- columns: id:i date_journal:t chantier:s meteo:s observations:s temperature:d nb_ouvriers:i nb_encadrants:i travaux_realises:s
SELECT j.id, j.date_journal, coalesce(r.nom, 'Général') AS chantier, j.meteo, j.observations, j.temperature, j.nb_ouvriers, j.nb_encadrants, j.travaux_realises
FROM journal_chantier j LEFT JOIN rues r ON r.id = j.rue_id
WHERE j.date_journal >= DATE '2024-02-10' - 30 ORDER BY j.date_journal DESC, j.id DESC LIMIT 200

-- name: diary_weekly
-- columns: chantier:s semaine:t fin_semaine:t nb_entrees:i ouvriers_jours:i encadrants_jours:i
SELECT r.nom AS chantier, j.date_journal - (isodow(j.date_journal) - 1)::INT AS semaine,
       j.date_journal - (isodow(j.date_journal) - 1)::INT + 6 AS fin_semaine, count(*) AS nb_entrees,
       sum(nb_ouvriers) AS ouvriers_jours, sum(nb_encadrants) AS encadrants_jours
FROM journal_chantier j JOIN rues r ON r.id = j.rue_id GROUP BY 1, 2, 3

-- name: cash_month
-- columns: mois:s recettes:d depenses:d avances:d solde:d etat:s
WITH m AS (
  SELECT strftime(date_op, '%Y-%m') AS mois, coalesce(sum(montant) FILTER (type_op = 'Recette'), 0) AS recettes,
         coalesce(sum(montant) FILTER (type_op = 'Dépense'), 0) AS depenses, coalesce(sum(montant) FILTER (type_op = 'Avance'), 0) AS avances
  FROM caisse_chantier GROUP BY 1)
SELECT *, recettes - depenses - avances AS solde,
       CASE WHEN recettes - depenses - avances < 0 THEN 'Déficit' ELSE 'Excédent' END AS etat FROM m

-- name: incident_list
-- columns: id:i date_incident:t chantier:s type_incident:s gravite:s nb_victimes:i statut:s description:s
SELECT i.id, i.date_incident, coalesce(r.nom, '—') AS chantier, i.type_incident, i.gravite, i.nb_victimes, i.statut, i.description
FROM incidents i LEFT JOIN rues r ON r.id = i.rue_id WHERE i.statut = 'Ouvert' ORDER BY i.date_incident DESC, i.id DESC LIMIT 200

-- name: incident_breakdown
-- columns: statut:s gravite:s nb:i victimes:i cout:d
SELECT statut, gravite, count(*) AS nb, sum(nb_victimes) AS victimes, sum(cout_estime) AS cout FROM incidents GROUP BY 1, 2

-- name: receipt_history
-- columns: id:s appro_id:i date_reception:t quantite_recue:d bon_livraison:s observation:s
SELECT id, appro_id, date_reception, quantite_recue, bon_livraison, observation FROM receptions_appro

-- name: movement_history_article
-- columns: id:s date_mvt:t type_mvt:s article:s quantite:d prix_unitaire:d chantier:s fournisseur:s bon_livraison:s provenance:s observation:s
SELECT v.id, v.date_mvt, v.type_mvt, m.nom AS article, v.quantite, v.prix_unitaire, coalesce(r.nom, 'Général') AS chantier, v.fournisseur, v.bon_livraison,
       CASE WHEN v.appro_id IS NULL THEN 'Saisie manuelle'
            ELSE 'Circuit Appro — BC: ' || coalesce(a.numero_bc, CAST(v.appro_id AS VARCHAR)) END AS provenance, v.observation
FROM mouvements_materiaux v JOIN materiaux m ON m.id = v.materiau_id LEFT JOIN rues r ON r.id = v.rue_id
LEFT JOIN approvisionnements a ON a.id = v.appro_id WHERE v.materiau_id = 7 ORDER BY v.date_mvt DESC, v.id DESC LIMIT 5

-- name: site_work_statement
-- columns: id:i rue_id:i code_poste:s designation:s unite:s quantite_marche:d qte_executee:d reste:d taux_pct:d montant_marche:d montant_execute:d
WITH q AS (SELECT d.*, coalesce((SELECT sum(x.quantite_jour) FROM realisations_journalieres x WHERE x.devis_id = d.id), 0) AS qe FROM devis_rue d WHERE d.rue_id = 3)
SELECT id, rue_id, code_poste, designation, unite, quantite_marche, qe AS qte_executee,
       CASE WHEN quantite_marche > qe THEN quantite_marche - qe ELSE 0 END AS reste,
       CASE WHEN quantite_marche = 0 THEN 0 ELSE round(qe::DOUBLE / quantite_marche::DOUBLE * 100, 1) END AS taux_pct,
       quantite_marche * prix_unitaire AS montant_marche, qe * prix_unitaire AS montant_execute
FROM q

-- name: site_work_total
-- columns: montant_marche:d montant_execute:d taux_pct:d
WITH q AS (SELECT d.quantite_marche * d.prix_unitaire AS mm,
           coalesce((SELECT sum(x.quantite_jour) FROM realisations_journalieres x WHERE x.devis_id = d.id), 0) * d.prix_unitaire AS me FROM devis_rue d WHERE d.rue_id = 3)
SELECT sum(mm) AS montant_marche, sum(me) AS montant_execute, round(sum(me)::DOUBLE / sum(mm)::DOUBLE * 100, 1) AS taux_pct FROM q

-- name: site_progress_one
-- columns: rue_id:i chantier:s dossier:s montant_marche:d montant_execute:d taux_pct:d
WITH x AS (
  SELECT d.rue_id, sum(q.qe * d.prix_unitaire) AS me, sum(d.quantite_marche * d.prix_unitaire) AS mm
  FROM devis_rue d LEFT JOIN (SELECT devis_id, sum(quantite_jour) AS qe FROM realisations_journalieres GROUP BY 1) q
    ON q.devis_id = d.id GROUP BY 1)
SELECT r.id AS rue_id, r.nom AS chantier, coalesce(p.nom, '—') AS dossier,
       round(coalesce(mm, 0), 0) AS montant_marche, round(coalesce(me, 0), 0) AS montant_execute,
       CASE WHEN mm > 0 THEN round(coalesce(me, 0)::DOUBLE / mm::DOUBLE * 100, 1) ELSE 0 END AS taux_pct
FROM rues r LEFT JOIN dossiers p ON p.id = r.dossier_id LEFT JOIN x ON x.rue_id = r.id WHERE r.id = 3

-- name: site_present
-- columns: presents:i
SELECT count(*) AS presents FROM pointage WHERE date_pointage = DATE '2024-01-15' AND statut = 'Présent' AND rue_id = 3

-- name: site_cash
-- columns: recettes:d depenses:d avances:d solde:d
WITH s AS (
  SELECT coalesce(sum(montant) FILTER (type_op = 'Recette'), 0) AS recettes, coalesce(sum(montant) FILTER (type_op = 'Dépense'), 0) AS depenses,
         coalesce(sum(montant) FILTER (type_op = 'Avance'), 0) AS avances FROM caisse_chantier WHERE rue_id = 3)
SELECT *, recettes - depenses - avances AS solde FROM s

-- name: site_counts
-- columns: incidents_ouverts:i appros_en_attente:i nb_dossiers:i nb_chantiers:i
SELECT (SELECT count(*) FROM incidents WHERE cloture = 0 AND rue_id = 3) AS incidents_ouverts,
       (SELECT count(*) FROM approvisionnements WHERE statut <> 'Mis en stock') AS appros_en_attente,
       (SELECT count(*) FROM dossiers) AS nb_dossiers, (SELECT count(*) FROM rues) AS nb_chantiers

-- name: site_boq_lines
-- columns: id:i rue_id:i code_poste:s designation:s unite:s quantite_marche:d prix_unitaire:d montant:d
SELECT id, rue_id, code_poste, designation, unite, quantite_marche, prix_unitaire, quantite_marche * prix_unitaire AS montant
FROM devis_rue WHERE rue_id = 3 AND livrable_id = 18

-- name: name_to_id_repeated
-- columns: ligne:i materiau_id:i
SELECT d.id AS ligne, m.i AS materiau_id
FROM devis_rue d LEFT JOIN (SELECT split_part(nom, ' #', 1) AS n, min(id) AS i FROM materiaux GROUP BY 1) m ON m.n = d.designation

-- name: stock_moves
-- columns: date_mvt:t rue_id:i materiau_id:i type_mvt:s quantite:d prix_unitaire:d fournisseur:s bon_livraison:s appro_id:i observation:s
WITH o AS (WITH q AS (
  SELECT id AS appro_id, CASE WHEN id % 7 = 0 THEN 'Mis en stock' WHEN id % 20 = 1 THEN 'Rejeté'
         ELSE CASE statut WHEN 'Besoin exprimé' THEN 'Validé chef chantier' WHEN 'Validé chef chantier' THEN 'Bon de commande émis'
              WHEN 'Bon de commande émis' THEN 'Réceptionné' ELSE 'Mis en stock' END END AS cible
  FROM approvisionnements),
v AS (SELECT appro_id, cible FROM q JOIN approvisionnements a ON a.id = q.appro_id
  WHERE appro_id % 50 <> 3 AND ((a.statut = 'Besoin exprimé' AND cible IN ('Validé chef chantier', 'Rejeté'))
     OR (a.statut = 'Validé chef chantier' AND cible = 'Bon de commande émis')
     OR (a.statut = 'Bon de commande émis' AND cible = 'Réceptionné')
     OR (a.statut = 'Réceptionné' AND cible = 'Mis en stock'))),
r AS (SELECT appro_id, sum(quantite_recue) AS total FROM receptions_appro GROUP BY 1)
SELECT a.id, a.date_besoin, a.rue_id, a.materiau_id, a.designation, a.unite, a.quantite_demandee, a.prix_unitaire_estime, a.demandeur, a.motif, a.date_reception, a.bon_livraison, a.observation, coalesce(cible, statut) AS statut,
       CASE cible WHEN 'Validé chef chantier' THEN DATE '2024-02-01' END AS date_validation_cc,
       CASE cible WHEN 'Validé chef chantier' THEN 'Chef' ELSE '' END AS validateur_cc,
       CASE cible WHEN 'Bon de commande émis' THEN 'N' || a.id ELSE numero_bc END AS numero_bc,
       CASE cible WHEN 'Bon de commande émis' THEN 'F' || (a.id % 9) ELSE fournisseur END AS fournisseur,
       CASE cible WHEN 'Bon de commande émis' THEN DATE '2024-02-01' END AS date_bc,
       CASE cible WHEN 'Réceptionné' THEN coalesce(total, 0) ELSE quantite_recue END AS quantite_recue,
       CASE cible WHEN 'Mis en stock' THEN DATE '2024-02-01' END AS date_mise_stock,
       CASE cible WHEN 'Mis en stock' THEN coalesce(nullif(total, 0), quantite_recue) ELSE 0 END AS quantite_mise_stock,
       CASE cible WHEN 'Mis en stock' THEN prix_unitaire_estime ELSE 0 END AS prix_unitaire_reel
FROM approvisionnements a LEFT JOIN v ON v.appro_id = a.id LEFT JOIN r ON r.appro_id = a.id)
SELECT DATE '2024-02-01' AS date_mvt, o.rue_id, o.materiau_id, 'ENTREE' AS type_mvt, o.quantite_mise_stock AS quantite, o.prix_unitaire_reel AS prix_unitaire,
       o.fournisseur, o.bon_livraison, o.id AS appro_id, 'Via Circuit Appro BC:' || coalesce(o.numero_bc, '') AS observation
FROM o JOIN approvisionnements b ON b.id = o.id WHERE o.statut = 'Mis en stock' AND b.statut <> 'Mis en stock' AND o.materiau_id IS NOT NULL

-- name: post_receptions_orders
-- columns: id:i date_besoin:t rue_id:i materiau_id:i designation:s unite:s quantite_demandee:d prix_unitaire_estime:d demandeur:s motif:s statut:s date_validation_cc:t validateur_cc:s numero_bc:s date_bc:t fournisseur:s date_reception:t quantite_recue:d bon_livraison:s date_mise_stock:t quantite_mise_stock:d prix_unitaire_reel:d observation:s
WITH d AS (SELECT id * 10 + k AS source_id, id AS appro_id, DATE '2024-02-01' + CAST(id % 3 + k AS INT) AS date_reception, id % 4 * k AS quantite_recue,
             'BL' || id || '-' || k AS bon_livraison
      FROM (SELECT id, unnest(CASE WHEN id % 9 = 2 THEN [1, 2] ELSE [1] END) AS k FROM approvisionnements WHERE statut <> 'Rejeté')),
n AS (SELECT * FROM d WHERE quantite_recue > 0),
s AS (SELECT appro_id, sum(q) AS q FROM (SELECT appro_id, quantite_recue AS q FROM receptions_appro UNION ALL SELECT appro_id, quantite_recue FROM n) GROUP BY 1),
l AS (SELECT DISTINCT ON (appro_id) appro_id, date_reception, bon_livraison FROM n ORDER BY appro_id, date_reception DESC, source_id DESC)
SELECT a.* REPLACE (CASE WHEN l.appro_id IS NULL THEN a.quantite_recue ELSE s.q END AS quantite_recue,
                    CASE WHEN l.appro_id IS NULL THEN a.date_reception ELSE l.date_reception END AS date_reception,
                    CASE WHEN l.appro_id IS NULL THEN a.bon_livraison ELSE l.bon_livraison END AS bon_livraison)
FROM approvisionnements a LEFT JOIN l ON l.appro_id = a.id LEFT JOIN s ON s.appro_id = a.id

-- name: post_receptions_rows
-- columns: id:i appro_id:i date_reception:t quantite_recue:d bon_livraison:s observation:s
WITH d AS (SELECT id * 10 + k AS source_id, id AS appro_id, DATE '2024-02-01' + CAST(id % 3 + k AS INT) AS date_reception, id % 4 * k AS quantite_recue,
             'BL' || id || '-' || k AS bon_livraison
      FROM (SELECT id, unnest(CASE WHEN id % 9 = 2 THEN [1, 2] ELSE [1] END) AS k FROM approvisionnements WHERE statut <> 'Rejeté')),
n AS (SELECT * FROM d WHERE quantite_recue > 0),
b AS (SELECT CAST(split_part(id, '-', 1) AS BIGINT) * 10 + CAST(split_part(id, '-', 2) AS BIGINT) AS id, appro_id, date_reception, quantite_recue, bon_livraison, observation
      FROM receptions_appro)
SELECT * FROM b
UNION ALL
SELECT (SELECT max(id) FROM b) + row_number() OVER (ORDER BY source_id), appro_id, date_reception, quantite_recue, bon_livraison, '' FROM n

-- name: site_subcontractor_statement
-- columns: id:i st_id:i rue:s code_poste:s designation:s unite:s qte_devis:d qte_executee:d taux_pct:d montant_devis:d montant_execute:d
SELECT d.id, d.st_id, r.nom AS rue, d.code_poste, d.designation, d.unite, d.quantite AS qte_devis,
       coalesce(sum(c.quantite_executee), 0) AS qte_executee,
       round(coalesce(sum(c.quantite_executee), 0)::DOUBLE / d.quantite::DOUBLE * 100, 1) AS taux_pct,
       d.quantite * d.prix_unitaire AS montant_devis, coalesce(sum(c.montant), 0) AS montant_execute
FROM devis_st d LEFT JOIN rues r ON r.id = d.rue_id LEFT JOIN decomptes_st c ON c.devis_st_id = d.id WHERE d.rue_id = 3 AND d.st_id = 0
GROUP BY d.id, d.st_id, r.nom, d.code_poste, d.designation, d.unite, d.quantite, d.prix_unitaire

-- name: site_subcontractor_account
-- columns: id:i nom:s montant_devis:d montant_execute:d total_paye:d solde_a_payer:d
WITH s AS (
  SELECT id, nom, coalesce((SELECT sum(quantite * prix_unitaire) FROM devis_st d WHERE d.st_id = s.id AND d.rue_id = 3), 0) AS dv,
         coalesce((SELECT sum(c.montant) FROM decomptes_st c JOIN devis_st d ON d.id = c.devis_st_id WHERE d.st_id = s.id AND d.rue_id = 3), 0) AS ex,
         coalesce((SELECT sum(montant) FROM paiements_st p WHERE p.st_id = s.id), 0) AS py
  FROM sous_traitants s)
SELECT id, nom, dv AS montant_devis, ex AS montant_execute, py AS total_paye, ex - py AS solde_a_payer FROM s

-- name: site_deliverable_total
-- columns: montant_marche:d montant_execute:d taux_pct:d
WITH q AS (SELECT d.quantite_marche * d.prix_unitaire AS mm,
           coalesce((SELECT sum(x.quantite_jour) FROM realisations_journalieres x WHERE x.devis_id = d.id), 0) * d.prix_unitaire AS me FROM devis_rue d WHERE d.rue_id = 3 AND d.livrable_id = 18)
SELECT sum(mm) AS montant_marche, sum(me) AS montant_execute, round(sum(me)::DOUBLE / sum(mm)::DOUBLE * 100, 1) AS taux_pct FROM q

-- name: boq_recap_matrix
-- columns: niveau:s rue_id:i cle:s rang:i livrable:s quantite:d
WITH k AS (
  SELECT d.rue_id, d.id, d.quantite_marche, coalesce(l.nom, 'Sans livrable') AS livrable,
         CASE WHEN trim(d.code_poste) <> '' THEN lower(trim(d.code_poste))
              ELSE lower(trim(d.designation)) || '|' || lower(trim(d.unite)) END AS cle
  FROM devis_rue d LEFT JOIN livrables l ON l.id = d.livrable_id),
n AS (SELECT rue_id, livrable, row_number() OVER (PARTITION BY rue_id ORDER BY min(id)) - 1 AS rang FROM k GROUP BY 1, 2),
c AS (SELECT DISTINCT rue_id, cle FROM k),
q AS (SELECT c.rue_id, c.cle, n.rang, n.livrable, coalesce(sum(k.quantite_marche), 0) AS quantite
      FROM c JOIN n ON n.rue_id = c.rue_id LEFT JOIN k ON k.rue_id = c.rue_id AND k.cle = c.cle AND k.livrable = n.livrable GROUP BY 1, 2, 3, 4)
SELECT 'detail' AS niveau, * FROM q
UNION ALL SELECT 'total', rue_id, NULL, rang, livrable, sum(quantite) FROM q GROUP BY rue_id, rang, livrable

-- name: batch_orders
-- columns: id:i date_besoin:t rue_id:i materiau_id:i designation:s unite:s quantite_demandee:d prix_unitaire_estime:d demandeur:s motif:s statut:s date_validation_cc:t validateur_cc:s numero_bc:s date_bc:t fournisseur:s date_reception:t quantite_recue:d bon_livraison:s date_mise_stock:t quantite_mise_stock:d prix_unitaire_reel:d observation:s
WITH RECURSIVE g(i, s) AS (VALUES (1, 'Besoin exprimé'), (2, 'Validé chef chantier'), (3, 'Bon de commande émis'), (4, 'Réceptionné'), (5, 'Mis en stock')),
a AS (SELECT o.*, coalesce(g.i, 0) AS i, (coalesce(materiau_id, 0) + CAST(quantite_demandee AS INT)) % 5 AS kind
      FROM approvisionnements o LEFT JOIN g ON g.s = o.statut),
q AS (SELECT id, quantite_demandee, kind, k, i - 1 + CASE kind WHEN 1 THEN k % 4 + 1 WHEN 2 THEN ceil(k / 2) ELSE k END AS at
      FROM a, (SELECT unnest([1, 2, 3, 4]) AS k)),
r AS (SELECT CASE WHEN CAST(quantite_demandee AS INT) % 17 = 0 THEN id + 900000000 ELSE id END AS appro_id, id * 10 + k AS numero,
             CASE WHEN kind = 3 AND k > 2 THEN 'Rejeté' ELSE g.s END AS cible,
             DATE '2024-02-01' + CAST(CASE WHEN kind = 4 THEN -k ELSE k // 3 END AS INT) AS date_etape, 'Chef ' || k AS acteur, 'N' || id || '-' || k AS numero_bc, 'F' || k AS fournisseur,
             CASE WHEN CAST(quantite_demandee AS INT) % 2 = 0 AND k >= 2 THEN quantite_demandee / 2 END AS quantite,
             CASE WHEN CAST(quantite_demandee AS INT) % 2 = 0 AND k >= 2 THEN k * 10 END AS prix
      FROM q LEFT JOIN g ON g.i = q.at + 1 WHERE g.s IS NOT NULL OR (kind = 3 AND k > 2)),
z AS (SELECT *, row_number() OVER (PARTITION BY appro_id ORDER BY date_etape, numero) AS n FROM r),
legal AS (SELECT unnest(['Besoin exprimé>Validé chef chantier', 'Besoin exprimé>Rejeté', 'Validé chef chantier>Bon de commande émis',
                         'Bon de commande émis>Réceptionné', 'Réceptionné>Mis en stock'])),
m AS (SELECT id, CAST(0 AS BIGINT) AS n, statut AS st, CAST(NULL AS VARCHAR) AS was, false AS ok FROM approvisionnements
      UNION ALL
      SELECT m.id, z.n, CASE WHEN (m.st || '>' || z.cible) IN (FROM legal) THEN z.cible ELSE m.st END, m.st, (m.st || '>' || z.cible) IN (FROM legal)
      FROM m JOIN z ON z.appro_id = m.id AND z.n = m.n + 1),
t AS (SELECT m.id AS appro_id, m.was, z.* EXCLUDE (appro_id) FROM m JOIN z ON z.appro_id = m.id AND z.n = m.n WHERE m.ok),
x AS (SELECT appro_id, sum(quantite_recue) AS total FROM receptions_appro GROUP BY 1),
p AS (SELECT appro_id, arg_max(cible, n) AS st,
        any_value(date_etape) FILTER (cible = 'Validé chef chantier') AS dv, any_value(acteur) FILTER (cible = 'Validé chef chantier') AS av,
        any_value(numero_bc) FILTER (cible = 'Bon de commande émis') AS bc, any_value(fournisseur) FILTER (cible = 'Bon de commande émis') AS fo,
        any_value(date_etape) FILTER (cible = 'Bon de commande émis') AS db, bool_or(cible = 'Réceptionné') AS rec,
        bool_or(cible = 'Mis en stock') AS sto, any_value(date_etape) FILTER (cible = 'Mis en stock') AS ds,
        any_value(quantite) FILTER (cible = 'Mis en stock') AS qs, any_value(prix) FILTER (cible = 'Mis en stock') AS ps
      FROM t GROUP BY 1),
f AS (SELECT a.* EXCLUDE (i, kind) REPLACE (
        coalesce(p.st, a.statut) AS statut, coalesce(p.dv, a.date_validation_cc) AS date_validation_cc, coalesce(p.av, a.validateur_cc) AS validateur_cc,
        coalesce(p.bc, a.numero_bc) AS numero_bc, coalesce(p.fo, a.fournisseur) AS fournisseur, coalesce(p.db, a.date_bc) AS date_bc,
        CASE WHEN p.rec THEN coalesce(x.total, 0) ELSE a.quantite_recue END AS quantite_recue,
        coalesce(p.ds, a.date_mise_stock) AS date_mise_stock,
        CASE WHEN p.sto THEN coalesce(p.qs, CASE WHEN x.total > 0 THEN x.total WHEN NOT p.rec AND a.quantite_recue > 0 THEN a.quantite_recue ELSE 1 END)
             ELSE a.quantite_mise_stock END AS quantite_mise_stock,
        CASE WHEN p.sto THEN coalesce(p.ps, a.prix_unitaire_estime) ELSE a.prix_unitaire_reel END AS prix_unitaire_reel)
      FROM a LEFT JOIN p ON p.appro_id = a.id LEFT JOIN x ON x.appro_id = a.id)
SELECT * FROM f

-- name: batch_steps
-- columns: appro_id:i rang:i numero:i ancien_statut:s cible:s date_etape:t
WITH RECURSIVE g(i, s) AS (VALUES (1, 'Besoin exprimé'), (2, 'Validé chef chantier'), (3, 'Bon de commande émis'), (4, 'Réceptionné'), (5, 'Mis en stock')),
a AS (SELECT o.*, coalesce(g.i, 0) AS i, (coalesce(materiau_id, 0) + CAST(quantite_demandee AS INT)) % 5 AS kind
      FROM approvisionnements o LEFT JOIN g ON g.s = o.statut),
q AS (SELECT id, quantite_demandee, kind, k, i - 1 + CASE kind WHEN 1 THEN k % 4 + 1 WHEN 2 THEN ceil(k / 2) ELSE k END AS at
      FROM a, (SELECT unnest([1, 2, 3, 4]) AS k)),
r AS (SELECT CASE WHEN CAST(quantite_demandee AS INT) % 17 = 0 THEN id + 900000000 ELSE id END AS appro_id, id * 10 + k AS numero,
             CASE WHEN kind = 3 AND k > 2 THEN 'Rejeté' ELSE g.s END AS cible,
             DATE '2024-02-01' + CAST(CASE WHEN kind = 4 THEN -k ELSE k // 3 END AS INT) AS date_etape, 'Chef ' || k AS acteur, 'N' || id || '-' || k AS numero_bc, 'F' || k AS fournisseur,
             CASE WHEN CAST(quantite_demandee AS INT) % 2 = 0 AND k >= 2 THEN quantite_demandee / 2 END AS quantite,
             CASE WHEN CAST(quantite_demandee AS INT) % 2 = 0 AND k >= 2 THEN k * 10 END AS prix
      FROM q LEFT JOIN g ON g.i = q.at + 1 WHERE g.s IS NOT NULL OR (kind = 3 AND k > 2)),
z AS (SELECT *, row_number() OVER (PARTITION BY appro_id ORDER BY date_etape, numero) AS n FROM r),
legal AS (SELECT unnest(['Besoin exprimé>Validé chef chantier', 'Besoin exprimé>Rejeté', 'Validé chef chantier>Bon de commande émis',
                         'Bon de commande émis>Réceptionné', 'Réceptionné>Mis en stock'])),
m AS (SELECT id, CAST(0 AS BIGINT) AS n, statut AS st, CAST(NULL AS VARCHAR) AS was, false AS ok FROM approvisionnements
      UNION ALL
      SELECT m.id, z.n, CASE WHEN (m.st || '>' || z.cible) IN (FROM legal) THEN z.cible ELSE m.st END, m.st, (m.st || '>' || z.cible) IN (FROM legal)
      FROM m JOIN z ON z.appro_id = m.id AND z.n = m.n + 1),
t AS (SELECT m.id AS appro_id, m.was, z.* EXCLUDE (appro_id) FROM m JOIN z ON z.appro_id = m.id AND z.n = m.n WHERE m.ok),
x AS (SELECT appro_id, sum(quantite_recue) AS total FROM receptions_appro GROUP BY 1),
p AS (SELECT appro_id, arg_max(cible, n) AS st,
        any_value(date_etape) FILTER (cible = 'Validé chef chantier') AS dv, any_value(acteur) FILTER (cible = 'Validé chef chantier') AS av,
        any_value(numero_bc) FILTER (cible = 'Bon de commande émis') AS bc, any_value(fournisseur) FILTER (cible = 'Bon de commande émis') AS fo,
        any_value(date_etape) FILTER (cible = 'Bon de commande émis') AS db, bool_or(cible = 'Réceptionné') AS rec,
        bool_or(cible = 'Mis en stock') AS sto, any_value(date_etape) FILTER (cible = 'Mis en stock') AS ds,
        any_value(quantite) FILTER (cible = 'Mis en stock') AS qs, any_value(prix) FILTER (cible = 'Mis en stock') AS ps
      FROM t GROUP BY 1),
f AS (SELECT a.* EXCLUDE (i, kind) REPLACE (
        coalesce(p.st, a.statut) AS statut, coalesce(p.dv, a.date_validation_cc) AS date_validation_cc, coalesce(p.av, a.validateur_cc) AS validateur_cc,
        coalesce(p.bc, a.numero_bc) AS numero_bc, coalesce(p.fo, a.fournisseur) AS fournisseur, coalesce(p.db, a.date_bc) AS date_bc,
        CASE WHEN p.rec THEN coalesce(x.total, 0) ELSE a.quantite_recue END AS quantite_recue,
        coalesce(p.ds, a.date_mise_stock) AS date_mise_stock,
        CASE WHEN p.sto THEN coalesce(p.qs, CASE WHEN x.total > 0 THEN x.total WHEN NOT p.rec AND a.quantite_recue > 0 THEN a.quantite_recue ELSE 1 END)
             ELSE a.quantite_mise_stock END AS quantite_mise_stock,
        CASE WHEN p.sto THEN coalesce(p.ps, a.prix_unitaire_estime) ELSE a.prix_unitaire_reel END AS prix_unitaire_reel)
      FROM a LEFT JOIN p ON p.appro_id = a.id LEFT JOIN x ON x.appro_id = a.id)
SELECT appro_id, row_number() OVER (PARTITION BY appro_id ORDER BY n) AS rang, numero, was AS ancien_statut, cible, date_etape FROM t

-- name: batch_refused
-- columns: appro_id:i numero:i ancien_statut:s cible:s motif_refus:s
WITH RECURSIVE g(i, s) AS (VALUES (1, 'Besoin exprimé'), (2, 'Validé chef chantier'), (3, 'Bon de commande émis'), (4, 'Réceptionné'), (5, 'Mis en stock')),
a AS (SELECT o.*, coalesce(g.i, 0) AS i, (coalesce(materiau_id, 0) + CAST(quantite_demandee AS INT)) % 5 AS kind
      FROM approvisionnements o LEFT JOIN g ON g.s = o.statut),
q AS (SELECT id, quantite_demandee, kind, k, i - 1 + CASE kind WHEN 1 THEN k % 4 + 1 WHEN 2 THEN ceil(k / 2) ELSE k END AS at
      FROM a, (SELECT unnest([1, 2, 3, 4]) AS k)),
r AS (SELECT CASE WHEN CAST(quantite_demandee AS INT) % 17 = 0 THEN id + 900000000 ELSE id END AS appro_id, id * 10 + k AS numero,
             CASE WHEN kind = 3 AND k > 2 THEN 'Rejeté' ELSE g.s END AS cible,
             DATE '2024-02-01' + CAST(CASE WHEN kind = 4 THEN -k ELSE k // 3 END AS INT) AS date_etape, 'Chef ' || k AS acteur, 'N' || id || '-' || k AS numero_bc, 'F' || k AS fournisseur,
             CASE WHEN CAST(quantite_demandee AS INT) % 2 = 0 AND k >= 2 THEN quantite_demandee / 2 END AS quantite,
             CASE WHEN CAST(quantite_demandee AS INT) % 2 = 0 AND k >= 2 THEN k * 10 END AS prix
      FROM q LEFT JOIN g ON g.i = q.at + 1 WHERE g.s IS NOT NULL OR (kind = 3 AND k > 2)),
z AS (SELECT *, row_number() OVER (PARTITION BY appro_id ORDER BY date_etape, numero) AS n FROM r),
legal AS (SELECT unnest(['Besoin exprimé>Validé chef chantier', 'Besoin exprimé>Rejeté', 'Validé chef chantier>Bon de commande émis',
                         'Bon de commande émis>Réceptionné', 'Réceptionné>Mis en stock'])),
m AS (SELECT id, CAST(0 AS BIGINT) AS n, statut AS st, CAST(NULL AS VARCHAR) AS was, false AS ok FROM approvisionnements
      UNION ALL
      SELECT m.id, z.n, CASE WHEN (m.st || '>' || z.cible) IN (FROM legal) THEN z.cible ELSE m.st END, m.st, (m.st || '>' || z.cible) IN (FROM legal)
      FROM m JOIN z ON z.appro_id = m.id AND z.n = m.n + 1),
t AS (SELECT m.id AS appro_id, m.was, z.* EXCLUDE (appro_id) FROM m JOIN z ON z.appro_id = m.id AND z.n = m.n WHERE m.ok),
x AS (SELECT appro_id, sum(quantite_recue) AS total FROM receptions_appro GROUP BY 1),
p AS (SELECT appro_id, arg_max(cible, n) AS st,
        any_value(date_etape) FILTER (cible = 'Validé chef chantier') AS dv, any_value(acteur) FILTER (cible = 'Validé chef chantier') AS av,
        any_value(numero_bc) FILTER (cible = 'Bon de commande émis') AS bc, any_value(fournisseur) FILTER (cible = 'Bon de commande émis') AS fo,
        any_value(date_etape) FILTER (cible = 'Bon de commande émis') AS db, bool_or(cible = 'Réceptionné') AS rec,
        bool_or(cible = 'Mis en stock') AS sto, any_value(date_etape) FILTER (cible = 'Mis en stock') AS ds,
        any_value(quantite) FILTER (cible = 'Mis en stock') AS qs, any_value(prix) FILTER (cible = 'Mis en stock') AS ps
      FROM t GROUP BY 1),
f AS (SELECT a.* EXCLUDE (i, kind) REPLACE (
        coalesce(p.st, a.statut) AS statut, coalesce(p.dv, a.date_validation_cc) AS date_validation_cc, coalesce(p.av, a.validateur_cc) AS validateur_cc,
        coalesce(p.bc, a.numero_bc) AS numero_bc, coalesce(p.fo, a.fournisseur) AS fournisseur, coalesce(p.db, a.date_bc) AS date_bc,
        CASE WHEN p.rec THEN coalesce(x.total, 0) ELSE a.quantite_recue END AS quantite_recue,
        coalesce(p.ds, a.date_mise_stock) AS date_mise_stock,
        CASE WHEN p.sto THEN coalesce(p.qs, CASE WHEN x.total > 0 THEN x.total WHEN NOT p.rec AND a.quantite_recue > 0 THEN a.quantite_recue ELSE 1 END)
             ELSE a.quantite_mise_stock END AS quantite_mise_stock,
        CASE WHEN p.sto THEN coalesce(p.ps, a.prix_unitaire_estime) ELSE a.prix_unitaire_reel END AS prix_unitaire_reel)
      FROM a LEFT JOIN p ON p.appro_id = a.id LEFT JOIN x ON x.appro_id = a.id)
SELECT z.appro_id, z.numero, m.was AS ancien_statut, z.cible, CASE WHEN m.id IS NULL THEN 'inconnu' ELSE 'interdit' END AS motif_refus
FROM z LEFT JOIN m ON m.id = z.appro_id AND m.n = z.n WHERE m.id IS NULL OR NOT m.ok

-- name: batch_entries
-- columns: date_mvt:t rue_id:i materiau_id:i type_mvt:s quantite:d prix_unitaire:d fournisseur:s bon_livraison:s appro_id:i observation:s
WITH RECURSIVE g(i, s) AS (VALUES (1, 'Besoin exprimé'), (2, 'Validé chef chantier'), (3, 'Bon de commande émis'), (4, 'Réceptionné'), (5, 'Mis en stock')),
a AS (SELECT o.*, coalesce(g.i, 0) AS i, (coalesce(materiau_id, 0) + CAST(quantite_demandee AS INT)) % 5 AS kind
      FROM approvisionnements o LEFT JOIN g ON g.s = o.statut),
q AS (SELECT id, quantite_demandee, kind, k, i - 1 + CASE kind WHEN 1 THEN k % 4 + 1 WHEN 2 THEN ceil(k / 2) ELSE k END AS at
      FROM a, (SELECT unnest([1, 2, 3, 4]) AS k)),
r AS (SELECT CASE WHEN CAST(quantite_demandee AS INT) % 17 = 0 THEN id + 900000000 ELSE id END AS appro_id, id * 10 + k AS numero,
             CASE WHEN kind = 3 AND k > 2 THEN 'Rejeté' ELSE g.s END AS cible,
             DATE '2024-02-01' + CAST(CASE WHEN kind = 4 THEN -k ELSE k // 3 END AS INT) AS date_etape, 'Chef ' || k AS acteur, 'N' || id || '-' || k AS numero_bc, 'F' || k AS fournisseur,
             CASE WHEN CAST(quantite_demandee AS INT) % 2 = 0 AND k >= 2 THEN quantite_demandee / 2 END AS quantite,
             CASE WHEN CAST(quantite_demandee AS INT) % 2 = 0 AND k >= 2 THEN k * 10 END AS prix
      FROM q LEFT JOIN g ON g.i = q.at + 1 WHERE g.s IS NOT NULL OR (kind = 3 AND k > 2)),
z AS (SELECT *, row_number() OVER (PARTITION BY appro_id ORDER BY date_etape, numero) AS n FROM r),
legal AS (SELECT unnest(['Besoin exprimé>Validé chef chantier', 'Besoin exprimé>Rejeté', 'Validé chef chantier>Bon de commande émis',
                         'Bon de commande émis>Réceptionné', 'Réceptionné>Mis en stock'])),
m AS (SELECT id, CAST(0 AS BIGINT) AS n, statut AS st, CAST(NULL AS VARCHAR) AS was, false AS ok FROM approvisionnements
      UNION ALL
      SELECT m.id, z.n, CASE WHEN (m.st || '>' || z.cible) IN (FROM legal) THEN z.cible ELSE m.st END, m.st, (m.st || '>' || z.cible) IN (FROM legal)
      FROM m JOIN z ON z.appro_id = m.id AND z.n = m.n + 1),
t AS (SELECT m.id AS appro_id, m.was, z.* EXCLUDE (appro_id) FROM m JOIN z ON z.appro_id = m.id AND z.n = m.n WHERE m.ok),
x AS (SELECT appro_id, sum(quantite_recue) AS total FROM receptions_appro GROUP BY 1),
p AS (SELECT appro_id, arg_max(cible, n) AS st,
        any_value(date_etape) FILTER (cible = 'Validé chef chantier') AS dv, any_value(acteur) FILTER (cible = 'Validé chef chantier') AS av,
        any_value(numero_bc) FILTER (cible = 'Bon de commande émis') AS bc, any_value(fournisseur) FILTER (cible = 'Bon de commande émis') AS fo,
        any_value(date_etape) FILTER (cible = 'Bon de commande émis') AS db, bool_or(cible = 'Réceptionné') AS rec,
        bool_or(cible = 'Mis en stock') AS sto, any_value(date_etape) FILTER (cible = 'Mis en stock') AS ds,
        any_value(quantite) FILTER (cible = 'Mis en stock') AS qs, any_value(prix) FILTER (cible = 'Mis en stock') AS ps
      FROM t GROUP BY 1),
f AS (SELECT a.* EXCLUDE (i, kind) REPLACE (
        coalesce(p.st, a.statut) AS statut, coalesce(p.dv, a.date_validation_cc) AS date_validation_cc, coalesce(p.av, a.validateur_cc) AS validateur_cc,
        coalesce(p.bc, a.numero_bc) AS numero_bc, coalesce(p.fo, a.fournisseur) AS fournisseur, coalesce(p.db, a.date_bc) AS date_bc,
        CASE WHEN p.rec THEN coalesce(x.total, 0) ELSE a.quantite_recue END AS quantite_recue,
        coalesce(p.ds, a.date_mise_stock) AS date_mise_stock,
        CASE WHEN p.sto THEN coalesce(p.qs, CASE WHEN x.total > 0 THEN x.total WHEN NOT p.rec AND a.quantite_recue > 0 THEN a.quantite_recue ELSE 1 END)
             ELSE a.quantite_mise_stock END AS quantite_mise_stock,
        CASE WHEN p.sto THEN coalesce(p.ps, a.prix_unitaire_estime) ELSE a.prix_unitaire_reel END AS prix_unitaire_reel)
      FROM a LEFT JOIN p ON p.appro_id = a.id LEFT JOIN x ON x.appro_id = a.id)
SELECT f.date_mise_stock AS date_mvt, f.rue_id, f.materiau_id, 'ENTREE' AS type_mvt, f.quantite_mise_stock AS quantite, f.prix_unitaire_reel AS prix_unitaire,
       coalesce(f.fournisseur, '') AS fournisseur, coalesce(f.bon_livraison, '') AS bon_livraison, f.id AS appro_id, 'Via Circuit Appro BC:' || coalesce(f.numero_bc, '') AS observation
FROM f WHERE f.id IN (SELECT appro_id FROM t WHERE cible = 'Mis en stock') AND f.materiau_id IS NOT NULL

-- name: warehouse_scan
-- columns: table_name:s n:i nb_mois:i somme_ids:d
SELECT 'rues' AS table_name, count(*) AS n, 0 AS nb_mois, sum(id) AS somme_ids FROM rues
UNION ALL SELECT 'personnel' AS table_name, count(*) AS n, 0 AS nb_mois, sum(id) AS somme_ids FROM personnel
UNION ALL SELECT 'materiaux' AS table_name, count(*) AS n, 0 AS nb_mois, sum(id) AS somme_ids FROM materiaux
UNION ALL SELECT 'caisse_chantier' AS table_name, count(*) AS n, count(DISTINCT strftime(date_op, '%Y-%m')) AS nb_mois, sum(id) AS somme_ids FROM caisse_chantier
UNION ALL SELECT 'pointage' AS table_name, count(*) AS n, count(DISTINCT strftime(date_pointage, '%Y-%m')) AS nb_mois, sum(id) AS somme_ids FROM pointage
UNION ALL SELECT 'audit_log' AS table_name, count(*) AS n, count(DISTINCT strftime(timestamp, '%Y-%m')) AS nb_mois, sum(id) AS somme_ids FROM audit_log
UNION ALL SELECT 'paiements_st' AS table_name, count(*) AS n, count(DISTINCT strftime(date_paiement, '%Y-%m')) AS nb_mois, sum(id) AS somme_ids FROM paiements_st

-- name: export_sheets
-- columns: feuille:s lignes:i lues:i
SELECT 'Chantiers' AS feuille, count(*) AS lignes, count(*) AS lues FROM rues
UNION ALL SELECT 'Avancement', count(*), count(*) FROM devis_rue
UNION ALL SELECT 'Stock', count(*), count(*) FROM materiaux
UNION ALL SELECT 'Personnel', count(*), count(*) FROM personnel
UNION ALL SELECT 'Sous-Traitants', count(*), count(*) FROM sous_traitants
UNION ALL SELECT 'Engins', count(*), count(*) FROM materiels
UNION ALL SELECT 'Vide', 0, 1

-- name: preview_alerts
-- columns: id:i nom:s unite:s stock:d seuil_alerte:d total:i
WITH a AS (SELECT m.id, m.nom, m.unite, m.stock_initial + coalesce(sum(CASE v.type_mvt WHEN 'ENTREE' THEN v.quantite ELSE -v.quantite END), 0) AS stock, m.seuil_alerte
FROM materiaux m LEFT JOIN mouvements_materiaux v ON v.materiau_id = m.id
GROUP BY m.id, m.nom, m.unite, m.stock_initial, m.seuil_alerte
HAVING m.stock_initial + coalesce(sum(CASE v.type_mvt WHEN 'ENTREE' THEN v.quantite ELSE -v.quantite END), 0) <= m.seuil_alerte AND m.seuil_alerte > 0)
SELECT *, (SELECT count(*) FROM a) AS total FROM a ORDER BY nom, id LIMIT 20
