-- name: report_progress
-- columns: niveau:s rang_niveau:i rue_id:i groupe:i id:i chantier:s livrable:s code_poste:s designation:s unite:s prix_unitaire:d quantite_marche:d montant_marche:d qte_realisee:d montant_realise:d reste:d pct_avancement:d
WITH l AS (
  SELECT d.*, coalesce(r.nom, '—') AS chantier, coalesce(v.nom, 'Sans livrable') AS livrable,
         coalesce((SELECT sum(x.quantite_jour) FROM realisations_journalieres x WHERE x.devis_id = d.id), 0) AS qr
  FROM devis_rue d LEFT JOIN rues r ON r.id = d.rue_id LEFT JOIN livrables v ON v.id = d.livrable_id),
n AS (
  SELECT *, CASE WHEN lag(livrable) OVER (PARTITION BY rue_id ORDER BY livrable_id NULLS FIRST, id) = livrable THEN 0 ELSE 1 END AS neuf FROM l),
g AS (
  SELECT *, sum(neuf) OVER (PARTITION BY rue_id ORDER BY livrable_id NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS groupe,
         quantite_marche * prix_unitaire AS mm, qr * prix_unitaire AS mr FROM n)
SELECT 'detail' AS niveau, 0 AS rang_niveau, rue_id, groupe, id, chantier, livrable, code_poste, designation, unite, prix_unitaire,
       quantite_marche, mm AS montant_marche, qr AS qte_realisee, mr AS montant_realise, mm - mr AS reste,
       round(qr::DOUBLE / (CASE WHEN quantite_marche = 0 THEN 1 ELSE quantite_marche END)::DOUBLE * 100, 1) AS pct_avancement FROM g
UNION ALL
SELECT 'sous-total', 1, rue_id, groupe, NULL, chantier, livrable, NULL, NULL, NULL, NULL, sum(quantite_marche), sum(mm), sum(qr), sum(mr),
       sum(mm - mr), CASE WHEN sum(mm) = 0 THEN 0 ELSE round(sum(mr)::DOUBLE / sum(mm)::DOUBLE * 100, 1) END
FROM g GROUP BY rue_id, chantier, groupe, livrable
UNION ALL
SELECT 'total', 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, sum(quantite_marche), sum(mm), sum(qr), sum(mr),
       sum(mm - mr), round(sum(mr)::DOUBLE / sum(mm)::DOUBLE * 100, 1) FROM g

-- name: report_subcontractors
-- columns: sous_traitant:s specialite:s montant_contrat:d montant_devis:d total_decompte:d total_paye:d solde_a_payer:d
WITH s AS (
  SELECT nom AS sous_traitant, specialite, montant_contrat,
    coalesce((SELECT sum(quantite * prix_unitaire) FROM devis_st d WHERE d.st_id = t.id), 0) AS montant_devis,
    coalesce((SELECT sum(montant) FROM decomptes_st d WHERE d.st_id = t.id), 0) AS total_decompte,
    coalesce((SELECT sum(montant) FROM paiements_st d WHERE d.st_id = t.id), 0) AS total_paye
  FROM sous_traitants t)
SELECT *, total_decompte - total_paye AS solde_a_payer FROM s

-- name: report_attendance
-- columns: id:i personnel:s categorie:s poste:s date:t statut:s heures:d
SELECT t.id, p.nom || ' ' || coalesce(p.prenom, '') AS personnel, p.categorie, p.poste, t.date_pointage AS date, t.statut,
       t.heures_travaillees AS heures
FROM personnel p LEFT JOIN pointage t ON t.personnel_id = p.id WHERE t.date_pointage BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'

-- name: report_stock
-- columns: materiau:s unite:s categorie:s stock_initial:d total_entrees:d total_sorties:d stock_actuel:d
SELECT m.nom AS materiau, m.unite, m.categorie, m.stock_initial,
       coalesce(sum(v.quantite) FILTER (v.type_mvt = 'ENTREE'), 0) AS total_entrees,
       coalesce(sum(v.quantite) FILTER (v.type_mvt = 'SORTIE'), 0) AS total_sorties,
       m.stock_initial + coalesce(sum(CASE v.type_mvt WHEN 'ENTREE' THEN v.quantite ELSE -v.quantite END), 0) AS stock_actuel
FROM materiaux m LEFT JOIN mouvements_materiaux v ON v.materiau_id = m.id GROUP BY m.id, m.nom, m.unite, m.categorie, m.stock_initial

-- name: report_plant
-- columns: id:i engin:s immat:s chantier:s date:t heures_marche:d heures_travail:d heures_effectives:d heures_arret:d carburant_l:d carburant_consomme:d carburant_effectif:d cout_carburant:d chauffeur:s panne:s
SELECT s.id, m.nom AS engin, m.immatriculation AS immat, coalesce(r.nom, '—') AS chantier, s.date_suivi AS date, s.heures_marche,
       s.heures_travail, CASE WHEN s.heures_marche <> 0 THEN s.heures_marche ELSE s.heures_travail END AS heures_effectives,
       s.heures_arret, s.carburant_l, s.carburant_consomme,
       CASE WHEN s.carburant_l <> 0 THEN s.carburant_l ELSE s.carburant_consomme END AS carburant_effectif, s.cout_carburant, s.chauffeur, s.panne
FROM suivi_materiels s JOIN materiels m ON m.id = s.materiel_id LEFT JOIN rues r ON r.id = s.rue_id
WHERE s.date_suivi BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'

-- name: report_diary
-- columns: id:i date:t chantier:s meteo:s temperature:d nb_ouvriers:i nb_encadrants:i travaux_realises:s observations:s
SELECT j.id, j.date_journal AS date, coalesce(r.nom, '—') AS chantier, j.meteo, j.temperature, j.nb_ouvriers, j.nb_encadrants,
       j.travaux_realises, j.observations
FROM journal_chantier j LEFT JOIN rues r ON r.id = j.rue_id WHERE j.date_journal BETWEEN DATE '2024-01-05' AND DATE '2024-02-20'

-- name: report_cash
-- columns: id:i date:t chantier:s type_op:s rubrique:s montant:d beneficiaire:s mode_paiement:s reference_piece:s
SELECT c.id, c.date_op AS date, coalesce(r.nom, '—') AS chantier, c.type_op, c.rubrique, c.montant, c.beneficiaire,
       c.mode_paiement, c.reference_piece
FROM caisse_chantier c LEFT JOIN rues r ON r.id = c.rue_id WHERE c.date_op BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'

-- name: report_incidents
-- columns: id:i date:t chantier:s type_incident:s gravite:s description:s personne_concernee:s mesures_prises:s statut:s
SELECT i.id, i.date_incident AS date, coalesce(r.nom, '—') AS chantier, i.type_incident, i.gravite, i.description, i.personne_concernee, i.mesures_prises,
       CASE i.cloture WHEN 1 THEN 'Clôturé' ELSE 'Ouvert' END AS statut
FROM incidents i LEFT JOIN rues r ON r.id = i.rue_id WHERE i.date_incident BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'

-- name: report_gap
-- columns: id:i chantier:s code_poste:s designation:s unite:s quantite_marche:d prix_unitaire:d montant_marche:d qte_realisee:d montant_realise:d ecart:d pct_avancement:d
SELECT d.id, r.nom AS chantier, d.code_poste, d.designation, d.unite, d.quantite_marche, d.prix_unitaire,
       d.quantite_marche * d.prix_unitaire AS montant_marche, coalesce(sum(x.quantite_jour), 0) AS qte_realisee,
       coalesce(sum(x.quantite_jour), 0) * d.prix_unitaire AS montant_realise,
       d.quantite_marche * d.prix_unitaire - coalesce(sum(x.quantite_jour), 0) * d.prix_unitaire AS ecart,
       round(coalesce(sum(x.quantite_jour), 0)::DOUBLE / coalesce(nullif(d.quantite_marche, 0), 1)::DOUBLE * 100, 1) AS pct_avancement
FROM devis_rue d LEFT JOIN rues r ON r.id = d.rue_id LEFT JOIN realisations_journalieres x ON x.devis_id = d.id
GROUP BY d.id, r.nom, d.code_poste, d.designation, d.unite, d.quantite_marche, d.prix_unitaire

-- name: report_procurement
-- columns: id:i date_besoin:t chantier:s designation:s unite:s quantite_demandee:d quantite_recue:d fournisseur:s statut:s prix_unitaire_reel:d date_reception:t
SELECT a.id, a.date_besoin, coalesce(r.nom, '—') AS chantier, a.designation, a.unite, a.quantite_demandee, a.quantite_recue,
       a.fournisseur, a.statut, a.prix_unitaire_reel, a.date_reception
FROM approvisionnements a LEFT JOIN rues r ON r.id = a.rue_id WHERE a.date_besoin BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'

-- name: report_global_sites
-- columns: chantier:s dossier:s numero_marche:s maitre_ouvrage:s entreprise:s date_notification:t date_demarrage:t delai_jours:d
SELECT r.nom AS chantier, coalesce(d.nom, '—') AS dossier, r.numero_marche, r.maitre_ouvrage, r.entreprise,
       r.date_notification, r.date_demarrage, r.delai_jours FROM rues r LEFT JOIN dossiers d ON d.id = r.dossier_id

-- name: report_global_progress
-- columns: id:i chantier:s designation:s unite:s quantite_marche:d prix_unitaire:d qte_realisee:d montant_marche:d montant_realise:d
SELECT d.id, coalesce(r.nom, '—') AS chantier, d.designation, d.unite, d.quantite_marche, d.prix_unitaire,
       coalesce(sum(x.quantite_jour), 0) AS qte_realisee, d.quantite_marche * d.prix_unitaire AS montant_marche,
       coalesce(sum(x.quantite_jour), 0) * d.prix_unitaire AS montant_realise
FROM devis_rue d LEFT JOIN rues r ON r.id = d.rue_id LEFT JOIN realisations_journalieres x ON x.devis_id = d.id
GROUP BY d.id, r.nom, d.designation, d.unite, d.quantite_marche, d.prix_unitaire

-- name: report_global_stock
-- columns: materiau:s unite:s stock_initial:d mouvements_net:d
SELECT m.nom AS materiau, m.unite, m.stock_initial,
       coalesce(sum(CASE v.type_mvt WHEN 'ENTREE' THEN v.quantite WHEN 'SORTIE' THEN -v.quantite END), 0) AS mouvements_net
FROM materiaux m LEFT JOIN mouvements_materiaux v ON v.materiau_id = m.id GROUP BY m.id, m.nom, m.unite, m.stock_initial

-- name: report_global_staff
-- columns: nom:s prenom:s categorie:s poste:s telephone:s
SELECT nom, prenom, categorie, poste, telephone FROM personnel

-- name: report_global_subcontractors
-- columns: nom:s specialite:s responsable:s telephone:s montant_contrat:d statut:s
SELECT nom, specialite, responsable, telephone, montant_contrat, statut FROM sous_traitants

-- name: report_global_plant
-- columns: nom:s immatriculation:s type_materiel:s etat:s
SELECT nom, immatriculation, type_materiel, etat FROM materiels

-- name: site_report_progress
-- columns: niveau:s rang_niveau:i rue_id:i groupe:i id:i chantier:s livrable:s code_poste:s designation:s unite:s prix_unitaire:d quantite_marche:d montant_marche:d qte_realisee:d montant_realise:d reste:d pct_avancement:d
WITH l AS (
  SELECT d.*, coalesce(r.nom, '—') AS chantier, coalesce(v.nom, 'Sans livrable') AS livrable,
         coalesce((SELECT sum(x.quantite_jour) FROM realisations_journalieres x WHERE x.devis_id = d.id), 0) AS qr
  FROM devis_rue d LEFT JOIN rues r ON r.id = d.rue_id LEFT JOIN livrables v ON v.id = d.livrable_id WHERE d.rue_id = 3),
n AS (
  SELECT *, CASE WHEN lag(livrable) OVER (PARTITION BY rue_id ORDER BY livrable_id NULLS FIRST, id) = livrable THEN 0 ELSE 1 END AS neuf FROM l),
g AS (
  SELECT *, sum(neuf) OVER (PARTITION BY rue_id ORDER BY livrable_id NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS groupe,
         quantite_marche * prix_unitaire AS mm, qr * prix_unitaire AS mr FROM n)
SELECT 'detail' AS niveau, 0 AS rang_niveau, rue_id, groupe, id, chantier, livrable, code_poste, designation, unite, prix_unitaire,
       quantite_marche, mm AS montant_marche, qr AS qte_realisee, mr AS montant_realise, mm - mr AS reste,
       round(qr::DOUBLE / (CASE WHEN quantite_marche = 0 THEN 1 ELSE quantite_marche END)::DOUBLE * 100, 1) AS pct_avancement FROM g
UNION ALL
SELECT 'sous-total', 1, rue_id, groupe, NULL, chantier, livrable, NULL, NULL, NULL, NULL, sum(quantite_marche), sum(mm), sum(qr), sum(mr),
       sum(mm - mr), CASE WHEN sum(mm) = 0 THEN 0 ELSE round(sum(mr)::DOUBLE / sum(mm)::DOUBLE * 100, 1) END
FROM g GROUP BY rue_id, chantier, groupe, livrable
UNION ALL
SELECT 'total', 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, sum(quantite_marche), sum(mm), sum(qr), sum(mr),
       sum(mm - mr), round(sum(mr)::DOUBLE / sum(mm)::DOUBLE * 100, 1) FROM g

-- name: site_report_gap
-- columns: id:i chantier:s code_poste:s designation:s unite:s quantite_marche:d prix_unitaire:d montant_marche:d qte_realisee:d montant_realise:d ecart:d pct_avancement:d
SELECT d.id, r.nom AS chantier, d.code_poste, d.designation, d.unite, d.quantite_marche, d.prix_unitaire,
       d.quantite_marche * d.prix_unitaire AS montant_marche, coalesce(sum(x.quantite_jour), 0) AS qte_realisee,
       coalesce(sum(x.quantite_jour), 0) * d.prix_unitaire AS montant_realise,
       d.quantite_marche * d.prix_unitaire - coalesce(sum(x.quantite_jour), 0) * d.prix_unitaire AS ecart,
       round(coalesce(sum(x.quantite_jour), 0)::DOUBLE / coalesce(nullif(d.quantite_marche, 0), 1)::DOUBLE * 100, 1) AS pct_avancement
FROM devis_rue d LEFT JOIN rues r ON r.id = d.rue_id LEFT JOIN realisations_journalieres x ON x.devis_id = d.id WHERE d.rue_id = 3
GROUP BY d.id, r.nom, d.code_poste, d.designation, d.unite, d.quantite_marche, d.prix_unitaire

-- name: site_report_subcontractors
-- columns: sous_traitant:s specialite:s montant_contrat:d montant_devis:d total_decompte:d total_paye:d solde_a_payer:d
WITH s AS (
  SELECT nom AS sous_traitant, specialite, montant_contrat,
    coalesce((SELECT sum(quantite * prix_unitaire) FROM devis_st d WHERE d.st_id = t.id), 0) AS montant_devis,
    coalesce((SELECT sum(montant) FROM decomptes_st d WHERE d.st_id = t.id), 0) AS total_decompte,
    coalesce((SELECT sum(montant) FROM paiements_st d WHERE d.st_id = t.id), 0) AS total_paye
  FROM sous_traitants t WHERE t.rue_id = 3)
SELECT *, total_decompte - total_paye AS solde_a_payer FROM s
