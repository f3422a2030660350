"""Display names of result columns, for exported sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Display name by column.
LABELS = {
    "chantier": "Chantier",
    "dossier": "Dossier",
    "livrable": "Livrable",
    "code_poste": "Code",
    "designation": "Désignation",
    "unite": "Unité",
    "quantite_marche": "Qté_Marché",
    "prix_unitaire": "PU",
    "qte_realisee": "Qté_Réalisée",
    "qte_executee": "Qté exécutée",
    "montant": "Montant",
    "montant_marche": "Montant_Marché",
    "montant_realise": "Montant_Réalisé",
    "montant_execute": "Montant exécuté",
    "reste": "Reste",
    "ecart": "Écart",
    "pct_avancement": "%_Avancement",
    "taux_pct": "Taux %",
    "sous_traitant": "Sous_Traitant",
    "specialite": "Spécialité",
    "responsable": "Responsable",
    "telephone": "Téléphone",
    "montant_contrat": "Montant_Contrat",
    "montant_devis": "Montant_Devis_ST",
    "total_decompte": "Total_Décompté",
    "total_paye": "Total_Payé",
    "solde_a_payer": "Solde_à_payer",
    "personnel": "Personnel",
    "nom": "Nom",
    "prenom": "Prénom",
    "categorie": "Catégorie",
    "poste": "Poste",
    "date": "Date",
    "statut": "Statut",
    "heures": "Heures",
    "materiau": "Matériau",
    "stock_initial": "Stock_Initial",
    "total_entrees": "Total_Entrées",
    "total_sorties": "Total_Sorties",
    "stock_actuel": "Stock_Actuel",
    "mouvements_net": "Mouvements_Net",
    "engin": "Engin",
    "immat": "Immat",
    "immatriculation": "Immat",
    "heures_marche": "Hrs_Marche",
    "heures_arret": "Hrs_Arrêt",
    "carburant_l": "Carburant_L",
    "cout_carburant": "Coût_Carb",
    "chauffeur": "Chauffeur",
    "panne": "Panne",
    "meteo": "Météo",
    "temperature": "Température",
    "nb_ouvriers": "Ouvriers",
    "nb_encadrants": "Encadrants",
    "travaux_realises": "Travaux_Réalisés",
    "observations": "Observations",
    "type_op": "Type",
    "rubrique": "Rubrique",
    "beneficiaire": "Bénéficiaire",
    "mode_paiement": "Mode_Paiement",
    "reference_piece": "Référence",
    "type_incident": "Type",
    "gravite": "Gravité",
    "description": "Description",
    "personne_concernee": "Personne_Concernée",
    "mesures_prises": "Mesures_Prises",
    "date_besoin": "Date_Besoin",
    "quantite_demandee": "Qté_Demandée",
    "quantite_recue": "Qté_Reçue",
    "fournisseur": "Fournisseur",
    "prix_unitaire_reel": "PU_Réel",
    "date_reception": "Date_Réception",
    "numero_marche": "N_Marché",
    "maitre_ouvrage": "Maître_Ouvrage",
    "entreprise": "Entreprise",
    "date_notification": "Date_Notif",
    "date_demarrage": "Date_Démarrage",
    "delai_jours": "Délai_Jours",
    "type_materiel": "Type",
    "etat": "État",
}


def with_labels(df: DataFrame) -> DataFrame:
    """Rename the columns that have a display name."""
    return df.withColumnsRenamed({c: LABELS[c] for c in df.columns if c in LABELS})
