"""Schema catalogue: tables, column defaults, keys and vocabularies.

Storage types: money and quantities are exact decimals, ISO date texts are
dates, blank dates are NULL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import types as T

# Table and column names with their defaults.
# One column per line: name, type, then "required" or a default if there is one.
_COLUMNS = {
    "dossiers": """
        id bigint required
        nom string required
        description string ''
        client string ''
        date_creation date
        statut string 'En cours'
        observation string ''
    """,
    "rues": """
        id bigint required
        dossier_id bigint
        nom string required
        zone string ''
        longueur_m decimal 0
        largeur_m decimal 0
        observation string ''
        numero_marche string ''
        objet_marche string ''
        maitre_ouvrage string ''
        maitre_ouvrage_delegue string ''
        entreprise string ''
        bureau_controle string ''
        labo string ''
        coordinateur_securite string ''
        date_notification date
        date_demarrage date
        delai_jours decimal 0
        delai_mois decimal 0
        statut_chantier string 'En cours'
    """,
    "livrables": """
        id bigint required
        chantier_id bigint required
        nom string required
        type_livrable string 'Rue'
        description string ''
        longueur_m decimal 0
        largeur_m decimal 0
        observation string ''
    """,
    "devis_rue": """
        id bigint required
        rue_id bigint required
        livrable_id bigint
        code_poste string ''
        designation string required
        unite string required
        quantite_marche decimal 0
        prix_unitaire decimal 0
        observation string ''
    """,
    "realisations_journalieres": """
        id bigint required
        date_suivi date required
        rue_id bigint required
        devis_id bigint required
        quantite_jour decimal 0
        observation string ''
    """,
    "sous_traitants": """
        id bigint required
        nom string required
        specialite string ''
        responsable string ''
        telephone string ''
        email string ''
        montant_contrat decimal 0
        date_debut date
        date_fin date
        statut string 'Actif'
        rue_id bigint
        observation string ''
    """,
    "devis_st": """
        id bigint required
        st_id bigint required
        rue_id bigint
        code_poste string ''
        designation string required
        unite string required
        quantite decimal 0
        prix_unitaire decimal 0
        observation string ''
    """,
    "decomptes_st": """
        id bigint required
        st_id bigint required
        rue_id bigint
        numero_decompte int 1
        date_decompte date required
        devis_st_id bigint
        quantite_executee decimal 0
        montant decimal 0
        observation string ''
        valide int 0
    """,
    "paiements_st": """
        id bigint required
        st_id bigint required
        rue_id bigint
        date_paiement date required
        montant decimal required
        reference string ''
        mode_paiement string 'Virement'
        observation string ''
    """,
    "personnel": """
        id bigint required
        nom string required
        prenom string ''
        categorie string required
        poste string ''
        salaire_journalier decimal 0
        telephone string ''
        date_entree date
        actif int 1
        rue_id bigint
        observation string ''
    """,
    "pointage": """
        id bigint required
        date_pointage date required
        personnel_id bigint required
        rue_id bigint
        statut string 'Présent'
        heures_travaillees decimal 8
        heures_normales decimal 8
        heures_sup decimal 0
        tache string ''
        observation string ''
    """,
    "materiaux": """
        id bigint required
        nom string required
        unite string required
        categorie string 'Matériau'
        stock_initial decimal 0
        seuil_alerte decimal 0
        prix_unitaire decimal 0
    """,
    "approvisionnements": """
        id bigint required
        date_besoin date required
        rue_id bigint
        materiau_id bigint
        designation string required
        unite string required
        quantite_demandee decimal 0
        prix_unitaire_estime decimal 0
        demandeur string ''
        motif string ''
        statut string 'Besoin exprimé'
        date_validation_cc date
        validateur_cc string ''
        numero_bc string ''
        date_bc date
        fournisseur string ''
        date_reception date
        quantite_recue decimal 0
        bon_livraison string ''
        date_mise_stock date
        quantite_mise_stock decimal 0
        prix_unitaire_reel decimal 0
        observation string ''
    """,
    "mouvements_materiaux": """
        id bigint required
        date_mvt date required
        rue_id bigint
        materiau_id bigint required
        type_mvt string required
        quantite decimal required
        prix_unitaire decimal 0
        fournisseur string ''
        bon_livraison string ''
        appro_id bigint
        observation string ''
    """,
    "materiels": """
        id bigint required
        nom string required
        type_materiel string ''
        immatriculation string ''
        marque string ''
        annee int 0
        cout_horaire decimal 0
        cout_journalier decimal 0
        statut string 'Disponible'
        etat string 'Opérationnel'
        rue_id_affectation bigint
        date_acquisition date
        date_derniere_maintenance date
        prochain_entretien_heures decimal 0
        heures_totales decimal 0
        heure_compteur decimal 0
        observation string ''
        observations string ''
    """,
    "suivi_materiels": """
        id bigint required
        date_suivi date required
        rue_id bigint
        materiel_id bigint required
        heures_marche decimal 0
        heures_arret decimal 0
        heures_travail decimal 0
        carburant_materiau_id bigint
        carburant_l decimal 0
        carburant_consomme decimal 0
        cout_carburant decimal 0
        chauffeur string ''
        kilometre_debut decimal 0
        kilometre_fin decimal 0
        panne string ''
        observation string ''
        observations string ''
    """,
    "maintenance_materiels": """
        id bigint required
        materiel_id bigint required
        date_maintenance date required
        type_maintenance string 'Préventive'
        description string required
        cout decimal 0
        prestataire string ''
        pieces_changees string ''
        heures_compteur decimal 0
        prochain_entretien_h decimal 0
        observation string ''
    """,
    "journal_chantier": """
        id bigint required
        date_journal date required
        rue_id bigint
        meteo string ''
        temperature decimal 20
        nb_ouvriers_presents int 0
        nb_ouvriers int 0
        nb_encadrants int 0
        travaux_executes string ''
        travaux_realises string ''
        problemes string ''
        decisions string ''
        visiteurs string ''
        redacteur string ''
        observation string ''
        observations string ''
    """,
    "caisse_chantier": """
        id bigint required
        date_op date required
        categorie string 'CHANTIER'
        rue_id bigint
        type_op string required
        rubrique string required
        montant decimal required
        beneficiaire string ''
        reference_piece string ''
        mode_paiement string 'Espèces'
        valide int 0
        observation string ''
        observations string ''
    """,
    "courriers": """
        id bigint required
        date_courrier date required
        rue_id bigint
        type_courrier string 'Entrant'
        sens string ''
        reference string ''
        objet string required
        expediteur_destinataire string ''
        expediteur string ''
        destinataire string ''
        priorite string 'Normale'
        resume string ''
        actions_requises string ''
        statut string 'En cours'
        observation string ''
    """,
    "incidents": """
        id bigint required
        date_incident date required
        rue_id bigint
        type_incident string required
        gravite string 'Mineur'
        description string required
        personne_concernee string ''
        mesures_prises string ''
        nb_victimes int 0
        cout_estime decimal 0
        actions_correctives string ''
        statut string 'Ouvert'
        cloture int 0
        observation string ''
    """,
    "audit_trail": """
        id bigint required
        date_action date required
        table_concernee string required
        action string required
        enregistrement_id bigint
        details string ''
    """,
    "audit_log": """
        id bigint required
        timestamp timestamp_ntz required
        table_name string required
        action string required
        record_id bigint
        details string ''
    """,
    "receptions_appro": """
        id bigint required
        appro_id bigint required
        date_reception date required
        quantite_recue decimal 0
        bon_livraison string ''
        observation string ''
    """,
}

# Foreign keys as child table, child column, parent table, rule on delete.
FOREIGN_KEYS = [
    ("rues", "dossier_id", "dossiers", "set null"),
    ("livrables", "chantier_id", "rues", "cascade"),
    ("devis_rue", "rue_id", "rues", "cascade"),
    ("devis_rue", "livrable_id", "livrables", "set null"),
    ("realisations_journalieres", "rue_id", "rues", "none"),
    ("realisations_journalieres", "devis_id", "devis_rue", "none"),
    ("sous_traitants", "rue_id", "rues", "none"),
    ("devis_st", "st_id", "sous_traitants", "cascade"),
    ("devis_st", "rue_id", "rues", "none"),
    ("decomptes_st", "st_id", "sous_traitants", "none"),
    ("decomptes_st", "rue_id", "rues", "none"),
    ("decomptes_st", "devis_st_id", "devis_st", "none"),
    ("paiements_st", "st_id", "sous_traitants", "none"),
    ("paiements_st", "rue_id", "rues", "none"),
    ("personnel", "rue_id", "rues", "none"),
    ("pointage", "personnel_id", "personnel", "none"),
    ("pointage", "rue_id", "rues", "none"),
    ("approvisionnements", "rue_id", "rues", "none"),
    ("approvisionnements", "materiau_id", "materiaux", "none"),
    ("mouvements_materiaux", "rue_id", "rues", "none"),
    ("mouvements_materiaux", "materiau_id", "materiaux", "none"),
    ("materiels", "rue_id_affectation", "rues", "none"),
    ("suivi_materiels", "rue_id", "rues", "none"),
    ("suivi_materiels", "materiel_id", "materiels", "none"),
    ("suivi_materiels", "carburant_materiau_id", "materiaux", "none"),
    ("maintenance_materiels", "materiel_id", "materiels", "none"),
    ("journal_chantier", "rue_id", "rues", "none"),
    ("caisse_chantier", "rue_id", "rues", "none"),
    ("courriers", "rue_id", "rues", "none"),
    ("incidents", "rue_id", "rues", "none"),
    ("receptions_appro", "appro_id", "approvisionnements", "cascade"),
]

# Tables whose name column is unique.
UNIQUE_NAMES = ["dossiers", "sous_traitants", "materiaux", "materiels"]

# Vocabularies of the forms.
CURRENCY_SYMBOLS = {"GNF": "GNF", "FCFA": "FCFA", "USD": "$", "EUR": "€"}
UNITS = [
    "ml", "m", "km",
    "m²", "m2", "ha", "km²",
    "m³", "m3", "L", "l", "litre",
    "kg", "T", "tonne", "quintal",
    "U", "unité", "Ens", "ensemble", "Ft", "forfait", "Lot", "lot",
    "h", "j", "mois", "semaine",
    "sac", "palette", "rouleau", "ml²", "Ml", "barre",
]
STAFF_CATEGORIES = [
    "Directeur de projet", "Chef de chantier", "Conducteur de travaux", "Ingénieur",
    "Technicien", "Chef d'équipe", "Ouvrier qualifié", "Ouvrier", "Manœuvre",
    "Conducteur d'engins", "Chauffeur", "Gardien", "Autre",
]
ATTENDANCE_STATUSES = ["Présent", "Absent", "Congé", "Maladie", "Mission"]
PLANT_TYPES = [
    "Engin de terrassement", "Camion", "Grue", "Compacteur", "Centrale à béton",
    "Groupe électrogène", "Pompe", "Outillage", "Autre",
]
ORDER_STAGES = [
    "Besoin exprimé", "Validé chef chantier", "Bon de commande émis", "Réceptionné", "Mis en stock",
]
SEVERITIES = ["Mineur", "Modéré", "Grave", "Très grave"]
NEED, VALIDATED, ORDERED, RECEIVED, STOCKED = ORDER_STAGES
REJECTED = "Rejeté"
INCOME, EXPENSE, ADVANCE = "Recette", "Dépense", "Avance"
ENTRY, EXIT = "ENTREE", "SORTIE"
PRESENT = "Présent"
OPERATIONAL = "Opérationnel"
FUEL_CATEGORY = "carburant"

# Allowed values of the enumerated columns.
DOMAINS = {
    ("dossiers", "statut"): ["En cours", "Terminé", "Suspendu", "En préparation"],
    ("rues", "statut_chantier"): ["En cours", "Terminé", "Suspendu", "Non démarré"],
    ("devis_rue", "unite"): UNITS,
    ("sous_traitants", "statut"): ["Actif", "Terminé", "Suspendu"],
    ("paiements_st", "mode_paiement"): ["Virement", "Chèque", "Espèces", "Mobile Money"],
    ("personnel", "categorie"): STAFF_CATEGORIES,
    ("pointage", "statut"): ATTENDANCE_STATUSES,
    ("materiaux", "categorie"): ["Matériau", "Carburant", "Consommable", "Fourniture", "Autre"],
    ("approvisionnements", "statut"): [*ORDER_STAGES, REJECTED],
    ("mouvements_materiaux", "type_mvt"): [ENTRY, EXIT],
    ("materiels", "type_materiel"): [
        *PLANT_TYPES, "Engin TP", "Véhicule",
    ],
    ("materiels", "etat"): ["Opérationnel", "En panne", "En maintenance", "Hors service"],
    ("maintenance_materiels", "type_maintenance"): ["Préventive", "Corrective", "Vidange", "Réparation", "Autre"],
    ("caisse_chantier", "type_op"): [EXPENSE, INCOME, ADVANCE],
    ("caisse_chantier", "categorie"): ["Main d'œuvre", "Matériaux", "Transport", "Sous-traitance", "Divers"],
    ("courriers", "type_courrier"): ["Entrant", "Sortant", "Interne"],
    ("courriers", "priorite"): ["Normale", "Urgente", "Confidentielle"],
    ("incidents", "gravite"): [*SEVERITIES, "Critique"],
    ("incidents", "type_incident"): [
        "Accident corporel", "Accident matériel", "Presqu'accident", "Incident environnemental",
        "Violation sécurité", "Autre",
    ],
}

MONEY = T.DecimalType(18, 2)
_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "decimal": MONEY,
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: T.DataType
    required: bool
    default: str | None


@cache
def columns(table: str) -> tuple[ColumnSpec, ...]:
    """Columns of a table in order; a default is kept as the text of its literal."""
    specs = []
    for line in _COLUMNS[table].strip().splitlines():
        name, kind, *rest = line.split(None, 2)
        last = rest[0].strip() if rest else None
        required = last == "required"
        default = None if required or last is None else last.strip("'")
        specs.append(ColumnSpec(name, _TYPES[kind], required, default))
    return tuple(specs)


def table_names() -> list[str]:
    return list(_COLUMNS)


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.type, not c.required) for c in columns(table)])
