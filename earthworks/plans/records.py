"""Site diary, petty cash, incidents, mail and the audit log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import GENERAL, signed, tagged_note
from earthworks.operators.aggregates import total, total_where
from earthworks.operators.filters import all_of, equals_if, text_contains
from earthworks.operators.joins import with_site
from earthworks.operators.windows import latest, running_total
from earthworks.plans.facts import Frames
from earthworks.sources import catalog
from earthworks.sources.tables import month as in_that_month, month_of, period, recent

SURPLUS, DEFICIT = "Excédent", "Déficit"
AUDIT_START = dt.date(2000, 1, 1)


def diary(
    tables: Frames, as_of: dt.date, days: int | None = 7, site: int | None = None, k: int | None = 200
) -> DataFrame:
    entries = recent(tables["journal_chantier"], "journal_chantier", as_of, days)
    chosen = entries.filter(equals_if("rue_id", site))
    return with_site(latest(chosen, "date_journal", "id", k), tables, label=GENERAL).select(
        "id", "date_journal", "chantier", "meteo", "temperature", "nb_ouvriers", "nb_encadrants",
        "travaux_realises", "observations",
    )


def diary_weekly(tables: Frames, site: int | None = None) -> DataFrame:
    """Worker-days and supervisor-days of every week (from Monday) and site."""
    monday = F.date_trunc("week", F.col("date_journal")).cast("date")
    weeks = tables["journal_chantier"].filter(equals_if("rue_id", site)).groupBy(
        "rue_id", monday.alias("semaine")
    )
    sums = weeks.agg(
        F.count(F.lit(1)).alias("nb_entrees"),
        total("nb_ouvriers").alias("ouvriers_jours"),
        total("nb_encadrants").alias("encadrants_jours"),
    )
    return with_site(sums.withColumn("fin_semaine", F.date_add("semaine", 6)), tables).select(
        "chantier", "semaine", "fin_semaine", "nb_entrees", "ouvriers_jours", "encadrants_jours"
    )


def diary_notes(entries: DataFrame) -> DataFrame:
    """Diary observations put together from the parts of the form."""
    note = tagged_note(
        incidents=F.col("incidents"), livraisons=F.col("livraisons"),
        visites=F.col("visites"), observations=F.col("remarques"),
    )
    return entries.select("id", note.alias("observations"))


def _cash(tables: Frames, site: int | None, month: str | None, last_n: int | None) -> DataFrame:
    chosen = in_that_month(tables["caisse_chantier"], "caisse_chantier", month).filter(equals_if("rue_id", site))
    return chosen if last_n is None else latest(chosen, "date_op", "id", last_n)


def cash_list(
    tables: Frames, site: int | None = None, month: str | None = None, last_n: int | None = 200
) -> DataFrame:
    return with_site(_cash(tables, site, month, last_n), tables).select(
        "id", "date_op", "chantier", "type_op", "categorie", "montant", "beneficiaire", "reference_piece"
    )


def cash_months(tables: Frames, site: int | None = None, month: str | None = None) -> DataFrame:
    """Income, expense, advances and balance of every month."""
    kind = F.col("type_op")
    months = _cash(tables, site, month, None).groupBy(month_of("date_op").alias("mois"))
    sums = months.agg(
        total_where(kind == catalog.INCOME, "montant").alias("recettes"),
        total_where(kind == catalog.EXPENSE, "montant").alias("depenses"),
        total_where(kind == catalog.ADVANCE, "montant").alias("avances"),
    ).withColumn("solde", F.col("recettes") - F.col("depenses") - F.col("avances"))
    return sums.withColumn("etat", F.when(F.col("solde") >= 0, SURPLUS).otherwise(DEFICIT))


def cash_running(
    tables: Frames, per_site: bool, site: int | None = None, month: str | None = None, last_n: int | None = None
) -> DataFrame:
    """Cash operations with the running balance after each, to whole units.

    The order is date, then id. ``last_n`` starts the balance at 0 on the
    newest rows only, as the cash page does.
    """
    rows = _cash(tables, site, month, last_n).select("id", "date_op", "rue_id", "type_op", "montant")
    impact = signed("type_op", "montant", [catalog.INCOME], [catalog.EXPENSE, catalog.ADVANCE])
    by = ["rue_id"] if per_site else []
    summed = running_total(rows, impact, by, ["date_op", "id"], "solde_cumule")
    return summed.withColumn("solde_cumule", F.round("solde_cumule", 0))


def incidents(
    tables: Frames, site: int | None = None, status: str | None = None, k: int | None = 200
) -> DataFrame:
    chosen = tables["incidents"].filter(equals_if("rue_id", site) & equals_if("statut", status))
    return with_site(latest(chosen, "date_incident", "id", k), tables).select(
        "id", "date_incident", "chantier", "type_incident", "gravite", "nb_victimes", "statut", "description"
    )


def incident_breakdown(tables: Frames, site: int | None = None) -> DataFrame:
    return tables["incidents"].filter(equals_if("rue_id", site)).groupBy("statut", "gravite").agg(
        F.count(F.lit(1)).alias("nb"), total("nb_victimes").alias("victimes"), total("cout_estime").alias("cout")
    )


def mail(
    tables: Frames, kind: str | None = None, priority: str | None = None, status: str | None = None,
    k: int | None = 200,
) -> DataFrame:
    wanted = all_of(
        equals_if("type_courrier", kind), equals_if("priorite", priority), equals_if("statut", status)
    )
    chosen = latest(tables["courriers"].filter(wanted), "date_courrier", "id", k)
    return with_site(chosen, tables, label=GENERAL).select(
        "id", "date_courrier", "reference", "type_courrier", "priorite", "expediteur", "destinataire",
        "chantier", "objet", "statut",
    )


def audit_view(
    tables: Frames, as_of: dt.date, days: int | None = None, table_part: str | None = None,
    action: str | None = None, k: int | None = 500,
) -> DataFrame:
    """Newest audit rows of a period; the filter matches the stored action."""
    since = AUDIT_START if days is None else max(AUDIT_START, as_of - dt.timedelta(days=days))
    chosen = period(tables["audit_log"], "audit_log", since, None).filter(
        text_contains("table_name", table_part) & equals_if("action", action)
    )
    return latest(chosen, "timestamp", "id", k).select(
        "id", "timestamp", "table_name", "action", "record_id", "details"
    )
