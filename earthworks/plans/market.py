"""Bill of quantities, recap matrix and statements of executed work."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthworks.functions.columns import (
    NO_DELIVERABLE, amount, line_key, or_label, percent, remaining, zero_if_null,
)
from earthworks.operators.aggregates import (
    DETAIL, LEVEL, TOTAL, append_levels, at_level, first_by_id, pivot_sums, total,
)
from earthworks.operators.joins import with_names
from earthworks.plans import facts
from earthworks.plans.facts import Frames
from earthworks.sources.tables import bill_lines


def lines_with_amount(tables: Frames, site: int | None = None, deliverable: int | None = None) -> DataFrame:
    return bill_lines(tables, site, deliverable).select(
        "id", "rue_id", "code_poste", "designation", "unite", "quantite_marche", "prix_unitaire",
        amount("quantite_marche", "prix_unitaire").alias("montant"),
    )


def lines_total(tables: Frames, site: int | None = None, deliverable: int | None = None) -> DataFrame:
    return lines_with_amount(tables, site, deliverable).agg(
        F.count(F.lit(1)).alias("nb_postes"), total("montant").alias("montant_total")
    )


def _keyed(tables: Frames, site: int | None) -> DataFrame:
    return bill_lines(tables, site).withColumn("cle", line_key("code_poste", "designation", "unite"))


def _keyed_lines(tables: Frames, site: int | None) -> DataFrame:
    named = with_names(_keyed(tables, site), tables["livrables"], "livrable_id", __livrable="nom")
    return named.withColumn("livrable", or_label("__livrable", NO_DELIVERABLE))


def recap(tables: Frames, site: int | None = None) -> DataFrame:
    """Recap matrix in long form: quantity of each line key per deliverable."""
    return _keyed_lines(tables, site).groupBy("rue_id", "cle", "livrable").agg(
        total("quantite_marche").alias("quantite")
    )


def recap_names(tables: Frames, site: int | None = None) -> DataFrame:
    """``rue_id`` and ``livrables``: the names that the lines of each site have, in the order in which they first occur.

    One row per site, whose length is the number of its deliverables.
    """
    first = _keyed_lines(tables, site).groupBy("rue_id", "livrable").agg(F.min("id").alias("premier"))
    named = first.groupBy("rue_id").agg(F.sort_array(F.collect_list(F.struct("premier", "livrable"))).alias("__named"))
    return named.select("rue_id", F.col("__named.livrable").alias("livrables"))


def recap_matrix(tables: Frames, site: int | None = None) -> DataFrame:
    """Recap matrix of every site: per line key, and in total, one array of quantities in the order of the site's names.

    Names are numbered within their site, so a portfolio of any number of names needs no column for each, and a row is as
    long as its own site's list. Missing quantities are 0.
    """
    places = recap_names(tables, site).select("rue_id", F.size("livrables").alias("__n"), F.posexplode("livrables").alias("__at", "livrable"))
    sums = recap(tables, site).join(places, ["rue_id", "livrable"])
    per_site = sums.groupBy("rue_id", "__n", "__at").agg(F.sum("quantite").alias("quantite"))
    entries = append_levels(
        at_level(sums.select("rue_id", "cle", "__n", "__at", "quantite"), DETAIL), at_level(per_site, TOTAL))
    zero = F.lit(0).cast(entries.schema["quantite"].dataType)
    filled = entries.groupBy(LEVEL, "rue_id", "cle", "__n").agg(
        F.sort_array(F.collect_list(F.struct("__at", "quantite"))).alias("__set"))
    # each entry brings the zeros between the one before and itself; what follows the last comes at the end
    last = lambda k: F.when(k == 0, -1).otherwise(F.get("__set", k - 1)["__at"])
    dense = F.flatten(F.transform("__set", lambda e, k: F.concat(
        F.array_repeat(zero, e["__at"] - last(k) - 1), F.array(e["quantite"]))))
    rest = F.array_repeat(zero, F.col("__n") - 1 - F.element_at("__set", -1)["__at"])
    return filled.select(LEVEL, "rue_id", "cle", F.concat(dense, rest).alias("quantites"))


def recap_cells(tables: Frames, site: int | None = None) -> DataFrame:
    """The matrix with the name of each quantity, a row per cell."""
    named = recap_matrix(tables, site).join(recap_names(tables, site), "rue_id")
    cells = F.arrays_zip(F.col("livrables").alias("livrable"), F.col("quantites").alias("quantite"))
    return named.select(LEVEL, "rue_id", "cle", F.posexplode(cells).alias("rang", "__cell")).select(
        LEVEL, "rue_id", "cle", "rang", "__cell.livrable", "__cell.quantite")


def recap_wide(tables: Frames, names: list[str] | None = None, site: int | None = None) -> DataFrame:
    """Recap matrix: a column per deliverable, then total quantity and amount, and a total row per site.

    Columns are the given names, or those of one site in first-seen order; totals always count every deliverable. Over
    several sites the names must be given, or see ``recap_matrix``, which needs none.
    """
    if names is None:
        if site is None:
            raise ValueError("give the names of the columns or one site")
        found = recap_names(tables, site).first()  # the list of one site
        names = found.livrables if found else []
    totals = recap_totals(tables, site)
    keys = totals.filter(F.col(LEVEL) == DETAIL).select("rue_id", "cle", "qte_totale", "montant_total")
    wide = pivot_sums(_keyed_lines(tables, site), ["rue_id", "cle"], "livrable", "quantite_marche", names)
    detail = at_level(wide.join(keys, ["rue_id", "cle"]), DETAIL)
    per_site = wide.groupBy("rue_id").agg(*[total(F.col(f"`{n}`")).alias(n) for n in names])
    sums = keys.groupBy("rue_id").agg(total("qte_totale").alias("qte_totale"), total("montant_total").alias("montant_total"))
    return append_levels(detail, at_level(per_site.join(sums, "rue_id"), TOTAL))


def recap_totals(tables: Frames, site: int | None = None) -> DataFrame:
    """Total quantity and amount per line key, then one total row per site.

    The amount is the summed quantity times the first unit price of the key.
    """
    lines = _keyed(tables, site)
    shown = ["code_poste", "designation", "unite", "prix_unitaire"]
    keys = lines.groupBy("rue_id", "cle").agg(
        *[first_by_id(c).alias(c) for c in shown], total("quantite_marche").alias("qte_totale")
    ).withColumn("montant_total", F.col("qte_totale").cast("decimal(20,2)") * F.col("prix_unitaire"))
    per_site = keys.groupBy("rue_id").agg(total("montant_total").alias("montant_total"))
    return append_levels(at_level(keys, DETAIL), at_level(per_site, TOTAL))


def work_statement(tables: Frames, site: int | None = None, deliverable: int | None = None) -> DataFrame:
    market, done = F.col("quantite_marche"), F.col("qte_executee")
    return facts.line_progress(tables, site, deliverable).select(
        "id", "rue_id", "code_poste", "designation", "unite", "quantite_marche", "qte_executee",
        remaining(market, done).alias("reste"),
        percent(done, market).alias("taux_pct"),
        "montant_marche", "montant_execute",
    )


def work_statement_total(tables: Frames, site: int | None = None, deliverable: int | None = None) -> DataFrame:
    """Market and executed amount of the chosen lines and their ratio."""
    sums = facts.line_progress(tables, site, deliverable).agg(
        total("montant_marche").alias("montant_marche"), total("montant_execute").alias("montant_execute")
    )
    return sums.withColumn("taux_pct", percent(F.col("montant_execute"), F.col("montant_marche")))


def work_statement_sites(tables: Frames, project: int | None = None) -> DataFrame:
    """Sites that own lines with their amounts, then the portfolio total."""
    sites = tables["rues"]
    if project is not None:
        sites = sites.filter(F.col("dossier_id") == project)
    named = sites.select(F.col("id").alias("rue_id"), F.struct("id", "nom").alias("site"))
    owned = named.join(facts.amounts_by_site(tables), "rue_id")
    rows = owned.rollup("site").agg(
        F.when(F.grouping_id() == 0, DETAIL).otherwise(TOTAL).alias(LEVEL),
        total("montant_marche").alias("montant_marche"), total("montant_execute").alias("montant_execute"),
    )
    market, done = F.col("montant_marche"), F.col("montant_execute")
    return rows.select(
        LEVEL, F.col("site.nom").alias("chantier"), "montant_marche", "montant_execute",
        remaining(market, done).alias("reste"), percent(done, market).alias("taux_pct"),
    )


def post_executions(tables: Frames, entries: DataFrame, day: dt.date, note: str = "") -> DataFrame:
    """Execution rows for entered quantities above 0, ready to append.

    ``entries`` holds ``devis_id`` and ``quantite``; the site is that of the line.
    """
    entered = entries.filter(F.col("quantite") > 0)
    lines = tables["devis_rue"].select(F.col("id").alias("devis_id"), "rue_id")
    return entered.join(lines, "devis_id").select(
        F.lit(day).alias("date_suivi"), "rue_id", "devis_id",
        zero_if_null(F.col("quantite")).alias("quantite_jour"), F.lit(note).alias("observation"),
    )
