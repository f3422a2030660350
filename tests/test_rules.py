"""Edge cases with literal expectations."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from earthworks.functions import columns as fn
from earthworks.operators import aggregates, changes, windows
from earthworks.plans import dashboard, ingest, market, procurement, quality, records, reports, stock, subcontract

D = dt.date


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


class TestDelays:
    AS_OF = D(2024, 3, 1)

    @pytest.fixture
    def figures(self, make):
        sites = make("rues", [
            {"id": 1, "nom": "no start", "delai_jours": 90},
            {"id": 2, "nom": "no delay", "date_demarrage": D(2024, 1, 1), "delai_jours": 0},
            {"id": 3, "nom": "future", "date_demarrage": D(2024, 3, 31), "delai_jours": 60},
            {"id": 4, "nom": "late", "date_demarrage": D(2024, 1, 1), "delai_jours": 30},
            {"id": 5, "nom": "half", "date_demarrage": D(2024, 2, 1), "delai_jours": 58},
        ])
        t = {"rues": sites}
        return (
            {r.rue_id: r for r in dashboard.site_delays(t, self.AS_OF).collect()},
            {r.rue_id: r for r in dashboard.site_schedule(t, self.AS_OF).collect()},
        )

    @pytest.mark.parametrize("site, expected", [
        (1, (0, 90, 0.0)), (2, (0, 0, 0.0)), (3, (0, 90, -50.0)), (4, (60, -30, 100.0)), (5, (29, 29, 50.0)),
    ])
    def test_figures(self, figures, site, expected):
        row = figures[0][site]
        assert (row.jours_consommes, row.jours_restants, row.pct_delai) == expected

    def test_schedule(self, figures):
        late, half, none = figures[1][4], figures[1][5], figures[1][2]
        assert (late.fin_prevue, late.depassement, late.tranche, late.delai_mois) == (D(2024, 1, 31), True, "en retard", 1.0)
        assert (half.depassement, half.tranche) == (False, "ok")
        assert none.tranche is None


class TestMarket:
    @pytest.fixture
    def t(self, make):
        return {
            "rues": make("rues", [{"id": 1, "nom": "A"}, {"id": 2, "nom": "B"}, {"id": 3, "nom": "empty"}]),
            "dossiers": make("dossiers", [{"id": 1, "nom": "P"}]),
            "livrables": make("livrables", [
                {"id": 1, "chantier_id": 1, "nom": "Rue 1"}, {"id": 2, "chantier_id": 1, "nom": "Rue 2"},
                {"id": 3, "chantier_id": 1, "nom": "Rue 1"},
            ]),
            "devis_rue": make("devis_rue", [
                {"id": 1, "rue_id": 1, "designation": "dig", "unite": "m3", "quantite_marche": 10, "prix_unitaire": 5, "livrable_id": 1},
                {"id": 2, "rue_id": 1, "designation": "free", "unite": "U", "quantite_marche": 0, "prix_unitaire": 7, "livrable_id": 2},
                {"id": 3, "rue_id": 1, "designation": " Dig ", "unite": "M3", "quantite_marche": 4, "prix_unitaire": 6, "livrable_id": 3},
                {"id": 4, "rue_id": 2, "designation": "dig", "unite": "m3", "quantite_marche": 1, "prix_unitaire": 1},
                {"id": 5, "rue_id": 1, "designation": "dig", "unite": "m3", "quantite_marche": 2, "prix_unitaire": 9,
                 "code_poste": "nan"},
            ]),
            "realisations_journalieres": make("realisations_journalieres", [
                {"id": 1, "date_suivi": D(2024, 1, 1), "rue_id": 1, "devis_id": 1, "quantite_jour": 12},
                {"id": 2, "date_suivi": D(2024, 1, 2), "rue_id": 1, "devis_id": 2, "quantite_jour": 3},
                {"id": 3, "date_suivi": D(2024, 1, 2), "rue_id": 1, "devis_id": 1, "quantite_jour": 1},
            ]),
        }

    def test_statement_guards_zero_and_clamps(self, t):
        got = {r.id: (float(r.reste), r.taux_pct, float(r.montant_execute)) for r in market.work_statement(t).collect()}
        assert got[1] == (0.0, 130.0, 65.0)
        assert got[2] == (0.0, 0.0, 21.0)
        assert got[4] == (1.0, 0.0, 0.0)

    def test_reports_count_a_zero_market_as_one(self, t):
        got = {r.id: r.pct_avancement for r in reports.gap(t).collect()}
        assert got[2] == 300.0
        detail = reports.progress(t).filter("niveau = 'detail' AND id = 2").collect()
        assert detail[0].pct_avancement == 300.0

    def test_sites_without_lines(self, t):
        got = {r.chantier: (float(r.montant_marche), r.taux_pct) for r in dashboard.site_progress(t).collect()}
        assert got["empty"] == (0.0, 0.0)
        assert "empty" not in [r.chantier for r in market.work_statement_sites(t).collect()]

    def test_key_falls_back_to_designation_and_unit(self, t):
        totals = {(r.rue_id, r.cle): r for r in market.recap_totals(t).filter("niveau = 'detail'").collect()}
        dig = totals[1, "dig|m3"]
        assert (float(dig.qte_totale), float(dig.prix_unitaire), float(dig.montant_total)) == (16.0, 5.0, 80.0)

    def test_recap_total_is_the_sum_of_its_rows(self, t):
        got = market.recap_totals(t, site=1).groupBy("niveau").agg(F.sum("montant_total").alias("m")).collect()
        assert len({float(r.m) for r in got}) == 1

    def test_runs_restart_when_a_name_comes_back(self, t):
        got = sorted(rows(reports.deliverable_runs(t), "rue_id", "id", "groupe"))
        assert got == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 5, 1), (2, 4, 1)]

    def test_subtotals_add_up(self, t):
        got = {
            r.niveau: float(r.m)
            for r in reports.progress(t).groupBy("niveau").agg(F.sum("montant_marche").alias("m")).collect()
        }
        assert got["detail"] == got["sous-total"] == got["total"]

    def test_report_rows_are_ordered(self, t):
        levels = [r.niveau for r in reports.progress(t, site=1).collect()]
        assert levels == ["detail", "sous-total"] * 4 + ["total"]

    def test_executions_above_zero_only(self, t, spark):
        entries = spark.createDataFrame([(1, 2), (2, 0)], "devis_id bigint, quantite int")
        got = market.post_executions(t, entries, D(2024, 5, 1)).collect()
        assert [(r.devis_id, r.rue_id, r.quantite_jour) for r in got] == [(1, 1, 2)]


class TestSubcontractors:
    @pytest.fixture
    def t(self, make):
        return {
            "rues": make("rues", [{"id": 1, "nom": "A"}]),
            "sous_traitants": make("sous_traitants", [{"id": 1, "nom": "S", "montant_contrat": 1000}]),
            "devis_st": make("devis_st", [
                {"id": 1, "st_id": 1, "designation": "a", "unite": "U", "quantite": 10, "prix_unitaire": 10},
                {"id": 2, "st_id": 1, "designation": "b", "unite": "U", "quantite": 5, "prix_unitaire": 20},
            ]),
            "decomptes_st": make("decomptes_st", [
                {"id": i, "st_id": 1, "devis_st_id": 1, "date_decompte": D(2024, 1, i), "quantite_executee": 2, "montant": 25}
                for i in (1, 2, 3)
            ]),
            "paiements_st": make("paiements_st", [
                {"id": i, "st_id": 1, "date_paiement": D(2024, 1, i), "montant": 30} for i in (1, 2)
            ]),
        }

    def test_children_do_not_multiply(self, t):
        r = reports.subcontractors(t).collect()[0]
        assert [float(x) for x in (r.montant_devis, r.total_decompte, r.total_paye, r.solde_a_payer)] == [200, 75, 60, 15]

    def test_executed_amount_is_the_stored_one(self, t):
        r = subcontract.statement(t).filter("id = 1").collect()[0]
        assert (float(r.qte_executee), r.taux_pct, float(r.montant_execute)) == (6.0, 60.0, 75.0)
        assert float(subcontract.account(t).collect()[0].solde_a_payer) == 15.0


class TestStock:
    @pytest.fixture
    def t(self, make):
        def move(i, day, kind, q, material=1):
            return {"id": i, "date_mvt": D(2024, 1, day), "materiau_id": material, "type_mvt": kind, "quantite": q}

        return {
            "materiaux": make("materiaux", [
                {"id": 1, "nom": "cement", "unite": "sac", "stock_initial": 10, "seuil_alerte": 8, "prix_unitaire": 2.5},
                {"id": 2, "nom": "sand", "unite": "m3", "stock_initial": 0, "seuil_alerte": 0},
            ]),
            "mouvements_materiaux": make("mouvements_materiaux", [
                move(2, 1, "SORTIE", 4), move(1, 1, "SORTIE", 9), move(3, 2, "ENTREE", 6), move(4, 3, "SORTIE", 3),
            ]),
        }

    def test_levels(self, t):
        got = {r.id: (float(r.stock), float(r.valeur), r.alerte) for r in stock.levels(t).collect()}
        assert got == {1: (0.0, 0.0, True), 2: (0.0, 0.0, False)}

    def test_overdrawn_follows_date_then_id(self, t):
        got = [(r.id, float(r.stock_avant)) for r in stock.overdrawn_exits(t).collect()]
        assert got == [(2, 1.0)]

    def test_stock_to_post_falls_back_to_the_order(self, make):
        t = {
            "approvisionnements": make("approvisionnements", [
                {"id": 1, "date_besoin": D(2024, 1, 1), "designation": "x", "unite": "U", "statut": "Réceptionné", "quantite_recue": 7},
                {"id": 2, "date_besoin": D(2024, 1, 1), "designation": "y", "unite": "U", "statut": "Réceptionné", "quantite_recue": 7},
            ]),
            "receptions_appro": make("receptions_appro", [
                {"id": 1, "appro_id": 2, "date_reception": D(2024, 1, 2), "quantite_recue": 3},
            ]),
        }
        got = {r.id: float(r.qte_a_stocker) for r in procurement.to_stock(t).collect()}
        assert got == {1: 7.0, 2: 3.0}


def test_reception_share_is_capped(make):
    t = {
        "approvisionnements": make("approvisionnements", [
            {"id": 1, "date_besoin": D(2024, 1, 1), "designation": "x", "unite": "U", "statut": "Bon de commande émis",
             "quantite_demandee": 10},
        ]),
        "receptions_appro": make("receptions_appro", [
            {"id": i, "appro_id": 1, "date_reception": D(2024, 1, 2), "quantite_recue": 8} for i in (1, 2)
        ]),
    }
    r = procurement.reception_status(t).collect()[0]
    assert (float(r.total_recu), float(r.reste), r.pct_recu) == (16.0, 0.0, 100.0)


def test_cash_balance_on_one_date_follows_ids(make):
    t = {"caisse_chantier": make("caisse_chantier", [
        {"id": 2, "date_op": D(2024, 1, 1), "rue_id": 1, "type_op": "Dépense", "rubrique": "r", "montant": 30},
        {"id": 1, "date_op": D(2024, 1, 1), "rue_id": 1, "type_op": "Recette", "rubrique": "r", "montant": 100},
        {"id": 3, "date_op": D(2024, 1, 2), "rue_id": 1, "type_op": "Avance", "rubrique": "r", "montant": 20},
    ])}
    got = sorted(rows(records.cash_running(t, per_site=True), "id", "solde_cumule"))
    assert [(i, float(s)) for i, s in got] == [(1, 100.0), (2, 70.0), (3, 50.0)]
    newest = sorted(rows(records.cash_running(t, per_site=False, last_n=2), "id", "solde_cumule"))
    assert [(i, float(s)) for i, s in newest] == [(2, -30.0), (3, -50.0)]


class TestTexts:
    @pytest.mark.parametrize("raw, expected", [
        (" N° Code ", "n_code"), ("Désignation", "designation"), ("Prix (HT) / U.", "prix_ht_u"),
        ("Œuvre - dœil", "oeuvre_doeil"), ("__a  b__", "a_b"), ("ÇÀÊ", "cae"),
    ])
    def test_normalised_name(self, spark, raw, expected):
        df = spark.createDataFrame([(raw,)], "v string")
        assert df.select(fn.normalised_name("v")).first()[0] == expected

    def test_money_and_percent(self, spark):
        df = spark.createDataFrame([(1234567.5, 0.25), (None, None)], "a double, b double")
        got = df.select(fn.money_text(F.col("a"), "EUR"), fn.percent_text(F.col("b"))).collect()
        assert [tuple(r) for r in got] == [("1 234 568 €", "0.3 %"), ("0", "0.0 %")]

    @pytest.mark.parametrize("raw, number", [("12.5", 12.5), (" 3 ", 3.0), ("n/a", 0.0), ("", 0.0), (None, 0.0), ("nan", 0.0)])
    def test_numbers(self, spark, raw, number):
        assert spark.createDataFrame([(raw,)], "v string").select(fn.to_number("v")).first()[0] == number

    def test_note(self, spark):
        df = spark.createDataFrame([(" a ", "", None, "d")], "i string, l string, v string, o string")
        note = fn.tagged_note(incidents=F.col("i"), livraisons=F.col("l"), visites=F.col("v"), observations=F.col("o"))
        assert df.select(note).first()[0] == "INCIDENTS/SÉCURITÉ: a\nOBSERVATIONS: d"


class TestSheets:
    @pytest.fixture
    def cells(self, spark):
        def sheet(file_id, grid):
            return [(file_id, r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line)]

        data = sheet(1, [
            ["Devis", None, None, None], ["Code poste", "Désignation des travaux", "Désignation", "Unité"],
            ["1", "long", "short", "m"], ["2", "x", "nan", "m"], [None, " ", None, ""], ["3", "y", "z", "m"],
        ]) + sheet(2, [["a", "b"], ["c", "d"]]) + sheet(3, [["Code", "code"], ["Qté", "Prix"], ["1", "2"]])
        return spark.createDataFrame(data, "file_id int, row_idx int, col_idx int, value string")

    def test_header(self, cells):
        got = {r.file_id: (r.header_row, r.score) for r in ingest.detect_header(cells).collect()}
        assert got == {1: (1, 4), 2: (0, 0), 3: (0, 2)}

    def test_exact_name_wins_over_a_partial_one(self, cells):
        got = {r.champ: (r.col_idx, r.rang) for r in ingest.fields_of(ingest.layout(cells)).filter("file_id = 1").collect()}
        assert got["designation"] == (2, 1)

    def test_rows_are_renumbered_without_blank_ones(self, cells):
        got = sorted(rows(ingest.grid(cells).filter("file_id = 1"), "ligne", "row_idx", "designation"))
        assert got == [(0, 2, "short"), (1, 3, "nan"), (2, 5, "z")]

    def test_refused_files(self, cells):
        got = dict(rows(ingest.missing_fields(ingest.layout(cells)), "file_id", "manquants"))
        assert 1 not in got and got[2] == "designation,unite"

    def test_simple_import_drops_unnamed_rows(self, cells, spark):
        files = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "file_id int, rue_id bigint")
        got = ingest.import_simple(cells, files).collect()
        assert sorted((r.file_id, r.code_poste, r.designation) for r in got) == [(1, "1", "short"), (1, "3", "z")]


    def test_subcontractor_sheet(self, cells, spark):
        files = spark.createDataFrame([(1, 4)], "file_id int, st_id bigint")
        got = ingest.import_simple(cells, files, target="sous_traitant").collect()
        assert {(r.st_id, r.designation, r.unite) for r in got} == {(4, "short", "m"), (4, "z", "m")}

    def test_wide_sheet_follows_the_first_deliverable_by_name(self, spark, make):
        sheet = [["Désignation", "Unité", "Rue A", "Total"], ["dig", "m", "3", "9"], ["fill", "m", "0", "0"], ["cut", "m", "x", "2"]]
        cells = spark.createDataFrame(
            [(1, r, c, v) for r, line in enumerate(sheet) for c, v in enumerate(line)],
            "file_id int, row_idx int, col_idx int, value string",
        )
        files = spark.createDataFrame([(1, 1)], "file_id int, rue_id bigint")
        named = make("livrables", [
            {"id": 8, "chantier_id": 1, "nom": "Rue A2"}, {"id": 9, "chantier_id": 1, "nom": "Rue A"},
            {"id": 7, "chantier_id": 2, "nom": "Rue A"},
        ])
        got = [(r.livrable_id, r.designation, r.quantite) for r in ingest.import_multi(cells, files, named).collect()]
        assert got == [(9, "dig", 3.0)]
        assert ingest.import_simple(cells, files, named).isEmpty()


class TestChanges:
    @pytest.fixture
    def base(self, make):
        return make("materiaux", [{"id": i, "nom": f"m{i}", "unite": "U", "stock_initial": i} for i in range(1, 6)])

    def test_append_numbers_after_the_highest(self, base, make):
        new = make("materiaux", [{"id": 0, "nom": n, "unite": "U"} for n in "zx"]).drop("id")
        got = changes.append_rows(base, new, "materiaux", "nom")
        assert sorted(rows(got.filter("id > 5"), "id", "nom")) == [(6, "x"), (7, "z")]

    def test_upsert_twice_changes_nothing_more(self, base, make):
        change = make("materiaux", [{"id": 2, "nom": "m2", "unite": "kg"}, {"id": 9, "nom": "new", "unite": "kg"}])
        once = changes.upsert_rows(base, change, ["nom"], "id")
        twice = changes.upsert_rows(once, change, ["nom"], "id")
        assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
        assert once.count() == 6

    def test_last_change_of_a_key_counts(self, spark):
        base = spark.createDataFrame([(1, "a")], "k int, v string")
        change = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "k int, v string, o int")
        assert changes.upsert_rows(base, change, ["k"], "o").collect()[0].v == "c"

    def test_update_can_set_null(self, spark):
        base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
        change = spark.createDataFrame([(1, None)], "id int, v string")
        assert sorted(rows(changes.update_rows(base, change, ["v"]), "id", "v")) == [(1, None), (2, "b")]

    def test_replacing_a_slice_by_itself_changes_nothing(self, base):
        same = changes.replace_slice(base, base.filter("unite = 'U'"), ["unite"])
        assert sorted(map(tuple, same.collect())) == sorted(map(tuple, base.collect()))

    def test_no_orphans_after_deleting_sites(self, tables):
        gone = tables["rues"].filter("id < 4").select("id")
        after = {**{k: tables[k] for k in tables}, **changes.cascade_delete(tables, gone)}
        before = {r.table_name + r.colonne: r.n for r in quality.orphans(tables).collect()}
        left = {r.table_name + r.colonne: r.n for r in quality.orphans(after).collect()}
        assert all(left[k] <= before[k] for k in left) and after["rues"].count() == 6

    def test_audit_of_no_change_is_empty(self, base):
        assert changes.audit_diff(base, base, "materiaux", dt.datetime(2024, 1, 1)).isEmpty()


def test_audit_time_does_not_depend_on_the_time_zone(spark, make):
    one = make("materiaux", [{"id": 1, "nom": "a", "unite": "U"}])
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = changes.audit_diff(one, one.filter("id > 1"), "materiaux", dt.datetime(2024, 1, 1, 8)).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (row.timestamp, row.action) == (dt.datetime(2024, 1, 1, 8), "DELETE")


def test_text_dump_gets_types_and_labels(spark):
    from earthworks.sources.text_load import typed

    raw = spark.createDataFrame(
        [("1", "2024-01-02", "PRESENT", "7.5"), ("2", "bientot", "Vacances", "")],
        "id string, date_pointage string, statut string, heures_travaillees string",
    )
    got = [tuple(r) for r in typed(raw, "pointage").select("id", "date_pointage", "statut").collect()]
    assert got == [(1, D(2024, 1, 2), "Présent"), (2, None, "Vacances")]


def test_first_value_skips_null(spark):
    df = spark.createDataFrame([(1, "a", None), (3, "a", "late"), (2, "a", "early")], "id int, k string, v string")
    assert aggregates.first_per_key(df, ["k"], ["v"]).collect()[0].v == "early"


def test_illegal_and_double_moves_are_refused(make, spark):
    t = {
        "approvisionnements": make("approvisionnements", [
            {"id": i, "date_besoin": D(2024, 1, 1), "designation": "x", "unite": "U"} for i in (1, 2, 3)
        ]),
        "receptions_appro": make("receptions_appro", [{"id": 1, "appro_id": 1, "date_reception": D(2024, 1, 1)}]),
    }
    asked = [(1, "Validé chef chantier"), (2, "Mis en stock"), (3, "Rejeté"), (3, "Rejeté"), (4, "Rejeté")]
    requests = spark.createDataFrame(
        [(i, s, D(2024, 2, 1), "chef", None, None) for i, s in asked],
        "appro_id bigint, cible string, date_etape date, acteur string, numero_bc string, fournisseur string",
    )
    orders, refused = procurement.transitions(t, requests)
    assert sorted(rows(orders, "id", "statut")) == [
        (1, "Validé chef chantier"), (2, "Besoin exprimé"), (3, "Besoin exprimé")]
    assert sorted(rows(refused, "appro_id", "motif_refus")) == [
        (2, "interdit"), (3, "doublon"), (3, "doublon"), (4, "inconnu")]


@pytest.mark.parametrize("number", range(1, 12))
def test_every_report_can_be_built(tables, number):
    start, end = reports.default_period(D(2024, 1, 30))
    sheets = reports.report(number, tables, None, start, end)
    assert len(sheets) == (6 if number == 11 else 1)


def test_unknown_report(tables):
    with pytest.raises(ValueError):
        reports.report(12, tables)


def test_latest_settles_ties_by_id(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1)), (2, D(2024, 1, 1))], "id int, d date")
    assert windows.latest(df, "d", "id", 1).collect()[0].id == 2
