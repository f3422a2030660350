"""Running totals that open with stored sums, containment by letter groups, orphans by bitmaps, recap and batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from earthworks.plans import facts, history, ingest, market, procurement, quality, records, reports, stock, subcontract
from earthworks.sources import catalog, sinks
from earthworks.sources.tables import MONTH
from earthworks.sources.versions import Store

D = dt.date


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def books(spark, tables, tmp_path):
    """A cash book with some rows without a date or a site, and movements under numbers."""
    cash = tables["caisse_chantier"].withColumns({
        "date_op": F.when(F.col("id") % 97 != 0, F.col("date_op")), "rue_id": F.when(F.col("id") % 41 != 0, F.col("rue_id"))})
    moves = tables["mouvements_materiaux"].withColumn("id", F.xxhash64("id"))
    store = Store(spark, f"file://{tmp_path}/books")
    store.create({"caisse_chantier": cash, "mouvements_materiaux": moves, "materiaux": tables["materiaux"]})
    return store


@pytest.mark.parametrize("per_site", [True, False])
@pytest.mark.parametrize("since", ["", "1992-01", "1996-07", "2030-01"])
def test_balances_from_a_month_on_equal_the_whole_run(books, per_site, since):
    whole = records.cash_running({"caisse_chantier": books.read("caisse_chantier")}, per_site)
    wanted = whole.filter(F.coalesce(F.date_format("date_op", "yyyy-MM"), F.lit("")) >= since)
    assert rows(history.cash_running(books, since, per_site)) == rows(wanted)


def test_overdrawn_exits_from_a_month_on(books):
    wanted = stock.overdrawn_exits(books.tables()).filter("date_mvt >= DATE'1996-07-01'")
    assert rows(history.overdrawn_exits(books, "1996-07")) == rows(wanted) and wanted.count() > 10


def test_a_change_sums_its_own_writes_only(books, spark):
    """After a change the sums of the unchanged files are still there, and older months are not read for the balances."""
    history.cash_running(books, "1996-07", False).count()
    late = books.read("caisse_chantier").filter("date_op >= DATE'1998-05-01' AND id % 3 = 0").drop(MONTH)
    books.upsert("caisse_chantier", late.withColumn("montant", (F.col("montant") * 2).cast(catalog.MONEY)), ["id"], "id")
    since = history.first_changed(books, "caisse_chantier", 0, 1)
    assert since == "1998-05" and history.first_changed(books, "caisse_chantier", 1, 1) is None
    run = history.cash_running(books, since, False)
    folders = spark.read.parquet(f"{books.directory}/soldes/caisse_chantier/tout").select("ecriture").distinct().count()
    assert folders == len({p.write for p in books.version().of("caisse_chantier")}) == 2
    whole = records.cash_running({"caisse_chantier": books.read("caisse_chantier")}, False)
    assert rows(run) == rows(whole.filter("date_op >= DATE'1998-05-01'"))
    months = {f.split(f"{MONTH}=")[1][:7] for f in books.read("caisse_chantier", None, [m for m in books.months("caisse_chantier") if (m or "") >= since]).inputFiles()}
    assert min(months) == "1998-05"


def test_containment_equals_all_pairs(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abé ") for _ in range(random.choice([0, 1, 2, 3, 4, 9])))
    data = [[(random.randrange(3), word()) for _ in range(150)] for _ in range(2)]
    left, right = (spark.createDataFrame(d, "rue_id long, texte string").distinct() for d in data)
    wanted = {(s, a, b) for s, a in set(data[0]) for t, b in set(data[1]) if s == t and (b in a or a in b)}
    found = [tuple(r) for r in ingest.containment(left, right).collect()]
    assert set(found) == wanted and len(found) == len(set(found))


def test_names_that_begin_alike_are_no_candidates(spark):
    """Of 400 x 400 names with a common beginning, only those that share a rare group of letters are compared."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    names = spark.range(400).select(F.lit(1).alias("rue_id"), F.concat(F.lit("livrable "), digest).alias("texte"))
    pairs = ingest.containment_candidates(names, names)
    assert pairs.count() < 16000 and ingest.containment(names, names).count() == 400


@pytest.mark.parametrize("limit", [quality.BITMAP_BYTES, 0])
def test_orphans_of_any_ids(spark, make, monkeypatch, limit):
    """Negative, huge and missing keys, by bitmaps at the scans and by counts first."""
    monkeypatch.setattr(quality, "BITMAP_BYTES", limit)
    keys = [None, 0, -1, 1, 32768, 32769, -32768, 2**62, -(2**62), 7]
    sites = make("rues", [{"id": k, "nom": str(k)} for k in keys[1:7]])
    cash = make("caisse_chantier", [{"id": n, "rue_id": keys[n % 10], "date_op": D(2024, 1, 1)} for n in range(100)])
    found = {(r.table_name, r.colonne): r.n for r in quality.orphans({"rues": sites, "caisse_chantier": cash}).collect()}
    assert found == {("caisse_chantier", "rue_id"): 30}


def test_orphans_shuffle_no_child(tables):
    plan = quality.orphans(tables)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(parent" not in plan and "hashpartitioning(table_name" in plan


def test_recap_matrix_has_the_names_of_each_site(spark, make):
    """Many names over many sites: a row is as long as its site's list."""
    names = make("livrables", [{"id": k, "chantier_id": k % 50, "nom": f"L{k}"} for k in range(1500)])
    lines = make("devis_rue", [
        {"id": k, "rue_id": k % 50, "livrable_id": k % 1500 if k % 11 else None, "designation": f"d{k % 4}", "unite": "u",
         "quantite_marche": k % 6, "prix_unitaire": 2} for k in range(6000)])
    frames = {"devis_rue": lines, "livrables": names}
    matrix = {(r.niveau, r.rue_id, r.cle): r.quantites for r in market.recap_matrix(frames).collect()}
    listed = {r.rue_id: r.livrables for r in market.recap_names(frames).collect()}
    assert all(len(q) == len(listed[s]) for (_, s, _), q in matrix.items()) and len(matrix) == 50 * 4 // 2 + 50
    for r in market.recap(frames).collect():
        assert matrix["detail", r.rue_id, r.cle][listed[r.rue_id].index(r.livrable)] == r.quantite
    assert sum(sum(q) for (level, *_), q in matrix.items() if level == "detail") == sum(k % 6 for k in range(6000))
    assert sum(sum(q) for (level, *_), q in matrix.items() if level == "total") == sum(k % 6 for k in range(6000))


def test_wide_recap_of_one_site_or_given_names(tables):
    wide = market.recap_wide(tables, site=3)
    cells = market.recap_cells(tables, site=3).collect()
    assert [c for c in wide.columns if c in {r.livrable for r in cells}] == [r.livrable for r in sorted(
        {(r.rang, r.livrable): r for r in cells}.values(), key=lambda r: r.rang)]
    by_row = {(r.niveau, r.cle): r for r in wide.collect()}
    assert all(by_row[c.niveau, c.cle][c.livrable] == c.quantite for c in cells)
    with pytest.raises(ValueError, match="one site"):
        market.recap_wide(tables)


REQUEST = ("appro_id long, numero long, cible string, date_etape date, acteur string, numero_bc string, fournisseur string, "
           "quantite decimal(18,2), prix decimal(18,2)")


def batch(spark, make, orders, requests, receptions=()):
    frames = {
        "approvisionnements": make("approvisionnements", [{"id": 0, "materiau_id": 5, "prix_unitaire_estime": 3, "quantite_recue": 0} | o for o in orders]),
        "receptions_appro": make("receptions_appro", [{"id": k, "appro_id": a, "quantite_recue": q} for k, (a, q) in enumerate([(-1, 1), *receptions])]),
    }
    asked = [(a, n, c, day, f"p{n}", f"N{n}", f"F{n}", q, p) for a, n, c, day, q, p in requests]
    from decimal import Decimal

    money = lambda x: None if x is None else Decimal(str(x))
    return procurement.run_batch(frames, spark.createDataFrame([(*r[:7], money(r[7]), money(r[8])) for r in asked], REQUEST))


def test_an_order_goes_through_all_stages_in_one_batch(spark, make):
    need, ok, order, got, stocked, no = (
        catalog.NEED, catalog.VALIDATED, catalog.ORDERED, catalog.RECEIVED, catalog.STOCKED, catalog.REJECTED)
    day = D(2024, 3, 1)
    found = batch(spark, make, [{"id": 1, "statut": need}, {"id": 2, "statut": ok}, {"id": 3, "statut": got, "quantite_recue": 4}, {"id": 4, "statut": no}], [
        (1, 4, stocked, day, 6.5, 9), (1, 1, ok, day, None, None), (1, 3, got, day, None, None), (1, 2, order, day, None, None),
        (1, 5, ok, day, None, None), (2, 6, stocked, day, None, None), (2, 7, order, D(2024, 2, 1), None, None), (2, 8, no, day, None, None),
        (3, 9, stocked, day, None, None), (3, 10, stocked, day, 1, 1), (4, 11, ok, day, None, None), (77, 12, ok, day, None, None)],
        receptions=[(1, 2), (1, 3)])
    orders = {r.id: r for r in found.orders.collect()}
    assert [orders[k].statut for k in (1, 2, 3, 4)] == [stocked, order, stocked, no]
    one = orders[1]
    assert (one.validateur_cc, one.numero_bc, one.fournisseur, float(one.quantite_recue)) == ("p1", "N2", "F2", 5.0)
    assert (float(one.quantite_mise_stock), float(one.prix_unitaire_reel), one.date_mise_stock) == (6.5, 9.0, day)
    assert (float(orders[3].quantite_mise_stock), float(orders[3].prix_unitaire_reel)) == (4.0, 3.0)
    taken = sorted((r.appro_id, r.rang, r.numero, r.ancien_statut) for r in found.taken.collect())
    assert taken == [(1, 1, 1, need), (1, 2, 2, ok), (1, 3, 3, order), (1, 4, 4, got), (2, 1, 7, ok), (3, 1, 9, got)]
    refused = sorted((r.appro_id, r.numero, r.ancien_statut, r.motif_refus) for r in found.refused.collect())
    assert refused == [(1, 5, stocked, "interdit"), (2, 6, order, "interdit"), (2, 8, order, "interdit"), (3, 10, stocked, "interdit"),
                       (4, 11, no, "interdit"), (77, 12, None, "inconnu")]
    entries = sorted((r.appro_id, float(r.quantite), float(r.prix_unitaire), r.date_mvt) for r in found.entries.collect())
    assert entries == [(1, 6.5, 9.0, day), (3, 4.0, 3.0, day)]


def test_nothing_received_stocks_one_and_no_material_no_entry(spark, make):
    day = D(2024, 3, 1)
    orders = [{"id": 1, "statut": catalog.ORDERED}, {"id": 2, "statut": catalog.RECEIVED, "materiau_id": None, "quantite_recue": 7}]
    found = batch(spark, make, orders, [(1, 1, catalog.RECEIVED, day, None, None), (1, 2, catalog.STOCKED, day, None, None), (2, 3, catalog.STOCKED, day, None, None)])
    assert sorted((r.id, float(r.quantite_mise_stock)) for r in found.orders.collect()) == [(1, 1.0), (2, 7.0)]
    assert [r.appro_id for r in found.entries.collect()] == [1]


def test_many_requests_of_one_order(spark, make):
    """A hot order: thousands of requests, four of which are taken."""
    day = D(2024, 3, 1)
    stages = [catalog.STOCKED, catalog.RECEIVED, catalog.ORDERED, catalog.VALIDATED]
    found = batch(spark, make, [{"id": 1, "statut": catalog.NEED}], [(1, n, stages[n % 4], day, None, None) for n in range(4000)])
    assert [r.numero for r in sorted(found.taken.collect(), key=lambda r: r.rang)] == [3, 6, 9, 12]
    assert found.refused.count() == 3996


@pytest.mark.parametrize("job", [
    lambda t: subcontract.statement(t, site=3), lambda t: subcontract.account(t, site=3), lambda t: reports.subcontractors(t, site=3)])
def test_site_figures_choose_their_rows_before_they_sum(tables, job):
    """The semi-join lies below the sums of statements, quotes and payments."""
    plan = job(tables)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    semi = [k for k, line in enumerate(plan) if "LeftSemi" in line]
    sums = [k for k, line in enumerate(plan) if "Aggregate [" in line and "sum(" in line]
    assert semi and any(s < k for s in sums for k in semi)


def test_each_sheet_is_computed_once(spark, tmp_path):
    """A job per sheet that has rows; the list of sheets is written last."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = spark.range(100).mapInArrow(count, "id long")
    sinks.export({"a": counted, "b": counted.filter("id < 0")}, f"file://{tmp_path}/out")
    assert seen.value == 200
    listed = spark.read.parquet(f"file://{tmp_path}/out/{sinks.LISTING}")
    assert sorted(map(tuple, listed.collect())) == [("a", 100), ("b", 0)]
    with pytest.raises(ValueError):
        sinks.export({}, str(tmp_path), mode="ignore")


def test_simple_sheets_are_chosen_by_content(tables):
    from earthworks import registry

    up = registry._upload(tables)
    files = {r.file_id for r in ingest.simple_files(up.cells, up.files, tables["livrables"], up.columns).collect()}
    assert files == (set(range(25)) - {7, 8}) | {50}
    assert facts.statements_by_line(tables).count() >= facts.statements_by_line(tables, tables["devis_st"].filter("rue_id = 3")).count() > 0
