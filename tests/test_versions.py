"""Stored versions: copy on write, one swap, reading old versions, differences without reading what is alike."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from earthworks.operators import changes
from earthworks.sources import catalog, versions
from earthworks.sources.tables import MONTH, with_defaults

AT = dt.datetime(2024, 2, 1, 8)


@pytest.fixture
def cash(tables):
    """Cash rows of seven years, some without a date."""
    return tables["caisse_chantier"].withColumn("date_op", F.when(F.col("id") % 97 != 0, F.col("date_op")))


@pytest.fixture
def store(spark, cash, tmp_path):
    made = versions.Store(spark, f"file://{tmp_path}/books")
    made.create({"caisse_chantier": cash})
    return made


def rows(df):
    return sorted(map(repr, df.drop(MONTH).collect()))


def files_of(store, number):
    return {p: p for p in store.read("caisse_chantier", number).inputFiles()}


def some_changes(cash, wanted):
    """Rows with another amount, and one in ten of them in another month."""
    moved = F.when(F.col("id") % 10 == 0, F.add_months("date_op", 1)).otherwise(F.col("date_op"))
    return cash.filter(wanted).withColumns({"montant": (F.col("montant") + 1).cast(catalog.MONEY), "date_op": moved})


def test_first_version_holds_every_row(store, cash):
    assert store.numbers() == [0] and rows(store.read("caisse_chantier")) == rows(cash)
    assert None in store.months("caisse_chantier") and len(store.months("caisse_chantier")) > 50


def test_upsert_writes_the_touched_months_only(store, cash):
    changed = some_changes(cash, "date_op BETWEEN DATE'1997-03-01' AND DATE'1997-04-30'")
    wanted = rows(changes.upsert_rows(cash, changed, ["id"], "id"))
    before = files_of(store, 0)
    assert store.upsert("caisse_chantier", changed, ["id"], "id") == 1
    assert rows(store.read("caisse_chantier")) == wanted and rows(store.read("caisse_chantier", 0)) == rows(cash)
    fresh = {p for p in files_of(store, 1) if p not in before}
    assert {p.split(f"{MONTH}=")[1].split("/")[0] for p in fresh} == {"1997-03", "1997-04", "1997-05"}
    assert len(before) - len(set(before) & set(files_of(store, 1))) == 3


def test_every_change_equals_its_operator(store, cash, spark):
    steps = []
    new = cash.filter("id % 50 = 3").select(F.col("id").alias("s"), "date_op", "type_op", "rubrique", "montant")
    steps.append((lambda: store.append("caisse_chantier", new, "s"), lambda t: changes.append_rows(t, new, "caisse_chantier", "s")))
    sites = spark.createDataFrame([(3,), (5,)], "rue_id long")
    fresh = some_changes(cash, "rue_id = 3 AND id % 4 = 1").withColumn("id", F.col("id") + 900000)
    steps.append((lambda: store.replace("caisse_chantier", fresh, ["rue_id"], sites),
                  lambda t: changes.replace_slice(t, fresh, ["rue_id"], sites)))
    asked = cash.filter("id % 31 = 0").select("id", F.lit(dt.date(1998, 8, 8)).alias("date_op"), F.lit("X").alias("rubrique"))
    steps.append((lambda: store.update("caisse_chantier", asked, ["date_op", "rubrique"]),
                  lambda t: changes.update_rows(t, asked, ["date_op", "rubrique"])))
    for number, (stored, plain) in enumerate(steps):
        wanted = rows(plain(store.read("caisse_chantier").drop(MONTH)))
        assert stored() == number + 1 and rows(store.read("caisse_chantier")) == wanted
    assert rows(store.read("caisse_chantier", 0)) == rows(cash)


def test_an_append_leaves_all_files(store, cash):
    new = cash.filter("id % 50 = 3").select(F.col("id").alias("s"), "date_op", "type_op", "rubrique", "montant")
    store.append("caisse_chantier", new, "s")
    assert set(files_of(store, 0)) < set(files_of(store, 1))


def test_crash_before_the_swap_leaves_the_old_version(store, cash, monkeypatch):
    changed = some_changes(cash, "id % 5 = 0")
    monkeypatch.setattr(versions.Store, "_put", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        store.upsert("caisse_chantier", changed, ["id"], "id")
    monkeypatch.undo()
    assert store.numbers() == [0] and rows(store.read("caisse_chantier")) == rows(cash)
    assert store.upsert("caisse_chantier", changed, ["id"], "id") == 1


def test_of_two_writers_one_wins(store):
    """Both begin at version 0; the second finds the place taken."""
    base = store.version()
    assert store._commit(base, list(base.parts)) == 1
    with pytest.raises(versions.Conflict):
        store._commit(base, [])
    assert store.version().parts == base.parts and store.numbers() == [0, 1]
    with ThreadPoolExecutor(8) as pool:
        base = store.version()

        def attempt(_):
            try:
                return store._commit(base, list(base.parts))
            except versions.Conflict:
                return None

        assert 2 in list(pool.map(attempt, range(8))) and store.numbers() == [0, 1, 2]


def test_rows_outside_the_touched_months_are_refused(store, cash, spark):
    touched = spark.createDataFrame([("1997-03",)], f"{MONTH} string")
    with pytest.raises(ValueError, match="touched"):
        store.change({"caisse_chantier": (lambda old: old.withColumn("date_op", F.add_months("date_op", 3)), touched)})
    assert store.numbers() == [0]


def test_change_log_equals_audit_diff(store, cash):
    new = cash.filter("id % 500 = 3").select(F.col("id").alias("s"), "date_op", "type_op", "rubrique", "montant")
    store.upsert("caisse_chantier", some_changes(cash, "id % 40 = 0 AND date_op < DATE'1995-01-01'"), ["id"], "id")
    store.append("caisse_chantier", new, "s")
    late = store.read("caisse_chantier").filter("id % 7 = 0 AND date_op > DATE'1998-06-01'").select(MONTH)
    store.change({"caisse_chantier": (lambda old: old.filter("id % 7 != 0"), late)})
    for a, b in ((0, 1), (1, 2), (0, 3), (3, 0), (2, 2)):
        wanted = changes.audit_diff(store.read("caisse_chantier", a), store.read("caisse_chantier", b), "caisse_chantier", AT)
        assert rows(store.change_log("caisse_chantier", a, b, AT)) == rows(wanted)


def test_change_log_reads_what_can_differ(store, cash):
    """One row of one month changes: of that month's rows one bucket is compared, no other month is read."""
    one = cash.filter("date_op BETWEEN DATE'1997-03-01' AND DATE'1997-03-31'").orderBy("id").limit(1)
    store.upsert("caisse_chantier", one.withColumn("montant", (F.col("montant") + 1).cast(catalog.MONEY)), ["id"], "id")
    gone, come, unlike = store.differing("caisse_chantier", 0, 1)
    assert {p.month for p in (*gone, *come)} == {"1997-03"} and unlike.count() == 1
    log = store.change_log("caisse_chantier", 0, 1, AT)
    read = {f.split(f"{MONTH}=")[1].split("/")[0] for f in log.inputFiles() if "/data/" in f}
    assert read == {"1997-03"} and log.count() == 1


def test_a_value_that_moves_to_another_column_counts(spark, tmp_path, make):
    store = versions.Store(spark, f"file://{tmp_path}/s")
    people = make("personnel", [{"id": 1, "nom": "A", "prenom": None}]).withColumns({"poste": F.lit("x"), "telephone": F.lit(None).cast("string")})
    store.create({"personnel": people})
    store.update("personnel", people.select("id", F.lit(None).cast("string").alias("poste"), F.lit("x").alias("telephone")), ["poste", "telephone"])
    assert [r.details for r in store.change_log("personnel", 0, 1, AT).collect()] == ["poste,telephone"]


def test_cascade_is_one_version_of_all_tables(spark, tables, tmp_path):
    names = ["rues", "livrables", "devis_rue", "materiels", "caisse_chantier", "incidents", "personnel", "pointage"]
    store = versions.Store(spark, f"file://{tmp_path}/s")
    store.create({n: tables[n] for n in names})
    finished = tables["rues"].filter("statut_chantier = 'Terminé'").select("id")
    wanted = changes.cascade_delete({n: tables[n] for n in names}, finished)
    assert store.delete_sites(finished) == 1
    now, then = store.tables(1), store.tables(0)
    assert set(now) == set(names) == set(wanted)
    for name in names:
        assert rows(now[name]) == rows(wanted[name]) and rows(then[name]) == rows(tables[name])


def test_empty_tables_and_changes(spark, tables, tmp_path):
    store = versions.Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(KeyError):
        store.version(0)
    store.create({"incidents": tables["incidents"].limit(0), "rues": tables["rues"]})
    assert store.read("incidents").count() == 0
    store.upsert("incidents", tables["incidents"].limit(0), ["id"], "id")
    assert store.numbers() == [0, 1] and store.tables()["rues"].count() == tables["rues"].count()
    one = with_defaults(spark.createDataFrame([(1, None)], "id long, date_incident date"), "incidents")
    store.upsert("incidents", one, ["id"], "id")
    assert store.read("incidents").count() == 1 and store.months("incidents") == [None]
