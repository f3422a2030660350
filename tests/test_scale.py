"""Hot keys, storage layout and pushdown."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from earthworks.operators import changes, lineage, windows
from earthworks.plans import facts, ingest, records, reports
from earthworks.sources import sinks, tables as scans
from earthworks.sources.tables import load, open_warehouse, save

D = dt.date


@pytest.fixture
def skewed(spark):
    """Three quarters of the rows on one key, a third on one of its days, some keys and days missing."""
    df = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 4 < 3, 7).when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 5).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(D(2024, 1, 5)))
        .when(F.col("id") % 50 == 1, F.lit(None).cast("date"))
        .otherwise(F.date_add(F.lit(D(2024, 1, 1)), (F.col("id") * 7 % 11).cast("int"))).alias("d"),
        (F.col("id") * 13 % 17 - 8).cast("decimal(18,2)").alias("v"),
    )
    return df


def collected(df):
    return sorted(map(repr, df.collect()))


def loop_totals(rows, by, out="total"):
    """Running sums in Python, nulls first."""
    first = lambda x: (x is not None, x)
    sums, found = {}, []
    for r in sorted(rows, key=lambda r: (first(r.d), first(r.id))):
        key = tuple(r[k] for k in by)
        sums[key] = sums.get(key, 0) + r.v
        found.append((r.id, sums[key]))
    return sorted(found)


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("text", [False, True])
def test_running_totals_equal_a_loop(skewed, by, text):
    """Hot key, hot day, missing keys and days; ids as numbers or as texts that begin alike."""
    data = skewed.withColumn("id", F.concat(F.lit("LIGNE-2024-"), F.col("id").cast("string"))) if text else skewed
    got = windows.running_total(data, F.col("v"), by, ["d", "id"], "total")
    assert got.columns == [*data.columns, "total"]
    assert sorted((r.id, r.total) for r in got.collect()) == loop_totals(data.collect(), by)


@pytest.mark.parametrize("text", [False, True])
def test_parts_of_a_hot_key_are_of_like_size(spark, skewed, text):
    data = skewed.withColumn("id", F.concat(F.lit("LIGNE-2024-"), F.col("id").cast("string"))) if text else skewed
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # parts of so few rows would be merged into one
    spark.conf.set(merge, "false")
    try:
        parts = windows.dealt(data.repartition(4), ["k"], ["d", "id"]).groupBy("k", windows.PART).count()
        assert parts.agg(F.max("count")).first()[0] <= 2 * 3000 / 8
    finally:
        spark.conf.set(merge, "true")


def test_numbers_of_a_long_table(spark):
    ids = spark.range(500).select((F.col("id") * 37 % 1009).alias("id"))
    got = changes.number_rows(ids, "id", "n")
    assert [r.n for r in got.orderBy("id").collect()] == list(range(1, 501))


@pytest.mark.parametrize("by", [["k"], []])
def test_running_totals_shuffle_rows_once(spark, skewed, by):
    """Dealt rows meet the starts of their parts without a second shuffle, whatever the sizes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = explained(windows.running_total(skewed, F.col("v"), by, ["d", "id"], "total"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin LeftOuter" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_numbers_take_the_place_of_texts(spark):
    """Texts in their order with a missing one first; they are not kept, and rows that are numbered move no more."""
    texts = spark.range(500).select(F.when(F.col("id") != 77, F.format_string("L-%d", "id")).alias("id"), F.col("id").alias("was"))
    got = changes.number_rows(texts.repartition(7), "id", "id")
    wanted = sorted(range(500), key=lambda n: "" if n == 77 else f"L-{n}")
    assert got.columns == ["id", "was"] and [r.was for r in got.orderBy("id").collect()] == wanted
    assert sorted(r.id for r in got.collect()) == list(range(1, 501))
    assert "L-" not in str(spark.read.parquet(*got.inputFiles()).first())


def test_runs_cross_parts(spark):
    data = spark.range(2000).select(
        F.when(F.col("id") < 1500, 1).otherwise(2).alias("k"),
        F.when(F.col("id") > 0, F.col("id")).alias("p"),
        F.floor(F.col("id") / 90).cast("string").alias("l"),
    )
    got = sorted((r.k, -1 if r.p is None else r.p, r.l, r.run) for r in windows.sequential_runs(data, F.col("l"), "k", "p", "run").collect())
    run, last = 0, None
    for k, _, label, number in got:
        run = 1 if last is None or last[0] != k else run + (label != last[1])
        last = (k, label)
        assert number == run


@pytest.fixture
def dated(spark):
    """Ten rows a day of 30 days with one of seven keys, of which two are known, and one row without a date."""
    rows = [(k, D(2024, 1, 1) + dt.timedelta(days=k // 10), k % 7) for k in range(300)] + [(900, None, 1)]
    return rows, spark.createDataFrame(rows, "id long, d date, key long"), spark.createDataFrame([(1,), (2,)], "id long")


@pytest.mark.parametrize("k", [1, 5, 20, 60, 85, 86, 500])
def test_newest_rows_with_a_known_key(dated, k):
    rows, fact, dim = dated
    kept = [r.id for r in windows.newest_with_match(fact, dim, "key", "d", k).collect()]
    known = sorted(((r[1] or D.min, r[0]) for r in rows if r[2] in (1, 2)), reverse=True)[:k]
    assert {i for _, i in known} <= set(kept)
    assert len(kept) <= max(40, 10 * k)


def test_newest_rows_of_keys_that_are_mostly_unknown(spark):
    """The known rows are old: the walk goes on to them."""
    fact = spark.range(4000).select("id", F.date_sub(F.lit(D(2024, 1, 1)), (F.col("id") / 10).cast("int")).alias("d"),
                                    F.when(F.col("id") > 3000, 1).otherwise(9).alias("key"))
    kept = windows.newest_with_match(fact, spark.createDataFrame([(1,)], "id long"), "key", "d", 5)
    assert kept.filter("key = 1").count() >= 5


def test_repeated_changes_give_one_row_a_key(spark):
    base = spark.createDataFrame([(1, 10), (2, 20)], "id long, v long")
    asked = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (1, 9, 3), (None, 5, 4)], "id long, v long, o long")
    assert sorted(map(tuple, changes.update_rows(base, asked, ["v"], order="o").collect())) == [(1, 9), (2, 20)]
    assert sorted(map(tuple, changes.update_rows(base, asked, ["v"]).collect())) == [(1, 12), (2, 20)]
    assert sorted(map(tuple, changes.upsert_rows(base, asked.filter("id = 1"), ["id"], "o").collect())) == [(1, 9), (2, 20)]


def test_replaced_slices_are_cleared_without_new_rows(spark):
    base = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "id long, s long")
    got = changes.replace_slice(base, base.limit(0), ["s"], spark.createDataFrame([(2,)], "s long"))
    assert [r.id for r in got.collect()] == [1]


@pytest.mark.parametrize("job, fact", [("movement_totals", "quantite"), ("plant_totals", "heures_travail")])
def test_sums_come_before_the_join(tables, job, fact):
    from earthworks import registry

    plan = registry.JOBS[job](tables)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(k for k, line in enumerate(plan) if "Join" in line)
    assert any("Aggregate" in line for line in plan[join + 1 :])


def test_recap_totals_need_no_deliverables(tables):
    from earthworks.plans import market

    assert "Livrable" not in market.recap_totals(tables)._jdf.queryExecution().optimizedPlan().toString()


def test_like_sheet_names_keep_their_folders(spark, tmp_path):
    names = ["x" * 31 + "a", "x" * 31 + "b"]
    paths = sinks.export({n: spark.range(k + 1) for k, n in enumerate(names)}, str(tmp_path), mode="overwrite")
    assert [spark.read.parquet(p).count() for p in paths] == [1, 2]


def test_last_balance_is_the_cash_balance(tables):
    from earthworks.plans.dashboard import cash_totals

    running = records.cash_running(tables, per_site=False)
    last = running.orderBy(F.desc("date_op"), F.desc("id")).first().solde_cumule
    assert abs(float(last) - float(cash_totals(tables).first().solde)) <= 0.5


@pytest.fixture(scope="module")
def warehouse(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warehouse"))
    for name in ("caisse_chantier", "rues", "dossiers", "incidents", "pointage", "paiements_st", "audit_log", "materiaux",
                 "approvisionnements", "mouvements_materiaux"):
        df = tables[name]
        if name == "mouvements_materiaux":  # the fixture's ids are texts
            df = df.withColumn("id", F.xxhash64("id"))
        save(df, folder, name)
    return folder


def test_storage_keeps_every_row(spark, tables, warehouse):
    for name in ("caisse_chantier", "rues"):
        stored = load(spark, warehouse, name).select(tables[name].columns)
        assert collected(stored) == collected(tables[name])


def explained(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(spark, warehouse):
    stored = open_warehouse(spark, warehouse)
    plan = explained(reports.cash(stored, 3, D(1997, 1, 1), D(1997, 6, 30)).select("id", "montant"))
    assert "GreaterThanOrEqual(date_op,1997-01-01)" in plan and "EqualTo(rue_id,3)" in plan
    assert "(mois#" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert "beneficiaire" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_months_are_pruned(spark, warehouse):
    stored = open_warehouse(spark, warehouse)
    rows = records.cash_list(stored, month="1997-03", last_n=None)
    assert "1997-03" in explained(rows).split("PartitionFilters:")[1].split("\n")[0]
    assert rows.count() == 15
    recent = scans.recent(stored["caisse_chantier"], "caisse_chantier", D(2001, 8, 1), 30)
    assert recent.count() == stored["caisse_chantier"].filter("date_op >= DATE'2001-07-02'").count()


@pytest.mark.parametrize("job, month", [
    ("kpi_present", "2024-01"), ("filter_period", "2024-01"), ("filter_range", "1997-01"), ("param_scan", "1997-01"),
    ("audit_log_view", "2023-12"),
])
def test_jobs_of_a_period_prune_months(spark, warehouse, job, month):
    from earthworks import registry

    plan = explained(registry.JOBS[job](open_warehouse(spark, warehouse)))
    assert any(month in part.split("\n")[0] for part in plan.split("PartitionFilters:")[1:])


def scanned(df, column):
    """The least value that a pushed partition filter asks of a column, of each scan that has one."""
    return [part.split(f"{column}#")[2].split(">= ")[1].split(")")[0] for part in explained(df).split("PartitionFilters:")[1:]
            if ">= " in part.split("\n")[0] and f"{column}#" in part.split("\n")[0]]


def test_newest_lists_prune_months(spark, warehouse):
    """The list of the five newest movements reads the last month; that of one article goes back as far as it must."""
    from earthworks.plans import stock

    stored = open_warehouse(spark, warehouse)
    newest = stored["mouvements_materiaux"].agg(F.max("mois")).first()[0]
    rows = stock.movement_history(stored, last_n=5)
    assert scanned(rows, "mois") == [newest] and rows.count() == 5
    article = stock.movement_history(stored, article=7, last_n=5)
    whole = stored["mouvements_materiaux"].filter("materiau_id = 7").orderBy(F.desc("date_mvt"), F.desc("id")).limit(5)
    assert [r.id for r in article.collect()] == [r.id for r in whole.collect()]
    assert scanned(article, "mois") and scanned(article, "mois")[0] < newest


def test_newest_lists_of_a_version_read_its_last_months(spark, tables, tmp_path):
    """The folders of a stored version are walked in the same way, and the join sees the rows of the last months only."""
    from earthworks.plans import plant
    from earthworks.sources.versions import Store

    store = Store(spark, f"file://{tmp_path}/books")
    store.create({n: tables[n] for n in ("maintenance_materiels", "materiels")})
    months = store.months("maintenance_materiels")
    rows = plant.maintenance_history(store.tables(), k=3)
    assert scanned(rows, "mois")[0] in months[-8:] and len(months) > 50
    assert collected(rows) == collected(plant.maintenance_history(tables, k=3))


def test_a_site_sums_only_its_own_lines(tables):
    from earthworks.plans import market

    plan = market.work_statement(tables, site=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_stored_facts_can_be_changed(spark, warehouse, tables):
    base = load(spark, warehouse, "caisse_chantier")
    new = tables["caisse_chantier"].select(F.col("id").alias("s"), "date_op", "type_op", "rubrique", "montant")
    assert changes.append_rows(base, new, "caisse_chantier", "s").count() == 3000
    assert changes.audit_diff(base, tables["caisse_chantier"], "caisse_chantier", dt.datetime(2024, 1, 1)).isEmpty()


def test_facts_are_summed_before_the_shuffle(tables):
    plan = facts.executed_by_line(tables)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan


def test_report_reads_each_fact_once(tables):
    df = reports.progress(tables)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan")[0]
    assert plan.count("lineitem.parquet") == 1


def test_export_marks_empty_sheets(spark, tables, tmp_path):
    long_name = "x" * 40
    paths = sinks.export({"rows": tables["dossiers"], long_name: tables["dossiers"].filter("id < 0")}, str(tmp_path / "out"))
    assert spark.read.parquet(paths[0]).count() == 5
    assert paths[1].endswith("/" + "x" * 40)
    assert spark.read.parquet(paths[1]).first()[0] == sinks.NO_DATA


def test_csv_export_and_preview(spark, tables, tmp_path):
    path = sinks.export({"s": tables["dossiers"]}, str(tmp_path / "csv"), "csv", labels=True)[0]
    written = spark.read.option("header", True).csv(path)
    assert written.count() == 5 and "Nom" in written.columns
    head, n = sinks.preview(tables["dossiers"], 2)
    assert (head.count(), n) == (2, 5)


@pytest.mark.parametrize("sites_with_files", [3, 3000])
def test_letter_groups_are_not_broadcast(spark, sites_with_files):
    """Deliverables and their letter groups are exploded, which the planner's sizes don't show; neither passes the driver."""
    named = F.expr("explode(sequence(0, 4))").alias("k")
    deliverables = lineage.stable(spark.range(3000)).select(F.col("id").alias("s"), named).select(
        (F.col("s") * 5 + F.col("k")).alias("id"), F.col("s").alias("chantier_id"), F.format_string("Livrable %d", "k").alias("nom"))
    files = lineage.stable(spark.range(sites_with_files).select(F.col("id").alias("file_id"), F.col("id").alias("rue_id")))
    columns = files.select("file_id", F.lit(3).alias("col_idx"), F.lit(None).cast("string").alias("champ"), F.lit("livrable_2").alias("nom"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.maxBroadcastTableSize": "20m"}
    try:
        for key, value in limits.items():
            spark.conf.set(key, value)
        met = ingest.match_deliverables(columns, files, deliverables)
        got = met.agg(F.count(F.lit(1)), F.count_if(F.col("livrable_id") == F.col("rue_id") * 5 + 2)).first()
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert got[:] == (sites_with_files, sites_with_files)


def test_cells_are_not_broadcast(spark):
    """A sheet of many rows is a small file, which is far more in memory; only its few columns pass the driver."""
    head = F.when(F.col("id") == 0, F.element_at(F.array(*map(F.lit, ("Désignation", "Unité", "Livrable 0", "Livrable 1"))), F.col("c") + 1))
    body = F.when(F.col("c") == 0, "mur").when(F.col("c") == 1, "U").when(F.col("c") == 2, (F.col("id") % 2).cast("string")).otherwise("3")
    cells = lineage.stable(spark.range(100001).select("id", F.expr("explode(sequence(0, 3))").alias("c")).select(
        F.lit(0).alias("file_id"), F.col("id").cast("int").alias("row_idx"), F.col("c").alias("col_idx"), F.coalesce(head, body).alias("value")))
    files = spark.createDataFrame([(0, 7)], "file_id int, rue_id long")
    named = spark.createDataFrame([(35, 7, "Livrable 0"), (36, 7, "Livrable 1")], "id long, chantier_id long, nom string")
    try:
        spark.conf.set("spark.sql.maxBroadcastTableSize", "20m")
        multi = ingest.import_multi(cells, files, named)
        lines = multi.groupBy("livrable_id").agg(F.count(F.lit(1)), F.sum("quantite")).orderBy("livrable_id").collect()
        done = ingest.import_stats(multi).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert [(r[0], r[1], float(r[2])) for r in lines] == [(35, 50000, 50000.0), (36, 100000, 300000.0)]
    assert [tuple(r) for r in done] == [(0, 150000, 2)]


@pytest.mark.parametrize("sheets", [3, 80000])
def test_simple_imports_pass_few_rows_through_the_driver(spark, sheets):
    """Neither the deliverables of all sites nor the cells and columns of many small sheets are broadcast."""
    named = F.expr("explode(sequence(0, 4))").alias("k")
    deliverables = lineage.stable(spark.range(80000)).select(F.col("id").alias("s"), named).select(
        (F.col("s") * 5 + F.col("k")).alias("id"), F.col("s").alias("chantier_id"), F.format_string("Livrable %d", "k").alias("nom"))
    rows = spark.range(sheets).select(F.col("id").cast("int").alias("file_id"), F.expr("explode(sequence(0, 2))").alias("row_idx"))
    width = F.expr("explode(sequence(0, 2 + file_id % 2))").alias("col_idx")  # every second sheet has a deliverable
    heads, body = (F.element_at(F.array(*map(F.lit, words)), F.col("col_idx") + 1) for words in (
        ("Désignation", "Unité", "Qté", "Livrable 2"), ("mur", "U", "2", "3")))
    value = F.when(F.col("row_idx") == 0, heads).otherwise(body).alias("value")
    cells = lineage.stable(rows.select("file_id", "row_idx", width).select("file_id", "row_idx", "col_idx", value))
    files = lineage.stable(spark.range(sheets).select(F.col("id").cast("int").alias("file_id"), F.col("id").alias("rue_id")))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "4m", "spark.sql.maxBroadcastTableSize": "20m"}
    try:
        for key, size in limits.items():
            spark.conf.set(key, size)
        columns = ingest.layout(cells)
        simple = lineage.stable(ingest.simple_files(cells, files, deliverables, columns))
        by_site = ingest.import_simple(cells, files, deliverables, columns=columns)
        by_deliverable = ingest.import_simple(cells, simple.withColumn("livrable_id", F.col("rue_id") * 5), target="livrable")
        got = [lines.agg(F.count(F.lit(1)), F.sum("quantite"), F.max(F.col("file_id") % 2)).first() for lines in (by_site, by_deliverable)]
    finally:
        for key in limits:
            spark.conf.unset(key)
    even = (sheets + 1) // 2
    assert simple.count() == even
    assert [(r[0], float(r[1]), r[2]) for r in got] == [(2 * even, 4.0 * even, 0)] * 2


def test_kept_results_go_to_the_named_folder(spark):
    kept = lineage.stable(spark.range(5))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert kept.count() == 5 and folder in kept.inputFiles()[0]


def test_new_ids_follow_the_highest(tables):
    new = tables["caisse_chantier"].select(F.col("id").alias("s"), "date_op", "type_op", "rubrique", "montant")
    got = changes.append_rows(tables["caisse_chantier"], new, "caisse_chantier", "s")
    assert got.agg(F.max("id"), F.countDistinct("id")).first()[:] == (2999, 3000)
