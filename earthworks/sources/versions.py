"""Stored versions of a warehouse: a change writes the months it touches and becomes visible all at once.

A version lists, for each month of each table, the writes that hold it. A change writes folders of its own and then puts the
list of the next version in place with one rename, which fails if another writer was there first. Whoever reads meanwhile, or
after a crash before the rename, has the version before; files of months that a change does not touch stay as they are.
Tables without an event date are one part; rows without a date are a part of their own.

Each write keeps, beside its data, a count and two sums of row hashes for every month and hash bucket of ids. They tell
which parts of two versions can differ, without reading the rows.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earthworks.operators import changes
from earthworks.operators.aggregates import append_levels
from earthworks.operators.lineage import together
from earthworks.sources import catalog
from earthworks.sources.tables import EVENT_DATES, MONTH, Tables, month_of

WRITE = "ecriture"
UNDATED_TABLE = "-"
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # fixed value: Spark's folder for a missing partition value
BUCKETS = 64
Change = Callable[[DataFrame], DataFrame]


class Part(NamedTuple):
    table: str
    month: str | None
    write: str


class Version(NamedTuple):
    number: int
    parts: tuple[Part, ...]

    def of(self, table: str) -> tuple[Part, ...]:
        return tuple(p for p in self.parts if p.table == table)


class Conflict(RuntimeError):
    """Another writer has put the next version in place first; read again and repeat the change."""


def month_key(table: str) -> Column:
    """The month that a row of a table is stored under."""
    event_date = EVENT_DATES.get(table)
    return F.lit(UNDATED_TABLE) if event_date is None else month_of(event_date)


class Store:
    """A warehouse folder with versions."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    # --- versions ---

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.directory}/versions")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder, fs = self._files()
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """The version of that number, by default the newest; version -1 has no parts."""
        known = self.numbers()
        if number is None:
            number = known[-1] if known else -1
        if number == -1:
            return Version(-1, ())
        if number not in known:
            raise KeyError(number)
        folder, fs = self._files()
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:08d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Version(number, tuple(Part(*p) for p in json.loads(text)))

    def _put(self, version: Version) -> None:
        """Write the list beside its place, then move it there; the move fails if the place is taken."""
        folder, fs = self._files()
        fs.mkdirs(folder)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        draft, place = hadoop.Path(folder, f".{uuid.uuid4().hex}"), hadoop.Path(folder, f"{version.number:08d}.json")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(version.parts).encode()))
        stream.close()
        context = hadoop.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, place, no_options)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if not fs.exists(place):
                raise
            raise Conflict(version.number) from error

    # --- reading ---

    def _data(self, table: str) -> str:
        return f"{self.directory}/data/{table}"

    def _rows(self, table: str, parts: Iterable[Part]) -> DataFrame:
        """The rows of some parts, with their month; only the folders of these parts are listed and read."""
        fields = catalog.schema(table).add(WRITE, "string").add(MONTH, "string")
        paths = [f"{self._data(table)}/{WRITE}={p.write}/{MONTH}={NO_MONTH if p.month is None else p.month}" for p in parts]
        if not paths:
            return self.spark.createDataFrame([], fields).drop(WRITE)
        return self.spark.read.schema(fields).option("basePath", self._data(table)).parquet(*paths).drop(WRITE)

    def of_write(self, table: str, write: str) -> DataFrame:
        """All rows of one write, with their month."""
        fields = catalog.schema(table).add(MONTH, "string")
        return self.spark.read.schema(fields).parquet(f"{self._data(table)}/{WRITE}={write}")

    def is_written(self, folder: str) -> bool:
        """Whether a folder of this store was written to its end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str, version: int | None = None, months: Iterable[str | None] | None = None) -> DataFrame:
        """A table at a version; ``months`` reads only these parts. A table without an event date has no month."""
        parts = self.version(version).of(table)
        wanted = parts if months is None else [p for p in parts if p.month in set(months)]
        rows = self._rows(table, wanted)
        return rows if table in EVENT_DATES else rows.drop(MONTH)

    def months(self, table: str, version: int | None = None) -> list[str | None]:
        """The months a table has rows in, oldest first, rows without a date before all."""
        return sorted({p.month for p in self.version(version).of(table)}, key=lambda m: m or "")

    def tables(self, version: int | None = None) -> Tables:
        """All tables of one version, lazily."""
        number = self.version(version).number
        names = sorted({p.table for p in self.version(number).parts})
        return Tables(self.spark, names, lambda name: self.read(name, number))

    # --- writing ---

    def _write(self, table: str, rows: DataFrame) -> list[Part]:
        """New files for rows; gives the parts they make. Nothing reads them before a version lists them."""
        write = uuid.uuid4().hex[:12]
        path = f"{self._data(table)}/{WRITE}={write}"
        plain = rows.select(*[c.name for c in catalog.columns(table)]).withColumn(MONTH, month_key(table))
        plain.hint("rebalance", MONTH).write.partitionBy(MONTH).parquet(path)
        written = self.spark.read.schema(catalog.schema(table).add(MONTH, "string")).parquet(path)
        self._sum(table, written).write.parquet(self._sums_folder(table, write))
        months = self._sums(table, [write]).select(MONTH).distinct().collect()  # one row a month
        return [Part(table, r[MONTH], write) for r in months]

    def _sums_folder(self, table: str, write: str) -> str:
        return f"{self.directory}/sums/{table}/{WRITE}={write}"

    def _sums(self, table: str, writes: Iterable[str]) -> DataFrame:
        fields = f"{MONTH} string, tranche int, n bigint, s1 decimal(38,0), s2 decimal(38,0), {WRITE} string"
        paths = [self._sums_folder(table, w) for w in writes]
        return self.spark.read.schema(fields).option("basePath", f"{self.directory}/sums/{table}").parquet(*paths)

    @staticmethod
    def _sum(table: str, rows: DataFrame) -> DataFrame:
        names = [c.name for c in catalog.columns(table)]
        # a hash passes over a missing value, so where values are missing is hashed too
        missing = F.array(*[F.col(c).isNull() for c in names])
        wide = lambda c: F.sum(c.cast("decimal(38,0)"))
        return rows.groupBy(MONTH, bucket_of("id").alias("tranche")).agg(
            F.count(F.lit(1)).alias("n"), wide(F.xxhash64(missing, *names)).alias("s1"),
            wide(F.xxhash64(F.lit(1), missing, *names)).alias("s2"))

    def create(self, tables: Mapping[str, DataFrame]) -> int:
        """The first version, or one more with these tables anew; the others stay."""
        base = self.version()
        parts = [p for written in together(lambda item: self._write(*item), tables.items()) for p in written]
        return self._commit(base, [p for p in base.parts if p.table not in tables] + parts)

    def _commit(self, base: Version, parts: list[Part]) -> int:
        following = Version(base.number + 1, tuple(sorted(parts, key=lambda p: (p.table, p.month or "", p.write))))
        self._put(following)
        return following.number

    def change(self, edits: Mapping[str, tuple[Change, DataFrame]]) -> int:
        """Rewrite parts of tables, all in one version.

        Each table has the change, a function from its old rows to its new ones, and the months it touches (one column
        ``mois``). The change sees and gives only rows of these months.
        """
        base = self.version()

        def rewritten(item: tuple[str, tuple[Change, DataFrame]]) -> tuple[list[Part], list[Part]]:
            table, (edit, touched) = item
            months = {r[0] for r in touched.select(MONTH).distinct().collect()}  # few by nature
            old = [p for p in base.of(table) if p.month in months]
            new = self._write(table, edit(self._rows(table, old))) if months else []
            if beyond := {p.month for p in new} - months:
                raise ValueError(f"{table}: new rows in months that are not among the touched ones: {sorted(map(str, beyond))}")
            return old, new

        parts = set(base.parts)
        for old, new in together(rewritten, edits.items()):
            parts = parts - set(old) | set(new)
        return self._commit(base, list(parts))

    # --- the changes of operators.changes, stored ---

    def _touched(self, table: str, base: DataFrame, keys: DataFrame, key: Iterable[str], new: DataFrame | None = None) -> DataFrame:
        """Months of the rows that have one of the keys, and of the new rows."""
        key = list(key)
        months = month_key(table).alias(MONTH)
        hit = changes.with_key(base, keys, key).select(months)
        return hit if new is None else hit.union(new.select(months))

    def append(self, table: str, new: DataFrame, order: str) -> int:
        """Add rows with defaults and following ids. Only the new rows are written; a month may have several writes."""
        base = self.version()
        added = self._write(table, changes.append_rows(self.read(table, base.number), new, table, order, keep_base=False))
        return self._commit(base, [*base.parts, *added])

    def upsert(self, table: str, rows: DataFrame, key: list[str], order: str) -> int:
        base = self.read(table)
        touched = self._touched(table, base, rows, key, rows)
        return self.change({table: (lambda old: changes.upsert_rows(old, rows, key, order), touched)})

    def replace(self, table: str, new: DataFrame, key: list[str], slices: DataFrame | None = None) -> int:
        touched = self._touched(table, self.read(table), new if slices is None else slices, key, new)
        return self.change({table: (lambda old: changes.replace_slice(old, new, key, slices), touched)})

    def update(self, table: str, asked: DataFrame, columns: list[str], order: str | None = None) -> int:
        """Set columns by id. Where a new event date moves a row, its new month is rewritten too."""
        base = self.read(table)
        event_date = EVENT_DATES.get(table)
        moved = asked.select(month_key(table).alias(MONTH)) if event_date in columns else None
        touched = self._touched(table, base, asked, ["id"])
        touched = touched if moved is None else touched.union(moved)
        return self.change({table: (lambda old: changes.update_rows(old.drop(MONTH), asked, columns, order=order), touched)})

    def delete_sites(self, site_ids: DataFrame) -> int:
        """Sites with all that hangs on them, in one version over all tables."""
        tables = self.tables()
        gone = changes.cascade_ids(tables, site_ids)
        edits = {
            name: (lambda old, name=name: changes.cascade_rest(name, old.drop(MONTH), gone),
                   changes.cascade_hit(name, tables[name], gone).select(month_key(name).alias(MONTH)))
            for name in changes.cascade_order(tables)
        }
        return self.change(edits)

    # --- differences ---

    def differing(self, table: str, old: int, new: int) -> tuple[list[Part], list[Part], DataFrame]:
        """Parts that only one of two versions has, and the (month, bucket) pairs whose rows differ between them."""
        before, after = self.version(old).of(table), self.version(new).of(table)
        gone, come = [p for p in before if p not in after], [p for p in after if p not in before]
        sides = [(p.month, p.write, sign) for parts, sign in ((gone, -1), (come, 1)) for p in parts]
        if not sides:
            return [], [], self.spark.createDataFrame([], f"{MONTH} string, tranche int")
        signs = self.spark.createDataFrame(sides, "__m string, __w string, __sign int")
        sums = self._sums(table, sorted({p.write for p in (*gone, *come)}))
        met = sums.join(F.broadcast(signs), F.col(MONTH).eqNullSafe(F.col("__m")) & (F.col(WRITE) == F.col("__w")))  # a row a part
        figures = [F.sum(F.col(c) * F.col("__sign")).alias(c) for c in ("n", "s1", "s2")]
        unlike = met.groupBy(MONTH, "tranche").agg(*figures).where("n != 0 OR s1 != 0 OR s2 != 0")
        return gone, come, unlike.select(MONTH, "tranche")

    def change_log(self, table: str, old: int, new: int, at: dt.datetime) -> DataFrame:
        """What ``audit_diff`` says of two versions. Months with the same writes are not read, and of the others only rows in
        buckets whose sums differ are compared."""
        gone, come, unlike = self.differing(table, old, new)
        pairs = unlike.select(F.col(MONTH).alias("__m"), F.col("tranche").alias("__t"))

        def suspect(parts: list[Part]) -> DataFrame:
            rows = self._rows(table, parts)
            same = F.col(MONTH).eqNullSafe(F.col("__m")) & (bucket_of("id") == F.col("__t"))
            # at most a row per month and bucket
            return rows.join(F.broadcast(pairs), same, "left_semi").drop(MONTH)

        return changes.audit_diff(suspect(gone), suspect(come), table, at)


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def counts(store: Store, numbers: Iterable[int]) -> DataFrame:
    """Rows, smallest and largest id of every table at some versions."""
    rows = []
    for number in numbers:
        tables = store.tables(number)
        rows += [df.agg(F.lit(number).alias("version"), F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
                        F.min("id").alias("premier_id"), F.max("id").alias("dernier_id")) for name, df in tables.items()]
    return append_levels(*rows)
