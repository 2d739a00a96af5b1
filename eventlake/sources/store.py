"""Tables by name over Parquet files, a catalog or JDBC.

A Parquet table is a folder of data files that never change, and manifests that each list the files of one
state of the table; the one-line ``current.txt`` names the manifest that readers see. A change writes its
new files beside the old ones, then a manifest, and switches ``current.txt`` last, by a rename: a reader sees
the old state or the new one, and a writer that dies before the switch has changed nothing.

Files lie in cells: a date, or one of a fixed number of key hashes, so that folders do not grow with tenants. A keyed
change opens the files of the cells of its keys, finds those that hold one of them by a scan of the key columns, and
rewrites these files alone. One writer per table at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators import merge
from eventlake.operators.ordering import last_per_key
from eventlake.schemas import TABLES, TableSpec
from eventlake.session import discard, pinned

POINTER = "current.txt"
STREAM = "stream "  # a manifest line that names the last batch of a stream


def model_schema(custom: str | None, default: str) -> str:
    """Schema name of a model: its own if it names one, else the default."""
    return default if custom is None else custom.strip()


class TableStore:
    def __init__(self, spark: SparkSession, root: str, catalogs: dict[str, str] | None = None, jdbc: dict[str, dict] | None = None):
        """``catalogs`` maps a name prefix to a catalog schema, ``jdbc`` to reader options."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.catalogs = catalogs or {}
        self.jdbc = jdbc or {}

    def scan(self, qualified: str) -> DataFrame:
        """``prefix.table`` from a catalog schema or a JDBC source, plain names from Parquet."""
        prefix, _, table = qualified.rpartition(".")
        if prefix in self.catalogs:
            return self.spark.read.table(f"{self.catalogs[prefix]}.{table}")
        if prefix in self.jdbc:
            return self.spark.read.format("jdbc").options(dbtable=table, **self.jdbc[prefix]).load()
        return self.read(qualified)

    def spec(self, name: str) -> TableSpec:
        return TABLES[name]

    # files, manifests and the pointer

    def _hadoop(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()

    def _file_system(self, path: str):
        fs, conf = self._hadoop()
        target = fs.Path(path)
        return target.getFileSystem(conf), target

    def _text(self, path: str) -> list[str]:
        files, target = self._file_system(path)
        stream = files.open(target)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()

    def _put(self, path: str, lines: Iterable[str]) -> None:
        files, target = self._file_system(path)
        stream = files.create(target, True)
        try:
            stream.write(bytearray("\n".join(lines), "utf-8"))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        files, path = self._file_system(f"{self.root}/{name}/{POINTER}")
        return files.exists(path)

    def _manifest(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        (manifest,) = self._text(f"{self.root}/{name}/{POINTER}")
        return self._text(f"{self.root}/{name}/{manifest}")

    def files(self, name: str, cells: Iterable[str] | None = None) -> list[str]:
        """Current data files as ``version/cell=value/file``; of the given cells, if any are named."""
        listed = [line for line in self._manifest(name) if not line.startswith(STREAM)]
        if cells is None:
            return listed
        folders = {f"cell={cell}" for cell in cells}
        return [file for file in listed if file.split("/")[1] in folders]

    def _batches(self, name: str) -> dict[str, int]:
        """Last batch that each stream has added."""
        lines = [line.removeprefix(STREAM).rpartition(" ") for line in self._manifest(name) if line.startswith(STREAM)]
        return {stream: int(number) for stream, _, number in lines}

    def _publish(self, name: str, files: list[str], batches: dict[str, int] | None = None) -> None:
        """Write the manifest of a new state, then make it the one that readers see."""
        manifest = f"manifest-{uuid.uuid4().hex}.txt"
        streams = self._batches(name) | (batches or {})
        self._put(f"{self.root}/{name}/{manifest}", [*files, *[f"{STREAM}{stream} {number}" for stream, number in streams.items()]])
        self._switch(name, manifest)

    def _switch(self, name: str, manifest: str) -> None:
        pointer = f"{self.root}/{name}/{POINTER}"
        beside = f"{pointer}-{uuid.uuid4().hex}"
        self._put(beside, [manifest])
        fs, conf = self._hadoop()
        overwrite = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        overwrite[0] = fs.Options.Rename.OVERWRITE
        files, source = self._file_system(beside)
        source, target = files.makeQualified(source), files.makeQualified(fs.Path(pointer))
        fs.FileContext.getFileContext(source.toUri(), conf).rename(source, target, overwrite)

    def _written(self, name: str, df: DataFrame, version: str) -> list[str]:
        """Write rows as files of one version; their names."""
        spec = self.spec(name)
        folder = f"{self.root}/{name}/{version}"
        rows = df.select(*[F.col(field.name).cast(field.dataType) for field in spec.schema.fields])
        if spec.cell is None:
            if spec.order:
                rows = rows.sortWithinPartitions(*spec.order)
            rows.write.parquet(f"{folder}/cell=0")
        else:
            # adaptive execution splits a cell that holds much of the data
            placed = rows.withColumn("cell", F.expr(spec.cell)).hint("rebalance", "cell")
            placed.sortWithinPartitions("cell", *spec.order).write.partitionBy("cell").parquet(folder)
        files, target = self._file_system(folder)
        found, listing = [], files.listFiles(target, True)
        while listing.hasNext():
            path = listing.next().getPath()
            if path.getName().startswith("part-"):
                found.append(f"{version}/{path.getParent().getName()}/{path.getName()}")
        return sorted(found)

    def drop(self, name: str) -> None:
        """Forget the current state; its files stay until they are cleaned up."""
        files, path = self._file_system(f"{self.root}/{name}/{POINTER}")
        files.delete(path, False)

    def clean(self, name: str) -> int:
        """Delete data files that the current state does not list; for times without readers of older states."""
        listed = set(self.files(name))
        files, target = self._file_system(f"{self.root}/{name}")
        gone, listing = 0, files.listFiles(target, True)
        paths = []
        while listing.hasNext():
            paths.append(listing.next().getPath())
        for path in paths:
            own = "/".join(path.toString().split("/")[-3:])
            if path.getName().startswith("part-") and own not in listed:
                files.delete(path, False)
                gone += 1
        return gone

    def compact(self, name: str, most_files: int = 16) -> None:
        """Rewrite cells of more than ``most_files`` files, which appends leave, as few files."""
        per_cell: dict[str, list[str]] = {}
        for file in self.files(name):
            per_cell.setdefault(file.split("/")[1], []).append(file)
        many = [file for own in per_cell.values() if len(own) > most_files for file in own]
        if many:
            self._put_in_place(name, many, self._rows_of(name, many).repartition(max(1, len(many) // most_files)))

    # reads and whole-table writes

    def ensure(self, name: str) -> None:
        """Create the table, empty, if it is missing."""
        if not self.exists(name):
            self._publish(name, [])

    def read(self, name: str, cells: Iterable[str] | None = None) -> DataFrame:
        """The current rows; of the given cells, if any are named."""
        return self._rows_of(name, self.files(name, cells))

    def _rows_of(self, name: str, files: list[str]) -> DataFrame:
        schema = self.spec(name).schema
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{file}" for file in files])

    def columns(self, name: str) -> DataFrame:
        """Column catalogue of one stored table as it lies on disk."""
        files = self.files(name)
        fields = self.spark.read.parquet(f"{self.root}/{name}/{files[0]}").schema.fields if files else self.spec(name).schema.fields
        return self.spark.createDataFrame([(name, field.name, field.dataType.simpleString()) for field in fields], "table_name string, column_name string, data_type string")

    def append(self, name: str, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add rows. A stream names itself and its batch; the manifest that lists a batch's rows also records the batch, so
        one that was added is not added again, whatever has rewritten its rows since."""
        self.ensure(name)
        stream, number = batch or ("", 0)
        done = self._batches(name)
        if batch and number <= done.get(stream, -1):
            return
        fresh = self._written(name, df, f"add.{uuid.uuid4().hex}")
        self._publish(name, self.files(name) + fresh, {stream: number} if batch else None)

    def replace(self, name: str, df: DataFrame) -> None:
        """Write a new state of the whole table, then switch to it."""
        self._publish(name, self._written(name, df, f"all.{uuid.uuid4().hex}"))

    def _put_in_place(self, name: str, touched: list[str], changed: DataFrame) -> None:
        """Publish the changed rows in place of the touched files."""
        fresh = self._written(name, changed, f"change.{uuid.uuid4().hex}")
        gone = set(touched)
        self._publish(name, [file for file in self.files(name) if file not in gone] + fresh)

    # keyed changes

    def cells_of(self, name: str, rows: DataFrame) -> list[str] | None:
        """Cells of rows that have the columns the cell is made of: key hashes are few, dates as many as the rows name."""
        cell = self.spec(name).cell
        if cell is None:
            return None
        return [row["cell"] or "__HIVE_DEFAULT_PARTITION__" for row in rows.select(F.expr(cell).cast("string").alias("cell")).distinct().collect()]

    def _holding(self, name: str, keys: DataFrame, names: Sequence[str]) -> list[str]:
        """Files that hold one of the keys: of the cells of the keys, by a scan of the key columns alone."""
        candidates = self.files(name, self.cells_of(name, keys))
        if not candidates:
            return []
        placed = self._rows_of(name, candidates).select(*names, F.col("_metadata.file_path").alias("path"))
        return self._named(placed.join(keys.select(*names).distinct(), list(names), "left_semi"))

    def _named(self, rows: DataFrame) -> list[str]:
        last = F.array_join(F.slice(F.split("path", "/"), -3, 3), "/")
        return [row["file"] for row in rows.select(last.alias("file")).distinct().collect()]

    def upsert(self, name: str, source: DataFrame, update: Sequence[str], order: Sequence[Column | str] | None = None) -> None:
        """Insert new keys, set the ``update`` columns of known ones; with ``order`` the last of equal keys wins."""
        self.ensure(name)
        keys = list(self.spec(name).keys)
        given = pinned(source if order is None else last_per_key(source, keys, list(order)))
        touched = self._holding(name, given, keys)
        self._put_in_place(name, touched, merge.upsert(self._rows_of(name, touched), given, keys, update))
        discard(given)

    def insert_absent(self, name: str, source: DataFrame, order: Sequence[Column | str]) -> None:
        """Append the first in order of every key that the table lacks."""
        self.ensure(name)
        keys = list(self.spec(name).keys)
        given = pinned(source)
        self.append(name, merge.absent_rows(self.read(name, self.cells_of(name, given)), given, keys, order))
        discard(given)

    def update_matching(self, name: str, keys: DataFrame, values: dict[str, Column]) -> DataFrame:
        """Set values on matching keys; returns the keys without a match."""
        self.ensure(name)
        names = list(self.spec(name).keys)
        given = pinned(keys)
        touched = self._holding(name, given, names)
        changed, missed = merge.update_matching(self._rows_of(name, touched), given, names, values)
        missed = pinned(missed)
        if touched:
            self._put_in_place(name, touched, changed)
        discard(given)
        return missed

    def replace_children(self, name: str, parents: DataFrame, children: DataFrame, parent_keys: Sequence[str]) -> None:
        """Replace all child rows of the given parents. A child lies in the cell of its parent."""
        self.ensure(name)
        given = pinned(parents)
        touched = self._holding(name, given, parent_keys)
        self._put_in_place(name, touched, merge.replace_children(self._rows_of(name, touched), given, children, parent_keys))
        discard(given)

    def reload_tenant(self, name: str, tenant: str, rows: DataFrame) -> None:
        """Delete all rows of one tenant and load the given ones."""
        self.reload_where(name, F.col("environment").eqNullSafe(F.lit(tenant)), rows)

    def reload_where(self, name: str, condition: Column, rows: DataFrame, cells: Iterable[str] | None = None) -> None:
        """Put the given rows that meet a condition in place of the stored ones that do; ``cells`` are all that can hold such rows."""
        self.ensure(name)
        candidates = self.files(name, cells)
        touched = self._named(self._rows_of(name, candidates).where(condition).select(F.col("_metadata.file_path").alias("path"))) if candidates else []
        kept = self._rows_of(name, touched).where(~F.coalesce(condition, F.lit(False)))
        self._put_in_place(name, touched, kept.unionByName(rows.where(condition).select(*kept.columns)))
