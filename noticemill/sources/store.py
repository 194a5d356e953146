"""Versioned state: the changes of one version are written first, a marker commits them.

A table is a list of folders: a base and the changes written since. The marker of a version, created last and in one step,
names the folders of all tables, so a job that dies before it leaves no trace for readers, and its rerun overwrites the same
version. Three kinds of tables:

* ``whole``: each version replaces it;
* ``rows``: new rows are added, none changes;
* ``keyed``: a row replaces an earlier one of its key. Readers take the latest row of each key (merge on read). A row with
  ``is_gone`` set, where the schema has it, removes its key.

A version so writes in proportion to its own changes. Files are cut into buckets of the key, and readers that know the keys
they want read only these buckets and rows. After ``compact_after`` changes the next version writes the table as a base again,
which costs each row that many times less.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticemill.session import broadcast_if_small

BUCKETS = 16
COMPACT_AFTER = 8
GONE = "is_gone"
#: Folder names of versions and buckets, which are columns to readers.
VERSION, BUCKET = "state_version", "state_bucket"


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    kind: str = "whole"
    keys: tuple[str, ...] = ()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class VersionedStore:
    """A set of tables with fixed schemas that move from version to version together."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table | T.StructType], buckets: int = BUCKETS,
                 compact_after: int = COMPACT_AFTER):
        self.spark, self.root, self.buckets, self.compact_after = spark, root.rstrip("/"), buckets, compact_after
        self.tables = {name: t if isinstance(t, Table) else Table(t) for name, t in tables.items()}
        self._staged: dict[int, dict[str, list[str]]] = {}

    # --- versions

    def _commits(self) -> str:
        return f"{self.root}/_commits"

    def committed(self) -> list[int]:
        fs, where = _fs(self.spark, self._commits())
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())

    def is_committed(self, version: int) -> bool:
        fs, where = _fs(self.spark, f"{self._commits()}/{version}")
        return fs.exists(where)

    def _folders(self, version: int) -> dict[str, list[str]]:
        """The folders of each table at a committed version; an empty marker stands for a base of every table."""
        fs, where = _fs(self.spark, f"{self._commits()}/{version}")
        stream = fs.open(where)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return json.loads(text) if text else {name: [f"{name}/{VERSION}={version}"] for name in self.tables}

    def folders(self, table: str) -> list[str]:
        versions = self.committed()
        return self._folders(versions[-1]).get(table, []) if versions else []

    def commit(self, version: int) -> None:
        """Make what was staged for the version visible; tables without changes stay as they were."""
        versions = self.committed()
        now = (self._folders(versions[-1]) if versions else {}) | self._staged.get(version, {})
        fs, draft = _fs(self.spark, f"{self._commits()}/_draft-{version}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(now, sort_keys=True).encode()))
        stream.close()
        fs, marker = _fs(self.spark, f"{self._commits()}/{version}")
        if not fs.rename(draft, marker):
            raise OSError(f"version {version} was committed by another job")
        self._staged.pop(version, None)

    def drop_before(self, keep: int = 2) -> None:
        """Remove the versions before the last ``keep`` committed ones, and the folders that none of these names."""
        versions = self.committed()
        live = {folder for version in versions[-keep:] for found in self._folders(version).values() for folder in found}
        dead = {folder for version in versions[:-keep] for found in self._folders(version).values() for folder in found} - live
        for path in [*dead, *(f"_commits/{version}" for version in versions[:-keep])]:
            fs, where = _fs(self.spark, f"{self.root}/{path}")
            fs.delete(where, True)

    # --- reading

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[table].keys), F.lit(self.buckets)).cast("int")

    def read(self, table: str, columns: list[str] | None = None, among: DataFrame | None = None) -> DataFrame:
        """The table at the last committed version; empty before the first one.

        Naming ``columns`` reads and merges only these; ``among`` (rows with the keys of a keyed table) only their buckets
        and rows. Older files may lack newer columns; the declared schema fills them with NULL.
        """
        spec = self.tables[table]
        wanted = columns or spec.schema.fieldNames()
        folders = self.folders(table)
        if not folders:
            return self.spark.createDataFrame([], spec.schema).select(*wanted)
        if spec.kind != "keyed":
            return self.spark.read.schema(spec.schema).parquet(*[f"{self.root}/{f}" for f in folders]).select(*wanted)
        gone = [GONE] if GONE in spec.schema.fieldNames() else []
        rest = [c for c in dict.fromkeys([*wanted, *gone]) if c not in spec.keys]
        rows = self._stored(spec.schema, folders)
        if among is not None:
            keys = among.select(*spec.keys).distinct()
            met = [r[0] for r in keys.select(self._bucket(table)).distinct().collect()]  # at most the number of buckets
            if len(met) < self.buckets:
                rows = rows.where(F.col(BUCKET).isin(met))
            rows = rows.join(broadcast_if_small(keys), list(spec.keys), "left_semi")
        if len(folders) > 1 or gone:
            rows = rows.groupBy(*spec.keys).agg(F.max_by(F.struct(*rest), VERSION).alias("_row")).select(*spec.keys, "_row.*")
        return (rows.where(~F.coalesce(GONE, F.lit(False))) if gone else rows).select(*wanted)

    def _stored(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        """The rows of a keyed table with their version and bucket, which the folders name."""
        found: DataFrame | None = None
        for top in dict.fromkeys(f.rsplit("/", 1)[0] for f in folders):
            rows = (self.spark.read.schema(T.StructType([*schema.fields, T.StructField(VERSION, T.LongType()), T.StructField(BUCKET, T.IntegerType())]))
                    .option("basePath", f"{self.root}/{top}").parquet(*[f"{self.root}/{f}" for f in folders if f.rsplit("/", 1)[0] == top]))
            found = rows if found is None else found.unionByName(rows)
        return found

    # --- writing

    def _write(self, version: int, table: str, rows: DataFrame, kind: str = "") -> str:
        spec, folder = self.tables[table], f"{table}{kind}/{VERSION}={version}"
        wanted = rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in spec.schema.fields])
        if spec.kind == "keyed":
            # a bucket goes to several tasks where there are more tasks than buckets
            spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
            wanted = wanted.withColumn(BUCKET, self._bucket(table))
            wanted = wanted.repartition(F.col(BUCKET), F.pmod(F.hash(*spec.keys), F.lit(spread)))
            wanted.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        else:
            wanted.write.mode("overwrite").parquet(f"{self.root}/{folder}")
        return folder

    def stage(self, version: int, table: str, rows: DataFrame) -> DataFrame:
        """Write a whole table of a version that is not committed yet, and read it back."""
        folder = self._write(version, table, rows)
        self._staged.setdefault(version, {})[table] = [folder]
        return self.spark.read.schema(self.tables[table].schema).parquet(f"{self.root}/{folder}")

    def stage_changes(self, version: int, table: str, rows: DataFrame) -> DataFrame:
        """Write rows to add to a table (in a keyed one, to replace others; one row a key), and read them back.

        A table of many changes is written whole instead, as a new base.
        """
        spec, before = self.tables[table], self.folders(table)
        folder = self._write(version, table, rows)
        path, schema = f"{self.root}/{folder}", spec.schema
        changed = self.spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
        if len(before) < self.compact_after:
            self._staged.setdefault(version, {})[table] = [*before, folder]
            return changed
        held = self.read(table)
        if spec.kind == "keyed":
            held = held.join(broadcast_if_small(changed.select(*spec.keys)), list(spec.keys), "left_anti")
        live = changed.where(~F.coalesce(GONE, F.lit(False))) if GONE in schema.fieldNames() else changed
        base = self._write(version, table, held.unionByName(live), ".base")
        self._staged.setdefault(version, {})[table] = [base]
        return changed
