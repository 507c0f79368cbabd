"""A keyed table in versions: point lookups, upserts, deletes, pinned readers, compaction (SRC-09, SRC-11, STM-06).

Rows are written sorted into files that are never changed. A version is a manifest: a table of its files with the range
of keys and the version that added each, some of them tombstones. A newer file's row of a key stands for older ones. A
reader holds one version's files, whatever is written later. A lookup opens the files whose range may hold its keys; within
those Parquet's Bloom filters and statistics say which parts to read. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import remove
from .ledger import _path

#: Keys of one point lookup, which are sent to the readers as a list.
MOST_KEYS = 10_000
#: Bytes of values for each file: a larger table is written in more files than were asked for.
FILE_BYTES = 64 << 20
_MANIFEST = "file string, low string, high string, n long, added long, tombstone boolean"


def _ordered(key):
    """Keys as text whose order is theirs: whole numbers as hexadecimal digits with the sign turned."""
    return F.lpad(F.hex(F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _bytes(rows: DataFrame) -> int:
    """About what the rows' values take, read once."""
    each = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in rows.schema]
    return rows.agg(F.sum(reduce(Column.__add__, (c.cast("long") for c in each)))).first()[0] or 0


class Versions:
    """The table in the folder ``path``, whose rows have a whole-number ``key``; null keys are refused."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def current(self) -> int:
        """The newest finished version, 0 for none."""
        fs, where = _path(self.spark, f"{self.path}/manifest")
        if not fs.exists(where):
            return 0
        done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(where) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={version:020d}") if version else self.spark.createDataFrame([], _MANIFEST)

    def _written(self, rows: DataFrame, version: int, tombstone: bool, files: int | None, size: int = 0) -> DataFrame:
        """Files of rows by ranges of keys, as rows of a manifest: only the keys are read back. There are ``files`` of them, more
        where ``size`` bytes are too many for those, so that what a task reads does not grow with the table."""
        files = files and max(files, -(-size // FILE_BYTES))
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        ranged = rows.repartitionByRange(files, self.key) if files else rows.repartitionByRange(self.key)
        ranged.sortWithinPartitions(self.key).write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(folder)
        keys = self.spark.read.parquet(folder).select(_ordered(self.key).alias("k"), F.input_file_name().alias("file"))
        return keys.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n")).withColumns({"added": F.lit(version).cast("long"), "tombstone": F.lit(tombstone)})

    def _commit(self, entries: DataFrame, version: int) -> int:
        entries.select("file", "low", "high", "n", "added", "tombstone").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version:020d}")
        return version

    def upsert(self, rows: DataFrame, files: int | None = None) -> int:
        """A new version in which rows replace those of their keys; of rows that repeat a key the last by all columns
        stands. Returns its number."""
        version = self.current() + 1
        checked = rows.withColumn(self.key, F.coalesce(self.key, F.raise_error(F.lit("a row has no key")).cast(rows.schema[self.key].dataType)))
        one = checked.withColumn("_n", F.row_number().over(W.partitionBy(self.key).orderBy(*(F.desc(c) for c in rows.columns if c != self.key), self.key))).where("_n = 1").drop("_n")
        return self._commit(self.manifest().unionByName(self._written(one, version, False, files, _bytes(rows) if files else 0)), version)

    def delete(self, keys: DataFrame, files: int | None = None) -> int:
        """A new version without the rows of these keys."""
        version = self.current() + 1
        gone = keys.select(self.key).where(F.col(self.key).isNotNull())
        return self._commit(self.manifest().unionByName(self._written(gone.distinct(), version, True, files, _bytes(gone) if files else 0)), version)

    def _live(self, entries: list) -> DataFrame | None:
        """The rows that stand among files: the newest of each key, none where that is a tombstone."""
        parts = []
        for added, tombstone in sorted({(e["added"], e["tombstone"]) for e in entries}):
            names = [e["file"] for e in entries if (e["added"], e["tombstone"]) == (added, tombstone)]
            parts.append(self.spark.read.parquet(*names).withColumns({"_added": F.lit(added), "_gone": F.lit(tombstone)}))
        if not parts or all(e["tombstone"] for e in entries):
            return None
        if len(parts) == 1:
            return parts[0].drop("_added", "_gone")
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p, allowMissingColumns=True)
        last = F.row_number().over(W.partitionBy(self.key).orderBy(F.desc("_added")))
        return both.withColumn("_n", last).where("_n = 1 AND NOT _gone").drop("_n", "_added", "_gone")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless told otherwise; later versions do not change what it reads."""
        entries = self.manifest(version).collect()  # a row a file
        live = self._live(entries)
        if live is None:
            raise ValueError("the version has no row")
        return live

    def files_for(self, keys: list[int], version: int | None = None) -> list:
        """The manifest's rows of the files whose range holds one of the keys."""
        if len(keys) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} keys: join read() instead")
        wanted = self.spark.createDataFrame([(k,) for k in keys], f"`{self.key}` long").select(_ordered(self.key).alias("k"))
        m = self.manifest(version)
        return m.join(F.broadcast(wanted), F.col("k").between(F.col("low"), F.col("high")), "left_semi").collect()

    def lookup(self, keys: list[int], version: int | None = None) -> DataFrame | None:
        """The rows of a list of keys (SRC-09), from as few files as their ranges allow; None where none is known."""
        live = self._live(self.files_for(keys, version))
        return None if live is None else live.where(F.col(self.key).isin(keys))

    def compact(self, files: int | None = None) -> int:
        """A new version with the same rows in files of its own: one row a key, no tombstones."""
        version = self.current() + 1
        live = self.read()
        names = [r["file"] for r in self.manifest().where("NOT tombstone").select("file").collect()]  # a row a file
        return self._commit(self._written(live, version, False, files, _bytes(self.spark.read.schema(live.schema).parquet(*names)) if files else 0), version)

    def vacuum(self, keep: int) -> int:
        """Delete files that no version from ``keep`` on reads, and older manifests; the number of folders that went."""
        fs, data = _path(self.spark, f"{self.path}/data")
        used = {f.rsplit("/", 2)[-2] for v in range(keep, self.current() + 1) for f in (r["file"] for r in self.manifest(v).select("file").collect())}
        gone = [s.getPath().toString() for s in fs.listStatus(data) if s.getPath().getName() not in used]
        gone += [f"{self.path}/manifest/v={v:020d}" for v in range(1, keep)]
        for path in gone:
            remove(self.spark, path)
        return len(gone)
