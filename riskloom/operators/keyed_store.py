"""Keyed tables: bucketed Parquet with published versions.

A keyed table is an ordinary Spark table, partitioned by ``piece`` and bucketed by
its key, under a folder of the caller's choice:

    <root>/data/piece=<batch>.<bucket>/...   rows, one bucket of one batch
    <root>/manifest/v<version>.json          pieces that make up a version
    <root>/spec.json                         columns, key, number of buckets

* Joins and aggregates by the key read the buckets as they lie: only the other
  side of a join moves, and the table has no exchange.
* A batch reads no more buckets than its keys fall into, and of these no more
  columns than it needs.
* A batch becomes visible by the manifest, which is renamed into place and never
  replaced: readers see all of a batch or nothing, a writer that lost a race gets
  ``ConcurrentWrite``, and what a failed batch left behind is never read.
* A manifest carries the last batch of every stream that wrote to the table, so a
  batch that is replayed after a failure is known and changes nothing.
* ``append`` writes the batch alone.  ``compact`` folds buckets that have gathered
  many pieces, ``replace`` rewrites the given buckets (copy on write), and
  ``vacuum`` removes pieces that recent versions do not name.

The number of buckets is fixed when a table is made; choose it so that a bucket's
key column fits a task at the size the table is to reach, and no smaller than
``spark.sql.shuffle.partitions``, below which Spark would rather deal both sides
of a join anew.  A rename must fail if
its target exists, as on HDFS and local disks; on object stores that lack this,
keep to one writer.  The vacuum is for the writer: a reader has as many
versions' time as are kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, path_exists

#: Buckets of a new table at the least; as many as shuffle partitions if these are more.
LEAST_BUCKETS = 64
#: Pieces of a bucket from which ``compact`` folds it.
MOST_PIECES = 8
#: Keys that go into a scan as a filter.
MOST_LITERALS = 1000


class ConcurrentWrite(RuntimeError):
    """Another writer published the version that this batch was built on."""


class KeyedTable:
    """A keyed table at ``root``; see the module's text."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spec = json.loads(self._text(f"{self.root}/spec.json"))
        self.key: str = spec["key"]
        self.buckets: int = spec["buckets"]
        self.schema = T.StructType.fromJson(spec["schema"])
        self.columns = self.schema.names
        self.name = "keyed_" + hashlib.md5(self.root.encode()).hexdigest()[:20]
        self._seen = -1
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({fields}, piece string) USING parquet PARTITIONED BY (piece) "
                  f"OPTIONS ('parquet.bloom.filter.enabled#{self.key}' = 'true') CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{self.root}/data'")

    @classmethod
    def open(cls, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int | None = None) -> KeyedTable:
        """The table at ``root``, made if there is none; the key's column must be there."""
        root = root.rstrip("/")
        if not path_exists(spark, f"{root}/spec.json"):
            if key not in schema.names or "piece" in [n.lower() for n in schema.names]:
                raise ValueError(f"a keyed table needs its key {key} and no column named piece")
            buckets = buckets or max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
            spec = json.dumps({"key": key, "buckets": buckets, "schema": json.loads(schema.json())})
            cls._put(spark, f"{root}/spec.json", spec)
        return cls(spark, root)

    # ------------------------------------------------------------- versions

    def manifest(self, version: int | None = None) -> dict:
        """{version, rows, pieces: {bucket: [batch, ...]}, streams: {name: {id, batch, rows, added}}}."""
        version = self.version() if version is None else version
        if version < 0:
            return {"version": -1, "rows": 0, "pieces": {}, "streams": {}}
        return json.loads(self._text(f"{self.root}/manifest/v{version:012d}.json"))

    def version(self) -> int:
        return max(self._versions(), default=-1)

    def committed(self, stream: str | None, batch_id: int | None) -> bool:
        """Whether the batch of the stream is in the table already."""
        return stream is not None and self.manifest()["streams"].get(stream, {"id": -1})["id"] >= batch_id

    def _versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names(f"{self.root}/manifest", "v*.json")]

    def _publish(self, before: dict, pieces: dict[str, list[str]], change: int, stream: str | None, batch_id: int | None, batch: str | None = None) -> None:
        now = {"version": before["version"] + 1, "rows": before["rows"] + change, "pieces": {b: p for b, p in pieces.items() if p},
               "streams": dict(before["streams"])}
        if stream is not None:
            now["streams"][stream] = {"id": batch_id, "batch": batch, "rows": now["rows"], "added": change}
        self._put(self.spark, f"{self.root}/manifest/v{now['version']:012d}.json", json.dumps(now))

    # --------------------------------------------------------------- reading

    def bucket_of(self, key: Column | None = None) -> Column:
        """The bucket of a key, as Spark's own bucketing has it."""
        return F.pmod(F.hash(F.col(self.key) if key is None else key), F.lit(self.buckets))

    def read(self, buckets: list[int] | None = None, version: int | None = None, batch: str | None = None) -> DataFrame:
        """The rows of a version (the newest), of the given buckets or of one batch alone."""
        held = self.manifest(version)
        names = [f"{p}.{b}" for b, pieces in held["pieces"].items() if buckets is None or int(b) in buckets for p in pieces]
        if batch is not None:
            names = [n for n in names if n.split(".")[0] == batch]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        if held["version"] != self._seen:
            self._refresh()
            self._seen = held["version"]
        return self.spark.table(self.name).where(F.col("piece").isin(names)).select(*self.columns)

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets that the keys of ``rows`` fall into (at most one number per bucket)."""
        return [r[0] for r in rows.select(self.bucket_of().alias("b")).distinct().collect()]

    def matching(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Stored rows with a key of ``rows``: the buckets of these keys are read
        through, and ``rows``' keys alone are moved and held."""
        keys = rows.select(self.key).distinct()
        stored = self.read(self.buckets_of(keys))
        return stored.select(*(columns or self.columns)).join(keys.hint("shuffle_hash"), self.key, "left_semi")

    def lookup(self, keys: DataFrame, *columns: str, most: int = MOST_LITERALS) -> DataFrame:
        """Stored rows with a key of ``keys``.  Up to ``most`` different keys go
        into the scan as a filter: it opens the files of their buckets, and in these
        the row groups whose statistics and bloom filter admit a key.  More keys
        are joined (``matching``)."""
        few = [r[0] for r in keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().limit(most + 1).collect()]
        if len(few) > most:
            return self.matching(keys, *columns)
        wanted = sorted({r[0] for r in self.spark.createDataFrame([(k,) for k in few], T.StructType([self.schema[self.key]]))
                         .select(self.bucket_of()).collect()}) if few else []
        return self.read(wanted).where(F.col(self.key).isin(few)).select(*(columns or self.columns))

    # --------------------------------------------------------------- writing

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Rows as the pieces of a new batch: (batch, buckets written)."""
        batch = "b" + uuid.uuid4().hex[:16]
        cast = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema])
        cast.repartition(self.buckets, self.key).withColumn("piece", F.concat(F.lit(batch + "."), self.bucket_of().cast("string"))) \
            .write.insertInto(self.name)
        self._refresh()
        return batch, [int(n.rpartition(".")[2]) for n in self._names(f"{self.root}/data", f"piece={batch}.*")]

    def _count(self, names: list[str]) -> int:
        """Rows of the given pieces, from the files' footers."""
        return self.spark.table(self.name).where(F.col("piece").isin(names)).count() if names else 0

    def append(self, rows: DataFrame, stream: str | None = None, batch_id: int | None = None) -> str | None:
        """Add a batch; its name, or None if the stream's batch is there already."""
        if self.committed(stream, batch_id):
            return None
        before = self.manifest()
        batch, written = self._write(rows)
        pieces = {b: list(p) for b, p in before["pieces"].items()}
        for b in written:
            pieces.setdefault(str(b), []).append(batch)
        self._publish(before, pieces, self._count([f"{batch}.{b}" for b in written]), stream, batch_id, batch)
        return batch

    def replace(self, rows: DataFrame, buckets: list[int], stream: str | None = None, batch_id: int | None = None) -> None:
        """``rows`` become all there is of the given buckets; other buckets keep their files."""
        if self.committed(stream, batch_id):
            return
        before = self.manifest()
        batch, written = self._write(rows)
        if not set(written) <= set(buckets):
            raise ValueError("rows fall into buckets that are not replaced")
        old = {b: p for b, p in before["pieces"].items() if int(b) in buckets}
        change = self._count([f"{batch}.{b}" for b in written]) - self._count([f"{p}.{b}" for b, own in old.items() for p in own])
        pieces = {b: list(p) for b, p in before["pieces"].items() if b not in old} | {str(b): [batch] for b in written}
        self._publish(before, pieces, change, stream, batch_id, batch)

    def compact(self, reduce: Callable[[DataFrame], DataFrame] | None = None, most: int = MOST_PIECES) -> list[int]:
        """Fold buckets with more than ``most`` pieces into one each; ``reduce`` may
        merge rows of one key.  The buckets that were folded."""
        full = [int(b) for b, p in self.manifest()["pieces"].items() if len(p) > most]
        if full:
            rows = self.read(full)
            self.replace(reduce(rows) if reduce else rows, full)
        return full

    def vacuum(self, keep: int = 2) -> int:
        """Remove pieces and manifests that the newest ``keep`` versions do not
        name; the number of pieces removed."""
        kept = sorted(self._versions())[-keep:]
        live = {f"{p}.{b}" for v in kept for b, pieces in self.manifest(v)["pieces"].items() for p in pieces}
        dead = [n for n in self._names(f"{self.root}/data", "piece=*") if n.removeprefix("piece=") not in live]
        fs = self._fs(self.spark, self.root)
        for n in dead:
            fs.delete(self._path(self.spark, f"{self.root}/data/{n}"), True)
        for v in set(self._versions()) - set(kept):
            fs.delete(self._path(self.spark, f"{self.root}/manifest/v{v:012d}.json"), False)
        if dead:
            self._refresh()
        return len(dead)

    # ----------------------------------------------------------------- files

    def _refresh(self) -> None:
        if self.spark.conf.get("spark.sql.catalogImplementation") == "hive":
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")  # pieces that other sessions wrote
        self.spark.catalog.refreshTable(self.name)

    @staticmethod
    def _path(spark: SparkSession, path: str):
        return spark._jvm.org.apache.hadoop.fs.Path(path)

    @classmethod
    def _fs(cls, spark: SparkSession, path: str):
        return cls._path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str, pattern: str) -> list[str]:
        found = self._fs(self.spark, folder).globStatus(self._path(self.spark, f"{folder}/{pattern}"))
        return [f.getPath().getName() for f in found or []]

    def _text(self, path: str) -> str:
        stream = self._fs(self.spark, path).open(self._path(self.spark, path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    @classmethod
    def _put(cls, spark: SparkSession, path: str, text: str) -> None:
        """A whole file or none: written aside, then renamed without overwriting."""
        jvm, aside = spark._jvm, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        fs = cls._fs(spark, path)
        stream = fs.create(cls._path(spark, aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(cls._path(spark, path)).toUri(), spark._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(cls._path(spark, aside)), fs.makeQualified(cls._path(spark, path)), options)
        except Exception as e:
            fs.delete(cls._path(spark, aside), False)
            if "FileAlreadyExistsException" in str(e):
                raise ConcurrentWrite(path) from None
            raise


# ------------------------------------------------------------------ first write


def insert_new(table: KeyedTable, rows: DataFrame, order: list[Column], stream: str | None = None, batch_id: int | None = None) -> DataFrame | None:
    """Append the first row per key, in ``order``, of those whose key is not
    stored yet; the rows added, or None if the stream's batch was there already.

    The batch is read twice, so it is written aside first; of the stored side the
    key column of the batch's buckets is read and nothing moved."""
    from .store import top_k_per_group

    if table.committed(stream, batch_id):
        return None
    first = materialize(top_k_per_group(rows.select(*table.columns), [table.key], order, 1), "incoming")
    known = table.matching(first, table.key)
    batch = table.append(first.join(known.hint("shuffle_hash"), table.key, "left_anti"), stream, batch_id)
    return table.read(batch=batch)


def winners(table: KeyedTable, rows: DataFrame, order: list[Column]) -> DataFrame:
    """Per key of ``rows`` the row that holds it after a save: the stored one,
    else the first of the batch."""
    from .store import top_k_per_group

    first = top_k_per_group(rows.select(*table.columns), [table.key], order, 1)
    stored = table.matching(first)
    mine = first.join(stored.select(table.key).hint("shuffle_hash"), table.key, "left_anti")
    return stored.unionByName(mine)


def delete_where(table: KeyedTable, gone: DataFrame, on: str, stream: str | None = None, batch_id: int | None = None) -> list[int]:
    """Delete the rows whose column ``on`` is in ``gone``; only buckets that hold
    such rows are rewritten.  The buckets."""
    if table.committed(stream, batch_id):
        return []
    gone = gone.select(on).distinct()
    buckets = table.buckets_of(table.read().select(*dict.fromkeys((table.key, on))).join(gone, on, "left_semi"))
    table.replace(table.read(buckets).join(gone, on, "left_anti"), buckets, stream, batch_id)
    return buckets


def update_where(table: KeyedTable, changed: DataFrame, on: str, stream: str | None = None, batch_id: int | None = None) -> list[int]:
    """Give rows whose column ``on`` is in ``changed`` (one row for each) that row's
    other columns; the key is no such column.  The buckets that were rewritten."""
    if table.key in changed.columns and table.key != on:
        raise ValueError("a row's key cannot be changed")
    if table.committed(stream, batch_id):
        return []
    news = [c for c in changed.columns if c != on]
    put = changed.select(on, F.struct(*news).alias("_new"))
    buckets = table.buckets_of(table.read().select(*dict.fromkeys((table.key, on))).join(put, on, "left_semi"))
    joined = table.read(buckets).join(put, on, "left")
    table.replace(joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in news else F.col(c)
                                  for c in table.columns]), buckets, stream, batch_id)
    return buckets
