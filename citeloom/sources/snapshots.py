"""Stored tables that change together: rows in buckets of their key, one manifest per version.

A change reads and rewrites only the buckets its rows fall into; all other files
stay as they are. Files of a change become visible when its manifest appears
under the next version number, for all tables at once. Renaming the manifest fails
where that version exists, so of two changes to one version the second is
refused and can be made again on the new one. A change that is given up, or whose
job dies, leaves the tables as they were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom.operators.merge import delete_by, insert_new, upsert
from citeloom.runtime import STORED_AS, written

BUCKETS = 64  # per table; a change lists at most so many on the driver
BUCKET = "_bucket"
DIGITS = 12  # of a version's file name
EXISTS = "org.apache.hadoop.fs.FileAlreadyExistsException"

Combine = Callable[[DataFrame, DataFrame], DataFrame]
Layout = dict[str, dict[str, str]]  # table, bucket: folder


class Conflict(RuntimeError):
    """Another change was committed to the version this one started from."""


@dataclass(frozen=True)
class Table:
    schema: StructType
    key: tuple[str, ...]
    order: tuple[str, ...] = ()  # of the rows in a file, for scans that look for some of them
    dealt: bool = False  # its changes are combined as (stored, incoming, bucket, slices), dealt by bucket and slice


class Snapshots:
    """Tables under a shared folder; every read names one committed version."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.tables, self.buckets = spark, folder.rstrip("/"), tables, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """Names in a folder below this one, none if it is missing."""
        files, path = self._files(), self._path(folder)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        return max((int(n) for n in self.names("versions") if n.isdigit()), default=0)

    def layout(self, version: int | None = None) -> Layout:
        version = self.version() if version is None else version
        if version == 0:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{version:0{DIGITS}d}", wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """All rows of a table as of a version, the latest by default."""
        return self.rows(name, self.layout(version).get(name, {}).values())

    def rows(self, name: str, folders) -> DataFrame:
        paths = [f"{self.folder}/{f}" for f in folders]
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> Change:
        """A change on top of the latest version."""
        version = self.version()
        return Change(self, version, self.layout(version))

    def change(self, step: Callable[[Change], None], tries: int = 3) -> int:
        """Commits what ``step`` does; done again on the new version if another change came first."""
        for left in reversed(range(tries)):
            change = self.begin()
            try:
                step(change)
                return change.commit()
            except Conflict:
                if left == 0:
                    raise
        raise ValueError("no tries given")

    def publish(self, version: int, layout: Layout) -> None:
        """Makes a layout the given version, unless there is one of that number."""
        jvm, files = self.spark._jvm, self._files()
        files.mkdirs(self._path("versions"))
        draft, final = self._path(f"versions/draft-{uuid.uuid4().hex}"), self._path(f"versions/{version:0{DIGITS}d}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(layout, sort_keys=True).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(final), options)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if error.java_exception.getClass().getName() != EXISTS:
                raise
            raise Conflict(f"version {version} was committed by another change") from None


@dataclass
class Change:
    """Rows staged on top of a version; nothing of it is visible before ``commit``."""

    store: Snapshots
    base: int
    layout: Layout
    staged: list[str] = field(default_factory=list)
    start: Layout = field(init=False)

    def __post_init__(self) -> None:
        self.start = self.layout

    def read(self, name: str) -> DataFrame:
        """A table with what this change has staged so far."""
        return self.store.rows(name, self.layout.get(name, {}).values())

    def merge(self, name: str, incoming: DataFrame, combine: Combine, stored: bool = False) -> Change:
        """Rewrites the buckets of the incoming keys as ``combine(stored, incoming)``.

        ``combine`` gets the stored rows of these buckets only, and gives all rows
        they shall hold, each under a key of the incoming or stored ones. ``stored`` says
        that the incoming rows are written already. A bucket is written in slices, so that
        the tasks are those of the session, however few the buckets are.
        """
        store, table = self.store, self.store.tables[name]
        bucket = self._bucket(name)
        slices = max(1, 4 * int(store.spark.conf.get("spark.sql.shuffle.partitions")) // store.buckets)
        incoming = incoming if stored else written(incoming, f"incoming-{name}")
        touched = [str(r[0]) for r in incoming.select(bucket.alias("b")).distinct().collect()]
        now = self.layout.get(name, {})
        if not touched:
            return self
        held = store.rows(name, [now[b] for b in touched if b in now])
        combined = combine(held, incoming, bucket, slices) if table.dealt else combine(held, incoming)
        return self._rewrite(name, combined, touched, None if table.dealt else slices)

    def derive(self, name: str, source: str, make: Callable[[DataFrame], DataFrame]) -> Change:
        """Rewrites the buckets of a table that this change has rewritten in ``source``, as ``make`` of what they hold there.

        Both tables have the same key. Rows are written by the tasks that make them.
        """
        before, now = self.start.get(source, {}), self.layout.get(source, {})
        touched = [b for b in before | now if before.get(b) != now.get(b)]
        if not touched:
            return self
        return self._rewrite(name, make(self.store.rows(source, [now[b] for b in touched if b in now])), touched)

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.hash(*self.store.tables[name].key), F.lit(self.store.buckets))

    def _rewrite(self, name: str, rows: DataFrame, touched: list[str], slices: int | None = None) -> Change:
        """Stages rows as all that the touched buckets hold, dealt by bucket first if ``slices`` are given."""
        store, table = self.store, self.store.tables[name]
        folder = f"data/{name}/{uuid.uuid4().hex}"
        self.staged.append(folder)
        placed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]).withColumn(BUCKET, self._bucket(name))
        if slices is not None:
            placed = placed.repartition(F.col(BUCKET), F.pmod(F.xxhash64(*table.key), F.lit(slices)))
        if table.order:
            placed = placed.sortWithinPartitions(BUCKET, *table.order)
        placed.write.partitionBy(BUCKET).parquet(f"{store.folder}/{folder}", compression=STORED_AS)
        made = {n.partition("=")[2] for n in store.names(folder) if n.startswith(f"{BUCKET}=")}
        kept = {b: f for b, f in self.layout.get(name, {}).items() if b not in touched}
        self.layout = self.layout | {name: kept | {b: f"{folder}/{BUCKET}={b}" for b in made}}
        return self

    def upsert(self, name: str, rows: DataFrame) -> Change:
        """Adds rows or replaces those of the same key; incoming keys are unique."""
        return self.merge(name, rows, lambda old, new: upsert(old, new.select(*old.columns), list(self.store.tables[name].key)))

    def insert(self, name: str, rows: DataFrame) -> Change:
        """Adds the rows whose key is not stored; incoming keys are unique."""
        key = list(self.store.tables[name].key)
        return self.merge(name, rows, lambda old, new: old.unionByName(insert_new(old, new.select(*old.columns), key)))

    def delete(self, name: str, keys: DataFrame) -> Change:
        """Takes out the rows of the given keys."""
        key = list(self.store.tables[name].key)
        return self.merge(name, keys.select(*key).distinct(), lambda old, gone: delete_by(old, gone, key))

    def commit(self) -> int:
        """Makes all staged rows visible at once, as the next version."""
        try:
            self.store.publish(self.base + 1, self.layout)
        except Conflict:
            self.abort()
            raise
        return self.base + 1

    def abort(self) -> None:
        """Drops the files of this change, which no version names."""
        files = self.store._files()
        for folder in self.staged:
            files.delete(self.store._path(folder), True)
        self.staged = []
