"""Keyed tables on Parquet that take batches without being rewritten, and commits over several.

A table has a fixed number of buckets by a hash of its key. A batch writes its rows, one
a key, into a folder of its own, under the buckets that they fall in; nothing else is
touched. A manifest lists for each bucket its base folder and the deltas since, and a
new manifest, under the next number, is put in place by one rename: a reader sees the
state before or after, never a gap, and may ask for an earlier one. Reading takes
buckets without deltas as they are and keeps the latest row of each key in the others.
``compact`` makes bases of buckets with many deltas; ``vacuum`` deletes what no kept
manifest names.

``Saga`` runs steps over several tables with a journal: after a failure, or a crash
and ``recover``, the steps that had begun are undone in reverse.

One writer at a time for each table (a second one's rename fails on a file system with
exclusive renames). The driver handles names of folders, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

_VERSION, _DELETED, _BUCKET = "__version", "__deleted", "bucket"


class Files:
    """Small files of a folder, on whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, name: str, said: dict) -> None:
        """The whole file at once, and only if there is none of that name."""
        staged, target = self._at(f".staged-{uuid.uuid4().hex}"), self._at(name)
        stream = self._fs.create(staged, False)
        try:
            stream.write(bytearray(json.dumps(said, sort_keys=True).encode()))
        finally:
            stream.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise FileExistsError(f"{self.path}/{name}: another writer was there first")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class KeyedTable:
    """A table of one row a key. A null key is a key like any other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)
        self.about = self.files.read("table.json")
        self.key, self.buckets = self.about["key"], self.about["buckets"]
        self.schema = StructType.fromJson(self.about["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 64) -> KeyedTable:
        shape = spark.createDataFrame([], schema).schema
        if key not in shape.names or {_VERSION, _DELETED, _BUCKET} & set(shape.names):
            raise ValueError(f"the key is not a column, or a column has a reserved name: {shape.names}")
        files = Files(spark, path)
        files.put("table.json", {"key": key, "buckets": buckets, "schema": json.loads(shape.json())})
        files.put(f"manifests/{0:020d}.json", {"buckets": {}, "batches": {}})
        return cls(spark, path)

    def version(self) -> int:
        return max(int(n[:20]) for n in self.files.names("manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        return self.files.read(f"manifests/{self.version() if version is None else version:020d}.json")

    def _publish(self, manifest: dict) -> int:
        version = self.version() + 1
        self.files.put(f"manifests/{version:020d}.json", manifest)
        return version

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Writes rows under their buckets; the folder's name and the buckets that got any."""
        folder = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.key), self.buckets).cast("int")
        rows.withColumn(_BUCKET, bucket).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.files.path}/{folder}")
        return folder, [n for n in self.files.names(folder) if n.startswith(f"{_BUCKET}=")]

    def merge(self, batch: DataFrame, order: str | None = None, deletes: str | None = None, source: str = "", number: int | None = None) -> int:
        """The version after the rows of ``batch`` have taken the places of their keys.

        ``order``: of rows of one key the last by it stays (then by content).
        ``deletes``: a boolean column; where it is true the key goes. ``source`` and
        ``number``: a batch that was merged before, by that source's number, is left out.
        """
        manifest = self.manifest()
        if number is not None and manifest["batches"].get(source, -1) >= number:
            return self.version()
        gone = F.coalesce(F.col(deletes), F.lit(False)) if deletes else F.lit(False)
        rows = batch.select(*(F.col(c.name).cast(c.dataType).alias(c.name) for c in self.schema), gone.alias(_DELETED), *([F.col(order).alias("__order")] if order else []))
        last = F.struct(*(["__order"] if order else []), F.xxhash64(F.struct(*self.schema.names)))
        best = rows.groupBy(F.col(self.key).alias("__key")).agg(F.max_by(F.struct(*self.schema.names, _DELETED), last).alias("row"))
        folder, touched = self._write(best.select("row.*").withColumn(_VERSION, F.lit(self.version() + 1).cast("bigint")))
        for b in touched:
            manifest["buckets"].setdefault(b, []).append(folder)
        if number is not None:
            manifest["batches"][source] = number
        return self._publish(manifest)

    def delete(self, keys: DataFrame) -> int:
        """Takes out the keys, a column of the key's name."""
        empty = [F.lit(None).cast(c.dataType).alias(c.name) for c in self.schema if c.name != self.key]
        return self.merge(keys.select(self.key, *empty, F.lit(True).alias("__gone")), deletes="__gone")

    def _rows(self, folders: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.files.path}/{f}/{b}" for b, fs in folders.items() for f in fs]
        shape = StructType([*self.schema.fields, StructField(_DELETED, BooleanType()), StructField(_VERSION, LongType())])
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def _merged(self, folders: dict[str, list[str]]) -> DataFrame:
        """Live rows: clean buckets need no shuffle."""
        clean, dirty = ({b: fs for b, fs in folders.items() if (len(fs) == 1) == one} for one in (True, False))
        latest = self._rows(dirty).groupBy(F.col(self.key).alias("__key")).agg(F.max_by(F.struct("*"), _VERSION).alias("row")).select("row.*")
        whole = self._rows(clean).unionByName(latest) if dirty and clean else latest if dirty else self._rows(clean)
        return whole.where(~F.col(_DELETED))

    def read(self, version: int | None = None) -> DataFrame:
        return self._merged(self.manifest(version)["buckets"]).select(*self.schema.names)

    def compact(self, least: int = 4) -> int:
        """Makes one folder of each bucket that has ``least`` or more."""
        manifest = self.manifest()
        many = {b: fs for b, fs in manifest["buckets"].items() if len(fs) >= least}
        if not many:
            return self.version()
        folder, left = self._write(self._merged(many))
        for b in many:
            manifest["buckets"].pop(b)
        for b in left:
            manifest["buckets"][b] = [folder]
        return self._publish(manifest)

    def restore(self, version: int) -> int:
        """A new version that is what ``version`` was."""
        return self._publish(self.manifest(version))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all manifests but the last ``keep`` and what only they named."""
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        kept = {f"{f.split('/')[1]}/{b}" for n in names[-keep:] for b, fs in self.files.read(f"manifests/{n}")["buckets"].items() for f in fs}
        for n in names[:-keep]:
            self.files.delete(f"manifests/{n}")
        gone = []
        for folder in self.files.names("data"):
            inside = [b for b in self.files.names(f"data/{folder}") if b.startswith(f"{_BUCKET}=")]
            unnamed = [b for b in inside if f"{folder}/{b}" not in kept]
            for b in [""] if len(unnamed) == len(inside) else unnamed:
                gone.append(f"data/{folder}/{b}".rstrip("/"))
                self.files.delete(gone[-1])
        return gone


def merge_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, order: str | None = None, deletes: str | None = None, compact_at: int = 8):
    """A query that merges each micro-batch once, also where one is run again after a crash."""

    def each(batch: DataFrame, number: int) -> None:
        table.merge(batch, order, deletes, source=checkpoint, number=number)
        table.compact(compact_at)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def update_from_diff(table: KeyedTable, now: DataFrame, compared: Sequence[str]) -> dict[str, int]:
    """Makes the table hold just the rows ``now``: only keys added, changed in ``compared`` or removed are written."""
    k = table.key
    old, new = table.read().select(k, F.struct(*compared).alias("__old")), now.select("*", F.struct(*compared).alias("__new"))
    joined = new.withColumn("__is_new", F.lit(True)).join(old.withColumnRenamed(k, "__k").withColumn("__was", F.lit(True)), F.col(k).eqNullSafe(F.col("__k")), "full_outer")
    kind = F.when(F.col("__was").isNull(), "added").when(F.col("__is_new").isNull(), "removed").when(~F.col("__new").eqNullSafe(F.col("__old")), "changed")
    diff = joined.withColumn("__kind", kind).where("__kind is not null")
    removed = F.col("__kind") == "removed"
    rows = [F.when(removed, F.col("__k")).otherwise(F.col(k)).alias(k) if c == k else F.col(c) for c in table.schema.names]
    changes = diff.select(*rows, removed.alias("__gone"), "__kind")
    counts = {r["__kind"]: r["count"] for r in changes.groupBy("__kind").count().collect()}
    if counts:
        table.merge(changes, deletes="__gone")
    return {kind: counts.get(kind, 0) for kind in ("added", "changed", "removed")}


def repair_orphans(table: KeyedTable, column: str, targets: DataFrame, target: str) -> DataFrame:
    """Takes out rows whose ``column`` names no target; gives back their keys."""
    orphans = table.read().join(targets.select(F.col(target).alias(column)), column, "left_anti").select(table.key)
    before = table.version()
    table.delete(orphans)
    had = table.read(before)
    return had.join(table.read().select(table.key), table.key, "left_anti").select(table.key)


Step = tuple[str, Callable[[], object], Callable[[object], object]]


class Saga:
    """Steps (name, do, undo) of which all stand in the end or none.

    A journal in ``path`` says what a step is about to change (the JSON that ``before``
    of its name gives, if there is one) before it begins, and that it has ended. ``undo``
    gets what was said; it must do no harm where the step had not begun or was undone already.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, steps: Sequence[Step], before: dict[str, Callable[[], object]] | None = None):
        self.files, self.name, self.steps, self.before = Files(spark, path), name, list(steps), before or {}

    def _mark(self, said: str, value: object = None) -> None:
        n = len(self.files.names(self.name))
        self.files.put(f"{self.name}/{n:06d}-{said}.json", {"value": value})

    def _marks(self) -> list[tuple[str, object]]:
        return [(n[7:-5], self.files.read(f"{self.name}/{n}")["value"]) for n in self.files.names(self.name)]

    def state(self) -> str:
        marks = [m for m, _ in self._marks()]
        return next((s for s in ("completed", "compensated") if s in marks), "begun" if marks else "new")

    def run(self) -> str:
        """completed, or compensated after a step's error, which is raised if undoing fails as well."""
        if self.state() != "new":
            return self.recover()
        for name, do, _ in self.steps:
            self._mark(f"begin-{name}", self.before[name]() if name in self.before else None)
            try:
                do()
            except Exception as error:
                self._mark(f"failed-{name}", str(error)[:1000])
                return self._compensate()
            self._mark(f"done-{name}")
        self._mark("completed")
        return "completed"

    def recover(self) -> str:
        """After a crash: a saga that had begun and not ended is undone."""
        state = self.state()
        return self._compensate() if state == "begun" else state

    def _compensate(self) -> str:
        said = {m[6:]: value for m, value in self._marks() if m.startswith("begin-")}
        undone = {m[7:] for m, _ in self._marks() if m.startswith("undone-")}
        for name, _, undo in reversed(self.steps):
            if name in said and name not in undone:
                undo(said[name])
                self._mark(f"undone-{name}")
        self._mark("compensated")
        return "compensated"


def table_saga(spark: SparkSession, path: str, name: str, changes: Sequence[tuple[str, KeyedTable, Callable[[KeyedTable], object]]]) -> Saga:
    """A saga of changes to tables; to undo is to restore the version from before."""

    def undo(table: KeyedTable) -> Callable[[object], object]:
        return lambda version: table.restore(version) if table.version() != version else None

    steps = [(step, lambda t=table, f=change: f(t), undo(table)) for step, table, change in changes]
    return Saga(spark, path, name, steps, {step: table.version for step, table, _ in changes})
