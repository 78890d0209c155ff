"""Tables that keep every version of their rows, where a batch rewrites only what it touches.

Rows are dealt into buckets by a hash of their keys. A batch reads and writes the buckets of its keys, in a folder of its
own; which folders are live says a manifest, one small file for each state of the table. A manifest is put in its place by
a rename that never replaces another, so a writer that was overtaken fails instead of undoing the other's work, and a
writer that dies before it leaves the table as it was. What is to be true of a table (one open row for each key) is checked
on the written files before the manifest moves.

A batch has the name of its source and a number; a batch that a manifest already knows changes nothing, so a stream may
hand it over again after a failure.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard

META = "version int, valid_from timestamp, valid_to timestamp"


class ConstraintBroken(ValueError):
    pass


class Overtaken(RuntimeError):
    """Another writer has put its manifest first."""


class VersionTable:
    """keys, values: fields of a row, as in a schema string. A row is open while valid_to is NULL."""

    def __init__(self, spark: SparkSession, path: str, keys: str, values: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        parsed = T._parse_datatype_string
        self.keys, self.values = parsed(keys).fieldNames(), parsed(values).fieldNames()
        self.schema = T.StructType([*parsed(keys).fields, *parsed(values).fields, *parsed(META).fields])

    # manifests

    def _context(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return jvm, where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def states(self) -> list[int]:
        _, where, system = self._context()
        if not system.exists(where):
            return []
        names = [s.getPath().getName() for s in system.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, state: int | None = None) -> dict:
        """state, live (bucket -> folders), applied (source -> last batch) of a state, the last one if not given."""
        known = self.states()
        state = (known[-1] if known else 0) if state is None else state
        if not state:
            return {"state": 0, "live": {}, "applied": {}}
        jvm, where, system = self._context()
        stream = system.open(jvm.org.apache.hadoop.fs.Path(where, f"{state}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        jvm, where, system = self._context()
        system.mkdirs(where)
        new, place = (jvm.org.apache.hadoop.fs.Path(where, n) for n in (f"new-{uuid.uuid4().hex}", f"{manifest['state']}.json"))
        out = system.create(new, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
        never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(new, place, never_over)
        except Exception as e:
            system.delete(new, False)
            if "AlreadyExists" in str(e):
                raise Overtaken(f"state {manifest['state']} of {self.path} is there already") from None
            raise

    # reading

    def _folders(self, live: dict, buckets: list[int] | None = None) -> DataFrame:
        found = sorted({f for b, fs in live.items() if buckets is None or int(b) in buckets for f in fs})
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in found])

    def read(self, state: int | None = None) -> DataFrame:
        """All versions, as of a state if given."""
        return self._folders(self.manifest(state)["live"])

    def current(self, state: int | None = None) -> DataFrame:
        return self.read(state).where(F.col("valid_to").isNull()).select(*self.keys, *self.values)

    # writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, at: Column, source: str = "", number: int | None = None) -> dict:
        """The manifest after a batch: keys, values and optionally removed (boolean). A key whose open row has the same
        values keeps it; another one is closed at the moment given and followed by a new version; a removed one is closed.
        A key that the batch holds twice breaks the constraint."""
        before = self.manifest()
        if number is not None and before["applied"].get(source, -1) >= number:
            return before
        removed = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in batch.columns else F.lit(False)
        new = batch.select(*self.keys, F.struct(*self.values).alias("__new"), removed.alias("__removed"), self._bucket().alias("__bucket"))
        touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # buckets at most
        manifest = {"state": before["state"] + 1, "live": dict(before["live"]), "applied": {**before["applied"], **({source: number} if number is not None else {})}}
        if touched:
            folder = f"data/{uuid.uuid4().hex}"
            try:
                self._merged(self._folders(before["live"], touched), new, at).withColumn("bucket", self._bucket()).repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
                self.check(self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}"))
                manifest["live"].update({b: [f"{folder}/bucket={b}"] for b in self._written(folder)})
                self._put(manifest)
            except (ConstraintBroken, Overtaken):
                discard(self.spark, f"{self.path}/{folder}")
                raise
        else:
            self._put(manifest)
        return manifest

    def _written(self, folder: str) -> list[str]:
        """The buckets that a folder has rows of."""
        jvm, _, system = self._context()
        names = [s.getPath().getName() for s in system.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"))]
        return sorted(n.removeprefix("bucket=") for n in names if n.startswith("bucket="))

    def _merged(self, old: DataFrame, new: DataFrame, at: Column) -> DataFrame:
        match = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.keys])
        of_key = Window.partitionBy(*self.keys)
        known = old.withColumn("__last", F.max("version").over(of_key))
        # each new row meets the open row of its key, or its last version where none is open
        head = known.where(F.col("valid_to").isNull() | (F.col("version") == F.col("__last"))).groupBy(*self.keys).agg(F.max("__last").alias("__last"), F.min_by(F.struct(*self.values), F.col("valid_to").isNotNull()).alias("__values"), F.count_if(F.col("valid_to").isNull()).alias("__open"))
        met = new.alias("n").join(head.alias("h"), match("n", "h"), "left").select("n.*", "__last", "__values", (F.coalesce("__open", F.lit(0)) > 0).alias("__open"))
        same = F.col("__open") & F.col("__values").eqNullSafe(F.col("__new")) & ~F.col("__removed")
        changes = met.where(~same & (F.col("__open") | ~F.col("__removed")))
        now = at.cast("timestamp")
        closing = changes.select(*[F.col(k).alias(f"__{k}") for k in self.keys]).distinct().alias("c")
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys])
        open_ = F.col("valid_to").isNull()
        kept = old.join(closing.withColumn("__closed", F.lit(True)), on, "left").select(*self.keys, *self.values, "version", "valid_from", F.when(open_ & F.col("__closed"), now).otherwise(F.col("valid_to")).alias("valid_to"))
        added = changes.where(~F.col("__removed")).select(*self.keys, "__new.*", (F.coalesce("__last", F.lit(0)) + 1).cast("int").alias("version"), now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
        return kept.unionByName(added)

    def check(self, rows: DataFrame) -> None:
        """Raise unless each key has one open row at most and each of its versions once."""
        wrong = rows.groupBy(*self.keys).agg(F.count_if(F.col("valid_to").isNull()).alias("open"), F.count("*").alias("n"), F.countDistinct("version").alias("versions"))
        found = wrong.where((F.col("open") > 1) | (F.col("n") != F.col("versions"))).limit(5).collect()
        if found:
            raise ConstraintBroken(f"several open rows or equal versions of a key: {[tuple(r[k] for k in self.keys) for r in found]}")

    def sink(self, source: str, at: Column | None = None):
        """A foreachBatch function: each batch is an upsert, known by the stream's name and its number."""

        def write(batch: DataFrame, number: int) -> None:
            self.upsert(batch, F.current_timestamp() if at is None else at, source, number)

        return write

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the last states names; returns how many folders went. No writer may be at work."""
        states = self.states()
        named = {f.split("/")[1] for s in states[-keep:] for fs in self.manifest(s)["live"].values() for f in fs}
        jvm, where, system = self._context()
        for s in states[:-keep]:
            system.delete(jvm.org.apache.hadoop.fs.Path(where, f"{s}.json"), False)
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        gone = [s.getPath().getName() for s in system.listStatus(data) if s.getPath().getName() not in named] if system.exists(data) else []
        for name in gone:
            discard(self.spark, f"{self.path}/data/{name}")
        return len(gone)
