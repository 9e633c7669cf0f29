"""Keyed upserts over several tables that become visible together.

A table is kept in a fixed number of hash buckets, each a folder of Parquet
files that never change. A manifest names, for every table and bucket, the
folder that holds it; writing the next manifest under its number is the one
step that makes a batch visible, for all its tables at once. A writer that dies
before leaves folders that no manifest names; of two writers that started from
one version, the second finds its number taken and starts over.

A batch is written in the same buckets. Its rows are compared with the held
ones column by column, and only buckets in which some row is new or differs
change; a bucket that held nothing takes the batch's own folder. A batch that
changes nothing makes no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed meanwhile."""


@dataclass(frozen=True)
class Upsert:
    """Rows for one table: by `keys`, the last in the order of `order` wins (then the larger content hash)."""

    rows: DataFrame
    keys: list[str]
    order: list[str] = field(default_factory=list)


class Tables:
    """The tables under `root`, on any store that Hadoop reaches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path, self._fs = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self._manifests(), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table at a version (the newest); None if it isn't there."""
        held = self._manifest(self.version() if version is None else version).get(table)
        return None if held is None else self._rows(held, list(held["folders"]))

    def _rows(self, held: dict, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        folders = [held["folders"][b] for b in buckets if b in held["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, keys: list[str]) -> Column:
        """The bucket of a row; doubles that are equal share one."""
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in sorted(keys)]), F.lit(self.buckets)).cast("int")

    def _batch(self, table: str, upsert: Upsert) -> dict:
        """The last row of each key, written by buckets under the root: schema and folders as in a manifest. No version names them yet."""
        content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(upsert.rows.columns)]), {"ignoreNullFields": "false"}), 256)
        keys = [f"`{k}`" for k in upsert.keys]
        # The hash decides among arrivals of one key; it is made after the shuffle and not kept.
        rows = upsert.rows.withColumn(_BUCKET, self._bucket(upsert.keys)).repartition(_BUCKET)
        last = Window.partitionBy(_BUCKET, *keys).orderBy(*[F.desc(c) for c in upsert.order], F.desc(content))
        one = rows.withColumn("_place", F.row_number().over(last)).where(F.col("_place") == 1).drop("_place")
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in upsert.rows.schema])
        return {"schema": json.loads(schema.json()), "folders": self._write(table, one)}

    def _write(self, table: str, rows: DataFrame) -> dict[str, str]:
        """The folders of the buckets that rows have, `buckets` at most."""
        folder = f"{self.root}/{table}/{uuid.uuid4().hex}"
        rows.write.partitionBy(_BUCKET).parquet(folder)
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(folder)))
        return {n.removeprefix(f"{_BUCKET}="): f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}

    def commit(self, batches: Mapping[str, Upsert], attempts: int = 5) -> dict[str, dict[str, int]]:
        """Upserts all batches in one version; per table the numbers of inserted, updated and unchanged rows.

        Null keys are values like any other. Conflict after `attempts` lost races.
        """
        written = {t: self._batch(t, u) for t, u in batches.items()}
        for _ in range(attempts):
            base = self.version()
            manifest = self._manifest(base)
            counts, changed = {}, {}
            for table, batch in written.items():
                counts[table], held = self._merge(table, batch, batches[table].keys, manifest.get(table))
                if held is not None:
                    changed[table] = held
            if not changed or self._publish(base + 1, manifest | changed):
                return counts
        raise Conflict(f"{self.root}: {attempts} commits lost to other writers")

    def _merge(self, table: str, batch: dict, keys: list[str], held: dict | None) -> tuple[dict[str, int], dict | None]:
        schema = T.StructType.fromJson(batch["schema"])
        if held is not None:
            there = T.StructType.fromJson(held["schema"])
            if {f.name: f.dataType for f in there} != {f.name: f.dataType for f in schema}:
                raise ValueError(f"{table}: the batch has other columns than the table")
            schema = there  # in the table's order
        held = held or {"schema": json.loads(schema.json()), "folders": {}}
        if not batch["folders"]:
            return {"inserted": 0, "updated": 0, "unchanged": 0}, None
        touched = list(batch["folders"])
        cols = [F.col(f"`{c}`") for c in schema.names]
        rows = lambda h, b, name: self._rows(h, b).select(self._bucket(keys).alias(_BUCKET), F.struct(*cols).alias(name))
        new, old = rows(batch, touched, "new"), rows(held, touched, "old")
        same = (F.col("n." + _BUCKET) == F.col("o." + _BUCKET)) & reduce(Column.__and__, [F.col(f"n.new.`{k}`").eqNullSafe(F.col(f"o.old.`{k}`")) for k in keys])
        told = new.alias("n").join(old.alias("o"), same, "left")
        plain = (T.IntegralType, T.StringType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.BinaryType)
        # Other types by their text: maps don't compare, and 0.0 is not -0.0.
        shown = lambda side, f: F.col(f"{side}.`{f.name}`") if isinstance(f.dataType, plain) else F.to_json(F.struct(F.col(f"{side}.`{f.name}`")))
        differs = reduce(Column.__or__, [~shown("new", f).eqNullSafe(shown("old", f)) for f in schema])
        state = F.when(F.col("old").isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
        found = told.groupBy(F.col("n." + _BUCKET).alias("b"), state.alias("state")).agg(F.count("*").alias("n")).collect()  # three a bucket at most
        counts = {"inserted": 0, "updated": 0, "unchanged": 0}
        for r in found:
            counts[r["state"]] += r["n"]
        fresh = {str(r["b"]) for r in found if r["state"] != "unchanged"}
        if not fresh:
            return counts, None
        mixed = [b for b in touched if b in fresh and b in held["folders"]]
        folders = {b: batch["folders"][b] for b in touched if b in fresh and b not in held["folders"]}
        if mixed:
            new, old = rows(batch, mixed, "new"), rows(held, mixed, "old")
            stays = old.alias("o").join(new.alias("n"), same, "left_anti").select(_BUCKET, F.col("old").alias("row"))
            folders |= self._write(table, stays.unionByName(new.select(_BUCKET, F.col("new").alias("row"))).repartition(_BUCKET).select(_BUCKET, "row.*"))
        return counts, held | {"folders": held["folders"] | folders}

    def _publish(self, version: int, manifest: dict) -> bool:
        """False if the version is there already; a rename is the one step that others see."""
        folder = f"{self.root}/_manifests"
        draft = self._path(f"{folder}/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, self._path(f"{folder}/{version}.json"), options)
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            self._fs.delete(draft, False)
            return False
        return True
