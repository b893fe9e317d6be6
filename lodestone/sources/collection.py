"""Stored collections: Parquet files in buckets of sources, and manifests that say which count.

A point's bucket follows from its source path. A manifest names the folder that
holds each bucket's content; folders are never changed, so readers and lost
executors see a whole table. A write touches the buckets of the sources that it
brings or removes, writes them to a new folder and commits a manifest of the next
number; a second writer that has begun from the same manifest fails there, so no
update is lost. Paths go through Hadoop's file system, so any store that Spark
reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import schemas as S

POINT = ", ".join(["point_id string", *[f"{f.name} {f.dataType.simpleString()}" for f in S.CHUNK if f.name in S.PAYLOAD], "hypothetical_questions array<string>", "embedding array<float>"])
NAMES = [c.split()[0] for c in POINT.split(", ")]
#: Buckets of a new collection; about a million points each keep rewrites small.
BUCKETS = 64


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, f"{root.rstrip('/')}/{name}", buckets
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.base}/{p}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        """Committed manifests in order."""
        if not self._fs.exists(self._path("commits")):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path("commits")))

    def _manifest(self) -> dict:
        """Number, buckets and the folder of each bucket that has content."""
        commits = self._commits()
        if not commits:
            return {"number": 0, "buckets": self.buckets, "folders": {}}
        stream = self._fs.open(self._path(f"commits/{commits[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self._commits())

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], POINT)
        return self.spark.read.schema(POINT).parquet(*[f"{self.base}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._read(list(self._manifest()["folders"].values()))

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce("source_path", F.lit(""))), F.lit(buckets)).cast("int")

    def _commit(self, now: dict, touched: list[int] | None, points: DataFrame) -> None:
        """``points`` as the whole content of the ``touched`` buckets (null: of all)."""
        have = set(points.columns)
        typed = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in POINT.split(", "))]
        folder = f"data/{now['number'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows = points.select(*typed).withColumn("_bucket", self._bucket(now["buckets"]))
        rows.repartition("_bucket", F.pmod(F.xxhash64("point_id"), F.lit(8))).write.partitionBy("_bucket").parquet(f"{self.base}/{folder}")
        new = {x.getPath().getName().removeprefix("_bucket="): f"{folder}/{x.getPath().getName()}" for x in self._fs.listStatus(self._path(folder)) if x.isDirectory()}
        kept = {} if touched is None else {b: f for b, f in now["folders"].items() if int(b) not in touched}
        manifest = {"number": now["number"] + 1, "buckets": now["buckets"], "folders": kept | new}
        out = self._fs.create(self._path(f"commits/{manifest['number']:08d}"), False)  # fails if another writer was faster
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        self._clean(now, manifest)

    def _clean(self, last: dict, now: dict) -> None:
        """Drop folders and manifests that neither of the last two manifests names: a reader may still hold the last one."""
        held = {f.rsplit("/", 1)[0] for m in (last, now) for f in m["folders"].values()}
        for x in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            name = x.getPath().getName()
            if f"data/{name}" not in held and int(name.split("-")[0]) < last["number"]:
                self._fs.delete(x.getPath(), True)
        for c in self._commits()[:-2]:
            self._fs.delete(self._path(f"commits/{c}"), True)

    def write(self, points: DataFrame) -> None:
        """Replace the whole content."""
        self._commit(self._manifest(), None, points)

    def ensure(self, recreate: bool = False) -> None:
        if recreate or not self.exists():
            self.write(self.spark.createDataFrame([], POINT))

    def drop(self) -> None:
        self._fs.delete(self._path("."), True)

    def _change(self, sources: DataFrame, content) -> None:
        """Rewrite the buckets of ``sources`` with ``content(what they hold)``; at most ``buckets`` numbers reach the driver."""
        now = self._manifest()
        touched = [r[0] for r in sources.select(self._bucket(now["buckets"]).alias("b")).distinct().collect()]
        if touched:
            self._commit(now, touched, content(self._read([f for b, f in now["folders"].items() if int(b) in touched])))

    def upsert(self, points: DataFrame) -> int:
        """Insert or replace by point_id; of several rows with one id the last by path and place counts. Returns the number of points given.

        An id follows from the source path, so old and new rows of an id share a bucket.
        """
        new = latest(points)
        self._change(points, lambda held: held.join(new.select("point_id"), "point_id", "left_anti").unionByName(new, allowMissingColumns=True))
        return points.count()

    def replace_sources(self, paths: DataFrame, points: DataFrame) -> None:
        """Make the points of the sources in ``paths`` (source_path) exactly ``points``; other sources stay."""
        self._change(paths, lambda held: held.join(paths, "source_path", "left_anti").unionByName(points, allowMissingColumns=True))

    def source_paths(self) -> DataFrame:
        return self.read().where("source_path is not null").select("source_path").distinct()

    def delete_by_source(self, path: str) -> int:
        gone = self.read().where(F.col("source_path") == path).count()
        if gone:
            one = self.spark.createDataFrame([(path,)], "source_path string")
            self._change(one, lambda held: held.where(~F.col("source_path").eqNullSafe(F.lit(path))))
        return gone

    def sync(self, points: DataFrame) -> DataFrame:
        """Make the content exactly ``points``. Returns source_path, deleted for the sources that went."""
        schema = "source_path string, deleted long"
        if not self.exists():
            self.write(latest(points))
            return self.spark.createDataFrame([], schema)
        folder = f"{self.base}/removed/{uuid.uuid4().hex}"
        pruned(self.read(), points).write.parquet(folder)
        self.write(latest(points))
        return self.spark.read.schema(schema).parquet(folder)


def latest(points: DataFrame) -> DataFrame:
    """One row for each point_id."""
    order = Window.partitionBy("point_id").orderBy(*[F.desc(c) for c in ("source_path", "symbol_name", "text") if c in points.columns])
    return points.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def pruned(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored sources that the current rows don't have, with their numbers of points."""
    keep = current.select("source_path").distinct()
    return stored.where("source_path is not null").join(keep, "source_path", "left_anti").groupBy("source_path").agg(F.count("*").alias("deleted"))
