"""Sharding by size-tiered compaction, with DataFrame functions only.

Arrivals are appended as small immutable Parquet shards. Compaction sorts the live shards into tiers of similar size
and merges runs of a tier into files of about the target size. Appends and compactions are committed as the next
version of a manifest, one Parquet file that lists the live shards: it is written aside and renamed into place, which
fails if that version exists; the beaten writer then commits its finished shards on top of the winner's version, if
what it merged is still live. Readers take the highest version, so they see all of a commit or nothing of it; shards
that a lost writer left are in no manifest. Shards of older versions stay until ``vacuum``.

A manifest has a row per shard, and each commit writes all of it, by one task: at shards of 64 MiB, 1.6 million rows for
100 TB. The driver handles lists of at most ``MAX_FILES`` paths.
"""

from __future__ import annotations

import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.utils import AnalysisException

from . import common

MANIFEST = "path string, n_rows long, n_bytes long, tier int, born long"
#: Parameters: bytes of a finished shard, the first tier's size and the tiers' ratio, shards that make a run.
TARGET_BYTES = 64 << 20
TIER_BYTES = 1 << 20
TIER_RATIO = 4
LEAST_RUN = 2
MAX_FILES = 10_000
PLAN_ROWS = 100_000


def _file() -> Column:
    """The path of a row's file; Spark gives it as an encoded address, but reads plain paths."""
    return F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    """A sharded table at ``root``, a path that Spark can write.

    Rows are stored as they come: nulls, texts of any length, repeated rows and columns of any name. Arrivals share one
    schema. An empty arrival is a version without new shards; an empty store reads as None.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, tier_bytes: int = TIER_BYTES, tier_ratio: int = TIER_RATIO, least_run: int = LEAST_RUN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.tier_bytes, self.tier_ratio, self.least_run = target_bytes, tier_bytes, tier_ratio, least_run

    # ---- manifest

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(n[1:-8]) for n in names if n.startswith("v") and n.endswith(".parquet"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version:010d}.parquet")

    def commit(self, shards: DataFrame, version: int) -> int:
        """Makes ``shards`` the manifest ``version``; raises Conflict if that is taken."""
        aside = f"{self.root}/tmp/{uuid.uuid4().hex}"
        shards.select(*[x.split()[0] for x in MANIFEST.split(", ")]).coalesce(1).write.parquet(aside)
        part = next(s.getPath() for s in self._fs().listStatus(self._path(aside)) if s.getPath().getName().endswith(".parquet"))
        self._fs().mkdirs(self._path(f"{self.root}/manifest"))
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(part, self._path(f"{self.root}/manifest/v{version:010d}.parquet"), options)
        except Exception as e:
            if self._fs().exists(self._path(f"{self.root}/manifest/v{version:010d}.parquet")):
                raise Conflict(f"version {version} exists") from e
            raise
        finally:
            self._fs().delete(self._path(aside), True)
        return version

    # ---- shards

    def _tier(self):
        level = F.floor(F.log(F.greatest(F.col("n_bytes") / self.tier_bytes, F.lit(1.0))) / F.log(F.lit(float(self.tier_ratio))))
        return level.cast("int")

    def _shards(self, folder: str) -> DataFrame:
        """What was written below ``folder``: reads no column but the files' metadata."""
        try:
            rows = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        except AnalysisException:  # nothing was written
            return self.spark.createDataFrame([], MANIFEST)
        rows = rows.select(_file().alias("path"), F.col("_metadata.file_size").alias("n_bytes"))
        found = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_bytes").alias("n_bytes"))
        return found.withColumn("tier", self._tier()).withColumn("born", F.lit(0).cast("long"))

    def _commit_on_top(self, new: DataFrame, gone: DataFrame | None = None, n_gone: int = 0) -> int:
        """Commits the newest manifest with ``new`` shards, without those whose paths are in ``gone``. Tries again when
        another writer is faster; raises Conflict if one has taken some of ``gone``."""
        while True:
            version = self.version()
            live = self.manifest(version)
            if gone is not None:
                if live.join(F.broadcast(gone), "path", "left_semi").count() < n_gone:  # at most MAX_FILES rows
                    raise Conflict("another writer has merged the same shards")
                live = live.join(F.broadcast(gone), "path", "left_anti")
            try:
                return self.commit(live.unionByName(new.withColumn("born", F.lit(version + 1).cast("long"))), version + 1)
            except Conflict:
                continue

    def append(self, df: DataFrame) -> int:
        """Commits ``df`` as one arrival; each task writes one small shard."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self._commit_on_top(common.materialize(self._shards(folder), "shards"))

    def append_arrivals(self, df: DataFrame, arrival_col: str) -> int:
        """Commits each value of ``arrival_col`` as one arrival, in order, all written in one pass. The column isn't
        stored. A null is an arrival too, the first."""
        folder, version = f"{self.root}/shards/{uuid.uuid4().hex}", self.version()
        df.write.option("compression", "zstd").partitionBy(arrival_col).parquet(folder)
        written = common.materialize(self._shards(folder).withColumn("arrival", F.regexp_extract("path", r"/([^/]*)/[^/]*$", 1)), "shards")
        for (arrival,) in written.select("arrival").distinct().orderBy("arrival").collect():
            version = self._commit_on_top(written.filter(F.col("arrival") == arrival).drop("arrival"))
        return version

    def plan(self, version: int) -> DataFrame:
        """(path, run): the runs to merge. Within a tier, shards in order of size fill runs of about the target size;
        shards that are over half of it stay. Tiers of many shards are planned in slices."""
        live = self.manifest(version).filter(F.col("n_bytes") < self.target_bytes // 2)
        slices = live.count() // PLAN_ROWS + 1
        live = live.withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(slices)))
        upto = F.sum("n_bytes").over(Window.partitionBy("tier", "slice").orderBy("n_bytes", "path"))
        runs = live.withColumn("run", F.concat_ws("-", "tier", "slice", F.floor((upto - F.col("n_bytes") / 2) / self.target_bytes)))
        runs = runs.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("run")))
        return runs.filter(F.col("members") >= self.least_run).select("path", "run")

    def compact(self) -> int:
        """Merges runs until no tier has one; returns the version. Runs that another writer has merged are left to it."""
        while True:
            version = self.version()
            merges = self.plan(version).orderBy("run", "path").limit(MAX_FILES).collect()
            if not merges:
                return version
            with suppress(Conflict):
                self._merge(merges, version)

    def _merge(self, merges: list, version: int) -> int:
        """Each run is one task's: runs are of about the target size."""
        runs = {r: i for i, r in enumerate(sorted({m.run for m in merges}))}
        data = self.spark.read.option("mergeSchema", "false").parquet(*[m.path for m in merges])
        run, path = (common.fresh_name(data.columns, x) for x in ("run", "path"))
        plan = self.spark.createDataFrame([(m.path, runs[m.run]) for m in merges], f"`{path}` string, `{run}` int")
        dealt = data.withColumn(path, _file()).join(F.broadcast(plan), path).drop(path).repartitionById(len(runs), F.col(run))  # at most MAX_FILES rows
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        dealt.write.option("compression", "zstd").partitionBy(run).parquet(folder)
        new = common.materialize(self._shards(folder), "shards")
        gone = plan.select(F.col(path).alias("path"))
        before = self.manifest(version).join(F.broadcast(gone), "path", "left_semi").agg(F.sum("n_rows")).first()[0]
        after = new.agg(F.sum("n_rows")).first()[0]
        if before != after:
            raise RuntimeError(f"compaction made {after} rows of {before}")
        return self._commit_on_top(new, gone, len(merges))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table at a version, the latest by default; None if it has no shards."""
        live = self.manifest(version).select("path")
        paths = [r.path for r in live.limit(MAX_FILES + 1).collect()]
        if not paths:
            return None
        if len(paths) <= MAX_FILES:
            return self.spark.read.option("mergeSchema", "false").parquet(*paths)
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.root}/shards")  # with dead shards
        mark = common.fresh_name(rows.columns, "path")
        return rows.withColumn(mark, _file()).join(live.withColumnRenamed("path", mark), mark, "left_semi").select(*rows.columns)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the shards that none of the last ``keep`` versions lists, and older manifests."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        gone = None
        for v in old:
            gone = self.manifest(v).select("path") if gone is None else gone.union(self.manifest(v).select("path"))
        if gone is None:
            return 0
        for v in kept:
            gone = gone.join(self.manifest(v).select("path"), "path", "left_anti")
        paths = [r.path for r in gone.distinct().collect()]
        for p in [*paths, *[f"{self.root}/manifest/v{v:010d}.parquet" for v in old]]:
            self._fs().delete(self._path(p), False)
        return len(paths)


def query(spark, sf_dir, arrivals: int = 4):
    """Documents arrive in parts, are appended and compacted; where each of them then is."""
    docs = common.documents(spark, sf_dir)
    store = Store(spark, common.scratch_path(spark, "store"))
    arrival = common.fresh_name(docs.columns, "arrival")
    store.append_arrivals(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), arrival)
    version = store.compact()
    data = store.read(version)
    if data is None:
        return docs.select("doc_id", F.crc32(F.lit("")).alias("text_crc32"), F.lit("").alias("shard"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("shard_rows"), F.lit(0).cast("long").alias("version"))
    at = data.select("doc_id", F.crc32(common.text_or_empty("text").cast("binary")).alias("text_crc32"), _file().alias("path"))
    shards = store.manifest(version)
    # the shards' list is a table of one row per file: broadcast while it is small, joined by shuffle beyond
    shards = F.broadcast(shards) if shards.count() <= PLAN_ROWS else shards
    out = at.join(shards, "path")
    return out.select("doc_id", "text_crc32", F.regexp_extract("path", r"([^/]*)$", 1).alias("shard"), "tier", F.col("n_rows").alias("shard_rows"), F.lit(version).cast("long").alias("version"))
