"""Sharding by size-tiered compaction with a versioned manifest (DataFrame functions only).

An arrival is appended as small immutable shards: files of a new folder, never touched
again. A version of the manifest is a table of the live files (shard, path, rows, bytes,
tier). Compaction reads the newest manifest, puts files into tiers by the power of
``fanout`` of their size, and merges the similarly sized runs of a tier into files of about
the target size, if that at least halves their number. Files of the target size and lone
runs stay as they are. The new version is written beside the old one and becomes visible
by one rename of its folder, so readers see either version whole, and of two writers of a
version one fails: an append that lost commits again on the newer version, a compaction
that lost is dropped. Every attempt writes a folder of its own, so what a dead writer left
is in nobody's way. Nothing is deleted before ``vacuum``, which no writer may run beside.

Rows never cross a shuffle: a task appends or merges whole files, and the target size
bounds what it writes. Manifest rows are per file, not per document.

Defined results: every row of an arrival is in exactly one live shard, repeated rows as
often as they were given; nulls are stored as they are; an empty arrival adds no rows; a
document longer than the target is in a file beyond the target; extra columns are stored,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES, FANOUT, MIN_RUNS = 32 << 20, 4, 2
MANIFEST = "shard string, path string, rows bigint, bytes bigint, tier int"


class ShardStore:
    """A folder of shards: ``data/<batch>`` and ``manifest/v<number>``."""

    def __init__(self, spark: SparkSession, folder: str, *, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, min_runs: int = MIN_RUNS, codec: str = "zstd"):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target, self.fanout, self.min_runs, self.codec = target_bytes, fanout, min_runs, codec

    # ------------------------------------------------ versions

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        """Hadoop's file system of a path: the driver's commit works on any store that Spark
        writes to."""
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = f"{self.folder}/manifest"
        fs = self._fs(at)
        if not fs.exists(self._path(at)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(at))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/v{have[-1] if version is None else version:08d}")

    def commit(self, files: DataFrame, version: int) -> int:
        """Write a manifest under a private name, then rename it. The rename refuses an
        existing target and is the commit point."""
        staged, final = f"{self.folder}/manifest/_staged-{uuid.uuid4().hex}", f"{self.folder}/manifest/v{version:08d}"
        files.coalesce(1).write.parquet(staged)
        sc = self.spark.sparkContext
        fs = self._fs(staged)
        hadoop = sc._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(staged), self._path(final), sc._gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:  # whatever the store says, the version was not committed by us
            fs.delete(self._path(staged), True)
            raise RuntimeError(f"version {version} was not committed: {final} exists or cannot be written") from e
        return version

    # ------------------------------------------------ files

    def tier(self, size: Column) -> Column:
        """0 for the smallest runs; runs of a tier differ by less than ``fanout`` times."""
        low = self.target / self.fanout**6
        return F.greatest(F.lit(0), F.floor(F.log(float(self.fanout), F.greatest(size.cast("double"), F.lit(1.0)) / low))).cast("int")

    def _listed(self, batch: str, schema: StructType) -> DataFrame:
        """Manifest rows of the files just written: only file metadata is read."""
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/data/{batch}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(part-\d+)", 1)
        return rows.groupBy("path").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes")).select(F.concat(F.lit(f"{batch}/"), name).alias("shard"), "path", "rows", "bytes", self.tier(F.col("bytes")).alias("tier"))

    def append(self, arrival: DataFrame) -> int:
        """Add an arrival as it comes (no shuffle): small shards, one version."""
        have = self.versions()
        batch = f"a-{uuid.uuid4().hex}"
        if not have:
            arrival.limit(0).write.mode("overwrite").parquet(f"{self.folder}/schema")
        arrival.write.option("compression", self.codec).mode("errorifexists").parquet(f"{self.folder}/data/{batch}")
        listed = self._listed(batch, arrival.schema)
        while True:
            newest = have[-1] if have else 0
            try:
                return self.commit(self.manifest(newest or None).unionByName(listed), newest + 1)
            except RuntimeError:
                have = self.versions()
                if not have or have[-1] == newest:  # nobody else committed: the store is at fault
                    raise

    def plan(self, version: int) -> dict[int, int]:
        """tier -> number of new files: tiers whose small runs fill at most half as many
        files of the target size. A row per tier reaches the driver."""
        small = self.manifest(version).where(F.col("bytes") < self.target)
        rows = small.groupBy("tier").agg(F.count("*").alias("runs"), F.sum("bytes").alias("bytes")).collect()
        filled = {r["tier"]: (r["runs"], -(-r["bytes"] // self.target)) for r in rows}
        return {tier: n for tier, (runs, n) in sorted(filled.items()) if runs >= self.min_runs and 2 * n <= runs}

    def compact(self) -> int | None:
        """One round; the new version, or None if no tier has runs to merge. A tier's runs
        are read side by side and laid into its new files without a shuffle; their sizes
        are alike, so the new files are too."""
        have = self.versions()
        plan = self.plan(have[-1]) if have else {}
        if not plan:
            return None
        version, old = have[-1] + 1, self.manifest(have[-1])
        batch = f"c-{uuid.uuid4().hex}"
        moved = (F.col("bytes") < self.target) & F.col("tier").isin(*plan)
        parts = [self.read(have[-1], only=old.where(moved & (F.col("tier") == tier))).coalesce(n) for tier, n in plan.items()]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.union(part)
        merged.write.option("compression", self.codec).mode("errorifexists").parquet(f"{self.folder}/data/{batch}")
        return self.commit(old.where(~moved).unionByName(self._listed(batch, merged.schema)), version)

    def compact_fully(self) -> int | None:
        """Rounds until nothing merges; a row is rewritten once per tier that it climbs. A
        round at least halves the runs of some tier, so rounds end."""
        last = None
        while (version := self.compact()) is not None:
            last = version
        return last

    def vacuum(self) -> int:
        """Delete batches that the newest version does not use; older versions end."""
        live = {r[0] for r in self.manifest().select(F.substring_index("shard", "/", 1)).distinct().collect()}  # one row a batch
        at = f"{self.folder}/data"
        fs = self._fs(at)
        gone = [s.getPath() for s in fs.listStatus(self._path(at)) if s.getPath().getName() not in live]
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    # ------------------------------------------------ reading

    def read(self, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The rows of a version (of the files in ``only``, if given). The driver holds one
        path per file, as it does for any folder that Spark lists."""
        schema = self.spark.read.parquet(f"{self.folder}/schema").schema
        files = self.manifest(version) if only is None else only
        paths = [r[0] for r in files.select("path").orderBy("path").collect()]
        return self.spark.read.schema(schema).parquet(*(paths or [f"{self.folder}/schema"]))  # that folder has no rows

    def located(self, *columns: str | Column, version: int | None = None) -> DataFrame:
        """Rows with the shard that holds them: the columns, shard, shard_rows, tier."""
        m = self.manifest(version).select(F.col("path").alias("_path"), "shard", F.col("rows").alias("shard_rows"), "tier")
        return self.read(version).select(*columns, F.col("_metadata.file_path").alias("_file")).join(m, F.col("_file") == F.col("_path")).drop("_file", "_path")
