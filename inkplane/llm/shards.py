"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. A compaction plans on the manifest alone: shards below the target size
fall into tiers of similar size, runs within a tier are packed to target-sized groups, and each group is merged into
one new file. Old shards stay as they are; a new manifest version, committed by one atomic rename, names the live ones.
All data moves through built-in functions; the driver only renames the folder of a finished manifest.

Defined results: a null text counts 0 bytes; rows without id arrive by a hash of their text, as many may lack one, and
stand by that hash; repeated rows stay repeated; an empty
table gives a manifest without shards; further columns are stored as they are, names of working columns included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkplane.llm.common import row_key, stored

#: Bytes of text of an appended shard at most, but for a longer document, and of a merged one at least where enough came.
ARRIVAL_BYTES, TARGET_BYTES = 2 << 20, 16 << 20
#: Shards of a tier differ in size by this factor at most.
FANOUT = 4
#: Manifests of at most so many shards are broadcast, a few MB; longer ones are joined by a shuffle.
MANIFEST_ROWS = 50_000
#: Consecutive ids of one arrival.
ARRIVAL_IDS = 1000
MANIFEST = "shard string, run string, tier int, n_rows bigint, n_bytes bigint, version int"


class ShardStore:
    """Shards of rows of one schema below ``root``, with a manifest per version.

    A run folder holds what one append or merge wrote, a folder per shard. Files keep the row as a struct, so that no
    column of it clashes, with its place in the shard in bytes, a hash that breaks ties, and its size.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T.StructType().add("row", schema).add("_seq", "long").add("_tie", "long").add("_bytes", "long").add("run", "string").add("_shard", "string")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version, 0 if there is none."""
        top = self.path(f"{self.root}/manifest")
        names = [x.getPath().getName() for x in self.fs.listStatus(top)] if self.fs.exists(top) else []
        return max([0, *(int(n[1:9]) for n in names if n[0] == "v")])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version:08d}.parquet")

    def commit(self, live: DataFrame, base: int) -> int:
        """Make ``live`` the version after ``base``; a writer that was overtaken gets an error and no version."""
        draft, final = self.path(f"{self.root}/draft/{uuid.uuid4().hex}"), self.path(f"{self.root}/manifest/v{base + 1:08d}.parquet")
        live.coalesce(1).write.parquet(draft.toString())
        part = next(x.getPath() for x in self.fs.listStatus(draft) if x.getPath().getName().startswith("part-"))
        self.fs.mkdirs(final.getParent())
        if self.fs.exists(final) or not self.fs.rename(part, final):
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        self.fs.delete(draft, True)
        return base + 1

    def write(self, rows: DataFrame, run: str) -> DataFrame:
        """Write rows, which stand by shard and in order, as one file per shard; return the shards' manifest rows."""
        path = f"{self.root}/data/run={run}"
        rows.write.option("compression", "zstd").partitionBy("_shard").parquet(path)
        made = self.files([run]).groupBy("_shard")
        made = made.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_bytes").alias("n_bytes"))
        return made.select(F.col("_shard").alias("shard"), F.lit(run).alias("run"), tier(F.col("n_bytes")).alias("tier"), "n_rows", "n_bytes", F.lit(self.version() + 1).alias("version"))

    def files(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/run={r}" for r in runs])

    def append(self, docs: DataFrame, arrival: Column, order: list[Column], arrival_bytes: int = ARRIVAL_BYTES) -> int:
        """Add docs as immutable shards: each arrival, in the given order, cut where arrival_bytes are full."""
        base = self.version()
        none = F.concat(F.lit("none"), F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 4))
        rows = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(arrival.cast("string"), none).alias("_arrival"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_bytes"), row_key(F.col("text")).alias("_tie"), F.struct(*order).alias("_order"),
        )
        before = Window.partitionBy("_arrival").orderBy("_order", "_tie").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_seq", F.coalesce(F.sum("_bytes").over(before), F.lit(0)))
        rows = rows.withColumn("_part", F.floor(F.col("_seq") / arrival_bytes))
        rows = rows.withColumn("_seq", F.col("_seq") - F.min("_seq").over(Window.partitionBy("_arrival", "_part")))
        rows = rows.withColumn("_shard", F.concat(F.lit(f"{base + 1:04d}-"), zeros(F.col("_arrival"), 8), F.lit("-"), zeros(F.col("_part"), 6)))
        # The rows of an arrival already stand in one task, so no second shuffle is needed.
        rows = rows.sortWithinPartitions("_shard", "_order", "_tie").select("row", "_seq", "_tie", "_bytes", "_shard")
        return self.commit(self.manifest(base).unionByName(self.write(rows, f"append-{base + 1:08d}")), base)

    def plan(self, target_bytes: int = TARGET_BYTES) -> DataFrame:
        """Which live shards merge: shard, run, merged and _start, the place of the shard in its group in bytes.

        Shards below the target are taken by tier in the order of their names and packed by cumulative size. A group
        of one shard is left alone. The windows see one row per shard.
        """
        small = self.manifest().filter(F.col("n_bytes") < target_bytes)
        before = Window.partitionBy("tier").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        small = small.withColumn("_start", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))
        small = small.withColumn("_group", F.floor(F.col("_start") / target_bytes))
        group = Window.partitionBy("tier", "_group")
        small = small.withColumn("_parts", F.count(F.lit(1)).over(group)).withColumn("_start", F.col("_start") - F.min("_start").over(group)).filter("_parts > 1")
        merged = F.concat(F.lit(f"{self.version() + 1:04d}-tier"), zeros(F.col("tier"), 2), F.lit("-"), zeros(F.col("_group"), 6))
        return small.select("shard", "run", merged.alias("merged"), "_start")

    def compact(self, target_bytes: int = TARGET_BYTES) -> int:
        """Merge what plan() names and commit the version in which the merged shards replace their parts."""
        base = self.version()
        plan = stored(self.plan(target_bytes), "plan")
        data = self.rows(plan)
        if data is None:
            return base
        data = data.select("row", F.col("merged").alias("_shard"), (F.col("_start") + F.col("_seq")).alias("_seq"), "_tie", "_bytes")
        data = data.repartition("_shard").sortWithinPartitions("_shard", "_seq", "_tie").select("row", "_seq", "_tie", "_bytes", "_shard")
        new = self.write(data, f"merge-{base + 1:08d}")
        live = self.manifest(base).join(plan.select("shard"), "shard", "left_anti").select(new.columns).unionByName(new)
        return self.commit(live, base)

    def rows(self, shards: DataFrame) -> DataFrame | None:
        """The rows of these shards with the columns of ``shards``; other shards of a run are pruned by the join."""
        runs = [r.run for r in shards.select("run").distinct().toLocalIterator()]  # one name per append or merge
        if not runs:
            return None
        data = self.files(runs).drop("run")
        return data.join(F.broadcast(shards) if shards.count() <= MANIFEST_ROWS else shards, data["_shard"] == shards["shard"])

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows: row, shard, tier and position, the start of the row in its shard in bytes."""
        data = self.rows(self.manifest(version))
        if data is None:
            return self.spark.createDataFrame([], T.StructType().add("row", self.schema["row"].dataType).add("shard", "string").add("tier", "integer").add("position", "long"))
        return data.select("row", "shard", "tier", F.col("_seq").alias("position"))


def zeros(name: Column, least: int) -> Column:
    """The name with zeros before it up to ``least`` characters; a longer one stays whole."""
    text = name.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(least)), F.lit("0"))


def tier(n_bytes: Column) -> Column:
    """Power of FANOUT of a size in units of 4096 bytes."""
    return F.greatest(F.floor(F.log(float(FANOUT), F.greatest(n_bytes, F.lit(1)) / 4096.0)), F.lit(0)).cast("int")
