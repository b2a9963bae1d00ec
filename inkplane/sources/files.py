"""Readers and writers of dictionaries, mappings, recognizers, ledgers, audits and event logs."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkplane.functions.text import normalized

ENTRY = "mapping_id string, source_text string, mock_value string, assignment_source string, hit_count bigint"
#: Keys that never leave with an audit.
BANNED = "source_text"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON snapshot, an object with ``entries`` or a bare list; of a repeated mapping_id the first."""
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<entries: array<struct<{_ddl(ENTRY)}>>>")["entries"]
    bare = F.from_json("value", f"array<struct<{_ddl(ENTRY)}>>")
    entries = text.select(F.posexplode(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)).alias("pos", "e"))
    rows = entries.select("pos", "e.*").withColumn("_n", F.row_number().over(Window.partitionBy("mapping_id").orderBy("pos")))
    return rows.filter("_n = 1").drop("_n", "pos").withColumn("normalized", normalized(F.col("source_text")))


def _ddl(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split() for x in schema.split(", ")))


def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """source_text and mock_value of a CSV by header name: a byte order mark and further columns are let go."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.removeprefix("﻿").strip(): c for c in df.columns}
    missing = {"source_text", "mock_value"} - names.keys()
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return df.select(*[F.coalesce(F.col(f"`{names[c]}`"), F.lit("")).alias(c) for c in ("source_text", "mock_value")])


def write_mapping_csv(df: DataFrame, path: str) -> None:
    df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("source_text", "mock_value")]).write.option("header", True).option("escape", '"').csv(path)


def recognizers(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(entity, name, regex, score) of YAML files; a score defaults to 0.8, a bad file is passed over."""
    import yaml

    rows = []
    for text in texts:
        try:
            doc = yaml.safe_load(text)
            rows += [(doc["entity"], p["name"], p.get("regex", p.get("pattern")), float(p.get("score", 0.8))) for p in doc["patterns"]]
        except (yaml.YAMLError, KeyError, TypeError, ValueError):
            continue
    return spark.createDataFrame(rows, "entity string, name string, regex string, score double")


def banned_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Where a schema has a banned key, at any depth."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in ([f"{at}{f.name}"] if f.name == BANNED else []) + banned_paths(f.dataType, f"{at}{f.name}.")]
    if isinstance(kind, T.ArrayType):
        return banned_paths(kind.elementType, at)
    return banned_paths(kind.valueType, at) if isinstance(kind, T.MapType) else []


def write_audit(df: DataFrame, path: str) -> None:
    """Audits as JSON by request, refused before anything is written if the schema has a banned key.

    A request written again replaces its audit.
    """
    if found := banned_paths(df.schema):
        raise ValueError(f"an audit must not hold {found}")
    df.write.partitionBy("request_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def write_ledger(df: DataFrame, path: str) -> None:
    """Ledgers as JSON by request; a request id that could leave its folder is refused."""
    bad = df.filter(~valid_request_id(F.col("request_id")))
    if not bad.isEmpty():
        raise ValueError("a request id is blank or holds a path")
    df.write.partitionBy("request_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def valid_request_id(x: Column) -> Column:
    return F.coalesce((F.trim(x) != "") & ~x.rlike(r"[/\\]|\.\."), F.lit(False))


def safe_details(details: Column) -> Column:
    """A map without the keys that name text, values or personal data."""
    return F.map_filter(details, lambda k, v: ~F.lower(k).rlike("text|value|pii"))


def append_events(df: DataFrame, path: str) -> None:
    """Event lines, their details filtered."""
    df.withColumn("details", safe_details(F.col("details"))).write.mode("append").json(path)


class SnapshotConflict(RuntimeError):
    """Another writer made the version first."""


def write_snapshot(df: DataFrame, root: str, based_on: int | None = None) -> str:
    """The whole table as a new version; readers see it once its marker, which names the data, is complete.

    The version follows ``based_on``, the one that the table was made from, or else the last. Its marker is created only
    if it is not there, so of two writers of one version the second gets SnapshotConflict, and no update is lost.
    """
    spark = df.sparkSession
    path, fs = _files(spark, root)
    data = f"{root}/data/{uuid.uuid4().hex}"
    df.write.parquet(data)
    fs.mkdirs(path(f"{root}/versions"))
    last = max([0, *(int(x.getPath().getName()) for x in fs.listStatus(path(f"{root}/versions")))])
    number = (last if based_on is None else based_on) + 1
    try:
        marker = fs.create(path(f"{root}/versions/{number:08d}"), False)
    except Py4JJavaError as e:
        if not fs.exists(path(f"{root}/versions/{number:08d}")):
            raise  # something else went wrong
        fs.delete(path(data), True)
        raise SnapshotConflict(f"version {number} is there already") from e
    marker.write(bytearray(data.rpartition("/")[2].encode()))
    marker.close()
    return data


def snapshot_version(spark: SparkSession, root: str) -> int:
    """The number of the last complete version, 0 for none."""
    path, fs = _files(spark, root)
    if not fs.exists(path(f"{root}/versions")):
        return 0
    return max([0, *(int(x.getPath().getName()) for x in fs.listStatus(path(f"{root}/versions")) if x.getLen() > 0)])


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table of a version, of the last by default."""
    number = snapshot_version(spark, root) if version is None else version
    name = spark.read.text(f"{root}/versions/{number:08d}").first()[0]
    return spark.read.parquet(f"{root}/data/{name}")


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def masked_settings(settings: Column, secret: str = "key|token|password|secret") -> Column:
    """A map of settings with secrets masked."""
    return F.transform_values(settings, lambda k, v: F.when(F.lower(k).rlike(secret) & (v != ""), F.lit("***")).otherwise(v))
