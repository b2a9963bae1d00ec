"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules that split on [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def own_dir() -> str:
    """A temp folder of this process, for sessions of one machine without a shared folder; it goes with the process."""
    path = tempfile.mkdtemp(prefix="inkplane-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares; below a temp folder where none is set, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or own_dir()
    return f"{base.rstrip('/')}/inkplane/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, whatever functions are shipped to it."""
    return sys.modules.setdefault("_inkplane_worker", types.ModuleType("_inkplane_worker")).__dict__


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the quick function where no other letter could change."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.rlike(r"[^\x00-\x7F\p{Ll}]"), slow).otherwise(F.lower(text))


def count_words(text: Column) -> Column:
    """Number of runs of anything but SPACE; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(t, SPACE + "+", -1)) - t.rlike(f"^{SPACE}").cast("int") - t.rlike(f"{SPACE}\\z").cast("int")
    return F.when(t == "", F.lit(0)).otherwise(pieces).cast("long")


def row_key(text: Column) -> Column:
    """Tells rows apart that share an id; with the id it names a row, and equal rows give equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that no classifier may learn from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
