"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from inkplane.plans import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_scans_at_the_edge_of_a_day(spark, tmp_path):
    """Times in the last half second of a day, halves of a second, times before 1970, and nulls."""
    days = [f"{d} {t}" for d in ("1969-12-30", "1969-12-31", "1970-01-01", "2024-01-01", "2024-01-02") for t in ("10:00:00.5", "23:59:59.4", "23:59:59.5", "23:59:59.7")]
    rows = [(n * 7 + k, t, n) for n in range(9) for k, t in enumerate(days) if (n * 5 + k) % 3] + [(900, None, 1), (901, days[5], None), (902, days[9], None), (903, None, None)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/t")
    duckdb.sql(f"COPY (SELECT * FROM '{tmp_path}/t/*.parquet') TO '{tmp_path}/events.parquet'")
    same(spark, QUERIES["stable_files"], ORACLES["stable_files"], str(tmp_path))


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
