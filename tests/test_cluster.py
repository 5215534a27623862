"""Queries on executors of their own, where parts of a shuffle arrive in any order, against their oracle SQL."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quire.plans import registry
from tests.test_queries import rows

ROOT = Path(__file__).parent.parent
NAMES = ["group_stats", "extension_stats", "run_stats"]
RUN = """
import sys
from pyspark.sql import SparkSession
from quire.plans import registry
d, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[3,1,1024]", "spark.executor.memory": "800m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.warehouse.dir": d + "/warehouse", "spark.local.dir": d + "/local"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in names:
    registry.queries()[name](spark, d).write.parquet(f"{d}/{name}")
spark.stop()
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d, r = str(tmp_path_factory.mktemp("cluster")), random.Random(3)
    values = [round(r.expovariate(0.02), 4) for _ in range(60_000)]
    pd.DataFrame({"event_type": [r.choice("ab") for _ in values], "user_id": [r.randrange(900) for _ in values], "value": values}).to_parquet(f"{d}/events.parquet")
    # The cluster's workers live in a folder of SPARK_HOME unless told otherwise.
    env = {**os.environ, "PYTHONPATH": str(ROOT), "SPARK_WORKER_DIR": f"{d}/work"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    subprocess.run([sys.executable, "-c", RUN, d, *NAMES], cwd=d, env=env, check=True, capture_output=True, timeout=300)
    return d


@pytest.mark.parametrize("name", NAMES)
def test_query_on_several_executors(folder, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got, want = duck.execute(f"SELECT * FROM '{folder}/{name}/*.parquet'").df(), duck.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
