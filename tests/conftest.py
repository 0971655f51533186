import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a Column over one-row literals: value(lambda c: f(c), x) -> result."""
    from pyspark.sql import functions as F

    def run(make, *args):
        row = spark.range(1).select(*[F.lit(a).cast("string" if a is None or isinstance(a, str) else "long" if isinstance(a, int) else "double").alias(f"a{i}") for i, a in enumerate(args)])
        return row.select(make(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]

    return run
